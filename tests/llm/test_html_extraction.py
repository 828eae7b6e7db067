import html
import random
import re

import pytest

from bitloom.llm.html_extraction import extracted, main_text, op3_html_extraction, read, scores

BODY = [
    "The river rose in the night, and by morning the road was gone; nobody had seen the like, they said.",
    "People came out, looked at the water, and went in again. What else could they do, after all?",
    "By noon, however, the level had fallen: first by a hand, then by two, and in the end quite quickly.",
]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
WANT = "\n\n".join(["A flood &c.", *BODY])
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>{MENU}</nav><article><h1>A flood &amp;c.</h1>{PARAGRAPHS}</article><footer>&copy; us, all rights.</footer></body>",
        f"<div id=top class=siteNav>{MENU}</div><div class='has-sidebar main'><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div><div class='sidebar'><p>Other, shorter news.</p></div>",
        f"<header><h2>The Paper</h2></header><main><h1>A flood &amp;c.</h1>{PARAGRAPHS}<form><label>Mail</label><input><button>Go</button></form><section id=comments><p>First, I must say, this is wrong, quite wrong!</p></section></main>",
        f"<table><tr><td>{MENU}<td><div><h1>A flood &amp;c.</h1>{PARAGRAPHS}<div class='cookie-notice'>We use cookies, as you know.</div></div></table>",
        f"<body><div class=header>Our paper, since 1900.</div><div><h1>A flood\n &#38;c.</h1>{''.join('<p>' + p.replace(' ', chr(10), 1) for p in BODY)}</div><aside>More, of the same.</aside><script>var x = '<p>no</p>';</script><!-- <p>not this</p> -->",
        f"<body><article><h1>A <b>flood</b> &amp;c.</h1>{PARAGRAPHS.replace('<p>', '<p><i>', 1)}<div class='ad'>Buy, now!</div></article>",
    ],
)
def test_main_text(page):
    assert main_text(page) == html.unescape(WANT)


LONG = BODY * 7


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><nav>{MENU}</nav><article><h1>One</h1>{PARAGRAPHS * 3}</article><article><h2>Two</h2>{PARAGRAPHS * 2}</article></body>", ["One", *BODY * 3, "Two", *BODY * 2]),
        (f"<main><h1>One</h1>{PARAGRAPHS}<article>{PARAGRAPHS * 4}</article>{PARAGRAPHS}<p>So.</p><p>{BODY[0]}</p></main>", ["One", *BODY * 6, "So.", BODY[0]]),
        (f"<div id=a>{MENU}</div><div class=post><h1>Title</h1><p>lede</p><div class=body>{''.join(f'<p>{p}</p>' for p in LONG)}</div></div>", ["Title", "lede", *LONG]),
        (f"<div>{MENU}</div><div class=post><h1>Title</h1><p>By <a>A. Writer</a></p><div class=body><h2>Part</h2>{PARAGRAPHS}</div></div>", ["Title", "By A. Writer", "Part", *BODY]),
    ],
)
def test_content_of_several_elements(page, want):
    assert main_text(page) == "\n\n".join(want)


COMMENTS = "".join(f"<div class=comment><p>{p}</p></div>" for p in BODY * 4)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=page class='right-sidebar'><nav>{MENU}</nav><div><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div><div class=sidebar><p>Other, shorter news.</p></div></div>",
        f"<div class='two-col sidebar-left'><div class=legal><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div></div><footer>&copy; us.</footer>",
        f"<body><form action=x.aspx><div class=nav>{MENU}</div><div><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div><aside>More, of the same.</aside></form></body>",
        f"<div class='x-widget'><h1>A flood &amp;c.</h1></div>{''.join(f'<div class=x-widget><p>{p}</p></div>' for p in BODY)}<footer>&copy; us.</footer>",
        f"<div class=right-sidebar><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div><section id=comments>{COMMENTS}</section>",
        f"<div class=menu-open><main><h1>A flood &amp;c.</h1>{PARAGRAPHS}</main></div><section id=comments>{COMMENTS}</section>",
        f"<head><title>x</title><div class=discussion><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div>",
    ],
)
def test_names_do_not_drop_the_article(page):
    assert main_text(page) == html.unescape(WANT)


def test_names_drop_what_is_beside_the_article():
    assert main_text(f"<article><h1>A flood &amp;c.</h1>{PARAGRAPHS}<section id=comments>{COMMENTS}</section></article>") == html.unescape(WANT)
    assert main_text(f"<nav>{MENU}</nav>") == ""
    assert main_text(f"<article><p>So, no.</p></article><footer>&copy; us. {BODY[0]}</footer>") == "So, no."


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>A flood &amp;c.</h1>{PARAGRAPHS}<div class=x1>{MENU}</div><p>{BODY[0]}</p></article>",
        f"<article><h1>A flood &amp;c.</h1>{PARAGRAPHS}<div class=zz9>Buy now!</div><p>{BODY[0]}</p></article>",
        f"<article><h1>A flood &amp;c.</h1>{PARAGRAPHS}<p>{BODY[0]}</p>{''.join(f'<div class=usr><p>I say, {k}: this is wrong, quite wrong!</p></div>' for k in range(4))}</article>",
        f"<div>{MENU}</div><div><h1>A flood &amp;c.</h1>{PARAGRAPHS}</div><div><p>{BODY[0]}</p></div>",
        f"<body><nav>{MENU}</nav><div class=social-history><h1>A flood &amp;c.</h1>{PARAGRAPHS}<p>{BODY[0]}</p></div></body>",
        f"<body><nav>{MENU}</nav><section id=comments-on-the-law><h1>A flood &amp;c.</h1>{PARAGRAPHS}<p>{BODY[0]}</p></section></body>",
    ],
)
def test_ratios_and_not_names_decide(page):
    assert main_text(page) == html.unescape(WANT) + "\n\n" + BODY[0]


def test_pages_with_random_names():
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") for _ in range(5))
    for _ in range(60):
        body = [rng.choice(BODY) for _ in range(rng.randint(3, 9))]
        title = "What came of it"
        parts = [f"<p>{b}</p>" for b in body]
        parts.insert(rng.randint(1, len(parts)), f"<div class={name()}>{MENU}</div>")
        inner = f"<h1>{title}</h1>{''.join(parts)}"
        inner = rng.choice([f"<div class={name()}><div id={name()}>{inner}</div></div>", f"<article>{inner}</article>"])
        user = name()
        after = "".join(f"<div class={user}><p>Well, {k}, no!</p></div>" for k in range(rng.choice([0, 2, 5])))
        page = f"<body><div class={name()}>{MENU}</div>{inner}{after}<div class={name()}>{MENU}</div></body>"
        assert main_text(page) == "\n\n".join([title, *body])


def test_lists_tables_and_quotes_of_an_article_stay():
    page = f"<article><h1>T</h1>{PARAGRAPHS}<ul><li>one</li><li>two <a href=x>there</a></li></ul><div><table><tr><td>a<td>b</table></div><div><blockquote>Yes.</blockquote></div><div><h2>More</h2></div>{PARAGRAPHS}</article>"
    assert main_text(page) == "\n\n".join(["T", *BODY, "one", "two there", "a", "b", "Yes.", "More", *BODY])


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<script>x</script>") == ""
    assert main_text("just words, no tags") == "just words, no tags"
    assert main_text("<p>cut <b") == "cut"
    assert main_text("a < b and c") == "a < b and c"
    assert main_text("<div>" * 30_000 + "deep, text." + "</div>" * 10) == "deep, text."
    assert main_text("<article><p>one<br>two</p></article>") == "one two"


def test_paths_and_ratios():
    pieces = read("<div><p>Some text, here.</p><p>More.</p></div><ul><li><a>x</a></li></ul>")
    paths = [p.owner.path for p in pieces]
    assert paths[0] == paths[1] != paths[2]
    assert [p.link for p in pieces] == [False, False, True]
    fused = scores(pieces)
    assert fused[0] > fused[2]


def plain(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in parts if b)


def test_query_is_the_articles(spark):
    base = "/root/testdata/sf0.001"
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{base}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op3_html_extraction(spark, base).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>é</p>", "x"), (2, "u", "<p>é</p>", "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in extracted(pages).collect()) == [("1", ""), ("2", "é"), ("2", "é"), ("None", "")]
    assert extracted(pages.limit(0)).count() == 0
