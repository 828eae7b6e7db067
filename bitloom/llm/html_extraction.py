"""Main text of web pages by tag-path ratios.

The page is read as a stream of tags and text. Each piece of text has a tag path, the names of its open elements from the root.
For each path the text's length and its punctuation are added up and divided by the number of its pieces and of link characters; a wide path
with much punctuation is prose, a path of menus is not. The ratios are smoothed along the page, both kinds are fused into one, and pieces over a
threshold are content. The smallest element that holds nearly all of the content's weight is the article. Returned are its blocks, all content outside it, the
blocks between the first and the last of these, and the heading before with what follows it, except for containers that by their links, ratios or place aren't of the
article, and for elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms or reader comments. All text is scored before these are left out:
such an element that holds most of the content's weight is a wrapper around the article and stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.tables import columns, map_rows, table

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "li", "dd", "dt", "summary"} | {"li", "dd", "dt"}
#: What an opening tag closes when it stands open above it, up to the nearest of the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPES = frozenset("table td th caption button object".split())
DROPPED = frozenset("nav footer aside form button select input menu dialog iframe script style noscript template textarea title head svg math label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Tags of text beside an article, which may outweigh it.
BESIDE_TAGS = frozenset("nav footer aside button select input menu dialog label".split())
#: Words of names of boilerplate; those of text beside an article, which may outweigh it, first.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertorial adsense adbox banner banners sponsor sponsored sponsors promo promos promotion promotions promoted nav navs navbar navigation menu menus "
    "breadcrumb breadcrumbs footer footers foot cookie cookies consent gdpr newsletter copyright comment comments commentlist reply replies respond disqus discussion reactions feedback "
    "related recommended recommendations share sharing social hidden".split()
)
NAMES = BESIDE | frozenset("sidebar sidebars side aside rail masthead siteheader pageheader topbar toolbar notice notices alert alerts popup popups modal modals overlay subscribe subscription signup signin login widget widgets pagination pager legal disclaimer skip".split())
#: Words that such names are made with; a name with any other word is some other name.
NEUTRAL = frozenset(
    "list lists box boxes block section wrap wrapper container area item items bar bars content inner outer main top bottom left right primary secondary global site page post article entry user reader links link text title body header head "
    "sticky fixed inline form icons icon buttons button row col column grid panel group unit slot zone wide small large mobile desktop policy message messages thread media sub in up out to on off first last".split()
)
#: Containers of no meaning of their own, and what a text is made of that isn't a mere line.
GENERIC, OWN = frozenset("div section article ul ol menu dl table span center".split()), frozenset("h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|no|with|without)[_-]\w+", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]{2,}")
MARKS = re.compile(r"[^\w\s]")
SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Element:
    name: str
    parent: Element | None
    #: what makes it boilerplate: its tag, role or name
    mark: str = ""
    #: the mark names text that stands beside an article
    beside: bool = False
    #: number of the tag path from the root
    path: int = 0
    #: the tag as it is written
    tag: str = ""
    weight: float = 0.0

    def __post_init__(self):
        above = self.parent
        self.dropped = bool(self.mark) or above is not None and above.dropped
        self.depth = above.depth + 1 if above else 0
        self.link = self.name == "a" or above is not None and above.link
        self.heading = self.name if self.name in HEADINGS else above.heading if above else ""
        self.article = self.name in ("article", "main") or above is not None and above.article


@dataclass
class Piece:
    text: str
    owner: Element
    #: number of the block that the piece belongs to
    block: int
    link: bool


def _boilerplate(name: str, attributes: str, inside_article: bool) -> tuple[str, bool]:
    """What makes an element boilerplate, if anything does, and whether that names text beside an article."""
    if name in DROPPED:
        return name, name in BESIDE_TAGS
    if name == "header" and not inside_article:
        return name, False
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "", False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for one in LAYOUT.sub("", HUMP.sub("-", value)).lower().split():
                made = WORD.findall(one)
                if (known := [w for w in made if w in NAMES]) and all(w in NAMES or w in NEUTRAL for w in made):
                    return known[0], any(w in BESIDE for w in known)
                if not inside_article and one in ("header", "hdr"):
                    return "header", False
        if key == "role" and value.lower() in ROLES:
            return value.lower(), value.lower() not in ("form", "alert")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return "hidden", True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hidden", True
    return "", False


def read(page: str) -> list[Piece]:
    """The pieces of text of a page, in order, with their elements; tags may be unclosed, misplaced or cut off."""
    pieces: list[Piece] = []
    root = Element("", None)
    stack, block, at, n = [root], 0, 0, len(page)
    paths: dict[tuple[int, str], int] = {}
    is_open: Counter[str] = Counter()  # so that the stack is searched only for what it holds

    def shut(k: int) -> None:
        nonlocal block
        if any(e.name in BLOCK for e in stack[k:]):
            block += 1
        is_open.subtract(e.name for e in stack[k:])
        del stack[k:]

    def text(raw: str) -> None:
        top = stack[-1]
        if raw:
            pieces.append(Piece(html.unescape(raw) if "&" in raw else raw, top, block, top.link))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m.group().startswith("<![CDATA["):
                text(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                text(" ")
            for k in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[k].name == name:
                    shut(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if name in ("br", "wbr"):
            text(" " if name == "br" else "")
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if is_open["p"] else ():
                if stack[k].name == "p":
                    shut(k)
                    break
                if stack[k].name in SCOPES:
                    break
        if name in IMPLIED:
            ends, limits = IMPLIED[name]
            low = len(stack)
            for k in range(len(stack) - 1, 0, -1) if any(is_open[e] for e in ends) else ():
                if stack[k].name in limits:
                    break
                if stack[k].name in ends:
                    low = k
            if low < len(stack):
                shut(low)
        if name in BLOCK:
            block += 1
        if name in VOID or m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        top = stack[-1]
        path = paths.setdefault((top.path, name), len(paths) + 1)
        element = Element(name, top, *_boilerplate(name, m[3], top.article), path, name + m[3])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(element)
        is_open[name] += 1
    return pieces


def ratios(pieces: list[Piece]) -> dict[int, tuple[float, float]]:
    """For each tag path, length and punctuation a piece, less the share of links."""
    sums: dict[int, list[float]] = {}
    for p in pieces:
        entry = sums.setdefault(p.owner.path, [0, 0, 0, 0])
        size = len(p.text.strip())
        entry[0] += size
        entry[1] += len(MARKS.findall(p.text))
        entry[2] += bool(size)
        entry[3] += size if p.link else 0
    return {path: (length / max(1, n) * (1 - linked / max(1, length)), marks / max(1, n) * (1 - linked / max(1, length))) for path, (length, marks, n, linked) in sums.items()}


def scores(pieces: list[Piece], window: int = 2, sigma: float = 1.0) -> np.ndarray:
    """For each piece, the fused and smoothed ratios of its tag path."""
    ratio = ratios(pieces)
    kernel = np.exp(-0.5 * (np.arange(-window, window + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, window, mode="edge"), kernel, "valid")
    by_length, by_marks = (smooth(np.array([ratio[p.owner.path][k] for p in pieces])) for k in (0, 1))
    return by_length * (1 + by_marks)


@dataclass
class Sums:
    """What an element's pieces add up to."""

    size: int = 0
    linked: int = 0
    links: int = 0
    #: the highest ratio of the pieces' paths
    ratio: float = 0.0
    first: int = 1 << 60
    main: bool = False
    own: bool = False


def _foreign(pieces: list[Piece], content: np.ndarray, low_share: float = 0.25, links: int = 3) -> set[int]:
    """Containers among the content that aren't of it, whatever their names: those of links; those of mere lines whose path has but a low ratio; and, after the last text
    of the path with most content, those that stand in a row of equal ones, as comments do. None of them holds text of that path."""
    ratio = ratios(pieces)
    fused = {path: length * (1 + marks) for path, (length, marks) in ratio.items()}
    by_path: Counter[int] = Counter()
    for p, good in zip(pieces, content.tolist(), strict=True):
        by_path[p.owner.path] += len(p.text.strip()) if good and not p.link else 0
    if not by_path:
        return set()
    main, weight = by_path.most_common(1)[0]
    if not weight:
        return set()
    last = max(k for k, p in enumerate(pieces) if p.owner.path == main and p.text.strip())
    known: dict[int, tuple[Element, Sums]] = {}
    for k, p in enumerate(pieces):
        size = len(p.text.strip())
        if not size:
            continue
        e, own = p.owner, False
        while e is not None:
            sums = known.setdefault(id(e), (e, Sums()))[1]
            sums.size += size
            sums.linked += size if p.link else 0
            sums.links += p.link
            sums.ratio = max(sums.ratio, fused[p.owner.path])
            sums.first = min(sums.first, k)
            sums.main |= p.owner.path == main
            own = own or e.name in OWN
            sums.own |= own
            e = e.parent
    rows: Counter[tuple[int, str]] = Counter()
    for e, sums in known.values():
        if e.name in GENERIC and not sums.main and sums.first > last:
            rows[id(e.parent), e.tag] += 1
    out = set()
    for e, sums in known.values():
        if e.name not in GENERIC or sums.main or e.parent is None:
            continue
        menu = sums.links >= links and 2 * sums.linked >= sums.size
        line = not sums.own and e.name in ("div", "section") and sums.ratio < low_share * fused[main]
        if menu or line or sums.first > last and rows[id(e.parent), e.tag] > 1:
            out.add(id(e))
    return out


def _weights(pieces: list[Piece], weight: np.ndarray) -> list[Element]:
    """All elements of the pieces, the deepest first, with the weights of their pieces added up."""
    known: dict[int, Element] = {}
    for p in pieces:
        e = p.owner
        while e is not None and id(e) not in known:
            known[id(e)] = e
            e.weight = 0.0
            e = e.parent
    for p, w in zip(pieces, weight.tolist(), strict=True):
        p.owner.weight += w
    out = sorted(known.values(), key=lambda e: -e.depth)
    for e in out:
        if e.parent is not None:
            e.parent.weight += e.weight
    return out


def _content(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ratios of the pieces, which are content, and the lengths of these."""
    fused = scores(pieces)
    content = fused >= min(fused.std() if len(fused) > 1 else 0.0, fused.max())
    return fused, content, np.where(content, np.array([len(p.text.strip()) for p in pieces], float), 0)


def _keep_wrappers(pieces: list[Piece], share: float) -> None:
    """Unmarks elements around the article: those that hold most of the content of all text, whatever their names.

    Text beside an article, such as comments or the footer of a short page, may outweigh it, so these stay marked unless they hold the h1, or nearly all
    is theirs and no <article> or <main> is left without them. If the names leave next to nothing, the article is in several elements of one mark, and those of the mark with most of the weight are unmarked together.
    """
    fused, _, weight = _content(pieces)
    weight = np.where(fused > 0, weight, 0)

    def settle(elements: list[Element]) -> None:
        for e in reversed(elements):
            e.dropped = bool(e.mark) or e.parent is not None and e.parent.dropped

    elements = _weights(pieces, weight)
    own = {id(e): e.weight for e in elements}
    titles = {id(e): e.weight for e in _weights(pieces, np.array([p.owner.heading == "h1" and bool(p.text.strip()) for p in pieces], float))}
    articles = any(p.owner.article and not p.owner.dropped and p.text.strip() for p in pieces)
    whole = own[id(elements[-1])]
    aside: set[int] = set()
    for e in reversed(elements):
        if e.beside and titles[id(e)]:
            e.beside = False
        elif e.beside and whole and own[id(e)] >= share * whole and not articles:
            e.mark, e.beside = "", False
        if e.beside or e.parent is not None and id(e.parent) in aside:
            aside.add(id(e))
    weight = np.where([id(p.owner) in aside for p in pieces], 0, weight)
    elements = _weights(pieces, weight)
    total = elements[-1].weight
    for e in elements:
        if e.mark and not e.beside and e.weight > 0.5 * total:
            e.mark = ""
    settle(elements)
    left = sum(w for p, w in zip(pieces, weight.tolist(), strict=True) if not p.owner.dropped)
    if total and left <= (1 - share) * total:
        by_mark: Counter[str] = Counter()
        for e in elements:
            if e.mark and not e.beside and not (e.parent is not None and e.parent.dropped):
                by_mark[e.mark] += e.weight
        for mark, _ in by_mark.most_common(1):
            for e in elements:
                if e.mark == mark and not e.beside:
                    e.mark = ""
        settle(elements)


def _opening(pieces: list[Piece], first: int, links: int = 5) -> int:
    """Where the text that starts at the piece `first` begins with its heading: back to the nearest one, and to higher ones above it, but not past a run of links."""
    start, rank, run = first, pieces[first].owner.heading or "h7", 0
    if pieces[first].owner.article and rank != "h7":
        return start
    for k in range(first - 1, -1, -1):
        p, size = pieces[k], len(pieces[k].text.strip())
        if p.owner.heading:
            if size and p.owner.heading < rank:
                start, rank = k, p.owner.heading
        elif size:
            run = run + 1 if p.link else run if size < 4 else 0
            if run == links:
                break
    return start


def main_text(page: str | None, share: float = 0.9) -> str:
    """The blocks of the article and of all content around it, joined by two line breaks; empty if the page has no text."""
    pieces = read(page or "")
    if any(p.owner.dropped and p.text.strip() for p in pieces):
        _keep_wrappers(pieces, share)
    pieces = [p for p in pieces if not p.owner.dropped]
    if not any(p.text.strip() for p in pieces):
        return ""
    _, content, weight = _content(pieces)
    elements = _weights(pieces, weight)
    total = elements[-1].weight or 1.0
    marked = [e for e in elements if e.name in ("article", "main") and e.weight >= 0.5 * total]
    best = max(marked or [e for e in elements if e.weight >= share * total and (e.name in BLOCK or not e.name)], key=lambda e: e.depth)
    while best.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "blockquote", "ul", "ol", "dl", "dd", "dt", "pre", "b", "table", "tbody") and best.parent is not None and best.parent.parent is not None:
        best = best.parent  # an article of one paragraph is still the element around it

    inside = {id(best)}
    for e in reversed(elements):
        if e.parent is not None and id(e.parent) in inside:
            inside.add(id(e))
    chosen = [k for k, p in enumerate(pieces) if p.text.strip() and (content[k] or id(p.owner) in inside)]
    foreign = _foreign(pieces, content)
    for e in reversed(elements):
        if e.parent is not None and id(e.parent) in foreign:
            foreign.add(id(e))
    chosen = [k for k in chosen if id(pieces[k].owner) not in foreign] or chosen
    low, high = pieces[_opening(pieces, chosen[0])].block, pieces[chosen[-1]].block
    found: dict[int, list[str]] = {}
    for p in pieces:
        if low <= p.block <= high and id(p.owner) not in foreign:
            found.setdefault(p.block, []).append(p.text)
    blocks = [SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(found.items())]
    return "\n\n".join(b for b in blocks if b)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text. A null or empty page gives the empty text; repeated rows give repeated rows; other columns are left out."""

    def make():
        def each(key: int | None, url: str | None, page: str | None) -> Iterator[tuple]:
            yield key, url, main_text(page)

        return each

    return map_rows(columns(pages, key=f"{id_col}:long", url=url_col, page=html_col), make, "page_id long, url string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
