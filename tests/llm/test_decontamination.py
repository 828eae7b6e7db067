import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import decontamination as d

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = []
    for key, text in items:
        ws = plain_words(text)
        if key is not None and ws:
            windows += [(key, ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))]
    out = []
    for key, text in docs:
        ws, hit, keys = plain_words(text), set(), set()
        for item, w in windows:
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    keys.add(str(item))
        out.append((key, len(ws), sorted(hit), sorted(keys)))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A", "z", "é", "É", "9", "_", " ", "\x7f", " ", " ", "漢", "{", "\n"]), max_size=20))
def test_words(parts):
    text = "".join(parts)
    assert [w.decode() for w in d.words(text)] == plain_words(text)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "short one"), (10, "A B C D E F G H I J"), (3, None), (4, "..."), (None, "x y"), (5, "the the the")]
DOCS = [
    (1, "z a b c d e f g h i j k l a b"),
    (2, "SHORT, one! short one the the the the"),
    (3, None),
    (4, ""),
    (5, "a b c d e f g h i"),
    (5, "j k l"),
    (None, "short one x y"),
    (6, "one short"),
    (7, "b c d e f g h i j k l " * 30),
    (7, "b c d e f g h i j k l " * 30),
]


def rows(df):
    return sorted([(r.doc_id, r.n_words, list(r.hits), list(r.items)) for r in df.collect()], key=str)


def test_equals_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, "x") for k, t in DOCS], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(d.contamination(docs, items)) == brute(DOCS, ITEMS)
    monkeypatch.setattr(d, "BLOCK_BYTES", 20)
    assert {(r.doc_id, *r.near_items) for r in d.contamination(docs, items, near=0).collect()} >= {(1, "1", "10"), (6, "2")}
    assert rows(d.contamination(docs, items)) == brute(DOCS, ITEMS)
    assert d.contamination(docs.limit(0), items).count() == 0
    assert all(not r.hits for r in d.contamination(docs, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x blue y green"), (2, "red blue"), (3, "green"), (4, "green blue x x x red"), (5, "blue green red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    assert {r.doc_id for r in d.contamination(docs, items, near=2).collect() if r.near_items} == {1, 5}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdx"), max_size=30), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=7), max_size=4), st.integers(0, 3), st.sampled_from([1, 50]))
def test_many_phrases_equal_brute_force(docs, items, slop, chunk):
    texts = [" ".join(ws) for ws in docs]
    terms, counts, positions, n_words = d.indexed(texts)
    shard = d.Shard(terms, counts.astype("<i4").tobytes(), np.diff(positions, prepend=0).astype("<i4").tobytes(), n_words.tolist())
    phrases = d.Phrases([(str(k), " ".join(ws)) for k, ws in enumerate(items)], 4)
    before, d.CHUNK = d.CHUNK, chunk
    (which, starts), close = shard.seek(phrases, slop)
    d.CHUNK = before
    want, may = set(), set()
    for w, row in enumerate(phrases.windows.tolist()):
        window = [phrases.terms[t].decode() for t in row if t >= 0]
        base = 0
        for ws in docs:
            want |= {(w, base + k) for k in range(len(ws) - len(window) + 1) if ws[k : k + len(window)] == window}
            if any(set(window) <= set(ws[k : k + len(window) + slop]) for k in range(len(ws))):
                may.add(w)
            base += len(ws) + 1
    assert set(zip(which.tolist(), starts.tolist(), strict=True)) == want and may <= set(close.tolist())
    found = {tuple(phrases.terms[t].decode() for t in row if t >= 0): [phrases.names[i] for i in phrases.owners[phrases.firsts[w] : phrases.firsts[w + 1]]] for w, row in enumerate(phrases.windows.tolist())}
    plain = {}
    for k, ws in enumerate(items):
        for i in range(max(1, len(ws) - 3)) if ws else ():
            plain.setdefault(tuple(ws[i : i + 4]), set()).add(str(k))
    assert found == {w: sorted(v) for w, v in plain.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdx"), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(0, 3))
def test_near_equals_brute_force(docs, window, slop):
    numbers = {t: [] for t in sorted({w for ws in docs for w in ws})}
    want, base, width = [], 0, len(window) + slop
    for ws in docs:
        for k, w in enumerate(ws):
            numbers[w].append(base + k)
            if w in window and set(window) <= set(ws[k : k + width]):
                want.append(base + k)
        base += len(ws) + 1
    if not set(window) <= set(numbers):
        return
    gaps = np.concatenate([np.array(v) for v in numbers.values()])
    shard = d.Shard(" ".join(numbers).encode(), np.array([len(v) for v in numbers.values()], "<i4").tobytes(), np.diff(gaps, prepend=0).astype("<i4").tobytes(), [len(ws) for ws in docs])
    assert shard.near(tuple(w.encode() for w in window), width).tolist() == want


def test_query_has_proximity(spark, tmp_path):
    window = "one two three four five six seven eight nine ten".split()
    texts = {1: window, 2: window[:4] + ["x", "y"] + window[4:], 3: window[:3] + [window[4], window[3]] + window[5:], 4: window[:4] + ["x"] * 3 + window[4:], 5: window[1:]}
    spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(window))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: (r.contaminated, r.n_near, r.near_items) for r in d.op9_decontamination(spark, str(tmp_path)).collect()}
    assert found == {1: (True, 1, "7"), 2: (False, 1, "7"), 3: (False, 1, "7"), 4: (False, 0, ""), 5: (False, 0, "")}


def test_query(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    want = {k: (n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for k, n, h, i in brute(docs, items)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.op9_decontamination(spark, base).collect()}
    assert got == want and any(v[4] for v in want.values())
