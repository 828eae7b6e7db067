import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import key_exchange as x
from bitloom.llm import substring_dedup as s


def brute(docs, window):
    words = [(k, (t or "").encode().split()) for k, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for key, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(y for i, y in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, sum(p.end - p.start for p in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()], key=str)


def test_cover_has_every_difference():
    assert {(a - b) % s.PERIOD for a in s.COVER for b in s.COVER} == set(range(s.PERIOD))


def test_runs_of_words_are_equal_where_their_words_are():
    rng = random.Random(4)
    words = [rng.choice([b"a", b"b"]) for _ in range(3000)]
    h = s.hashes_of(words)
    for width in (1, 2, 5, 8, 13, 35):
        for which in (0, 1):
            number = {}
            found = s.rolled(h, width, which).tolist()
            assert len(found) == len(words) - width + 1
            for k, x in enumerate(found):
                assert number.setdefault(x, tuple(words[k : k + width])) == tuple(words[k : k + width])
            assert len(set(found)) == len(set(tuple(words[k : k + width]) for k in range(len(found))))


def test_runs_of_a_pattern_differ():
    # the Thue-Morse word over two words, and its complement
    for n in (16, 64, 1024, 1 << 14):
        one, other = ([b"xy"[bin(k).count("1") + swap & 1 :][:1] for k in range(n)] for swap in (0, 1))
        for which in (0, 1):
            assert s.rolled(s.hashes_of(one), n, which) != s.rolled(s.hashes_of(other), n, which)


def test_windows_of_words_of_a_pattern(spark):
    first, second = ("".join("ab"[bin(k).count("1") + swap & 1] for k in range(1024)) for swap in (0, 1))
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{first} {rest}"), (2, f"{second} {rest}")], "doc_id long, text string")
    assert all(not r.removed for r in s.repeats(docs).collect())


def test_keys_in_pairs_with_equal_first_halves():
    keys = np.array([(1, 5), (1, 3), (1, 5), (2, 0), (1, 4)], x.PAIR)
    live = np.array([(1, 3), (1, 5)], x.PAIR)
    assert x.contains(live, keys).tolist() == [True, True, True, False, False]
    rows = x.packed_keys(0, keys, 1)
    assert np.frombuffer(rows[0][2], x.PAIR).tolist() == [(1, 3), (1, 4), (1, 5), (2, 0)]
    assert np.unpackbits(np.frombuffer(rows[0][3], np.uint8))[:4].tolist() == [0, 0, 1, 0]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 30))] for _ in range(5)]
    docs = []
    for k in range(40):
        w = list(itertools.chain.from_iterable(rng.choice(passages) if rng.random() < 0.4 else [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 9))] for _ in range(6)))
        docs.append((k, "\t ".join(w)))
    docs += [(40, None), (41, ""), (None, docs[0][1]), (3, docs[3][1]), (42, "z " * 300), (43, " ".join(str(n) for n in range(40)))]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, block int")
    assert got(s.repeats(df, window=9, period=7, cover=(0, 1, 3), block_bytes=900)) == brute(docs, 9)
    assert s.repeats(df.limit(0)).count() == 0


def test_query(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    have = sorted([tuple(r) for r in s.op8_substring_dedup(spark, base).collect()], key=str)
    want = brute(docs, 35)
    assert have == want and any(r[2] for r in want)
