import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bitloom.llm import best_fit_packing as b

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), b.Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "\n", "The", "don't", "it's", "x1y2", "É", "é", "İ", "ß", "ǅ", "\x1c", " ", "<|endoftext|>", "<|", "Σς", "１２", "ª²¼", "µº½", "Ⱥ", "Ǆ", "ǀƻ", "ÀÞÿ", "¡«×÷", "$$$", "­", "　", "한국", "́"])), max_size=12))
def test_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    assert ENCODER.batch(["a b", text, text.lower()]) == [ENCODER.ids("a b"), ENCODER.ids(text), ENCODER.ids(text.lower())]
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def packs(counts, capacity):
    patterns = b.plan(counts, capacity)
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for x in pattern:
            used[x] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(t for _, t in patterns)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=15))
def test_plan_uses_every_piece_once(counts):
    n = packs(counts, 30)
    total = sum(k * v for k, v in counts.items())
    assert n >= -(-total // 30)
    # no two sequences could be one: at most one is half empty or less
    assert n <= max(1, 2 * total / 30 + 1)


def test_exact_complements():
    assert packs({7: 2, 3: 2}, 10) == 2
    assert packs({5: 1, 3: 1, 2: 1}, 10) == 1
    assert packs({4: 5, 3: 5, 2: 5, 1: 5}, 10) == 5
    assert packs({6: 3, 5: 2, 4: 3}, 10) == 4
    assert packs({4096: 3}, 4096) == 3


def test_large_counts_are_packed_closely():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1.1, 60_000).astype(int) + 1)
    n = packs(Counter(lengths.tolist()), 4096)
    assert n <= -(-int(lengths.sum()) // 4096) + 2


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(b, "BUCKET_PIECES", 3)
    texts = [None, "", "the cat sat", "word " * 50, "the cat sat", "x" * 9]
    docs = spark.createDataFrame([(i if i != 4 else 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = b.packed(b.written(b.pieces(docs, capacity=16, with_ids=True), "p"), 16)
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        whole[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    for i in (0, 1, 3, 5):
        assert sum(whole[i], []) == [*TOKENIZER.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert all(len(p) == 16 for p in whole[i][:-1])
    assert len(whole[2]) == 2
    made = {r.sequence_id: r for r in b.sequences(got).collect()}
    assert {k: r.length for k, r in made.items()} == {k: sum(n for _, n in v) for k, v in by.items()}
    assert b.packed(b.written(b.pieces(docs.limit(0)), "p")).count() == 0


def test_query_packs_near_the_bound(spark):
    rows = b.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 1


def best_fit_decreasing(counts, capacity):
    gaps, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(gaps, length)
            gap = gaps.pop(k) if k < len(gaps) else capacity
            n += gap == capacity
            bisect.insort(gaps, gap - length) if gap > length else None
    return n


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(["uniform", "narrow", "heavy", "few"]), st.integers(0, 10**6))
def test_never_more_sequences_than_plain_best_fit(shape, seed):
    rng, capacity = random.Random(seed), 256
    lengths = {"uniform": range(1, capacity + 1), "narrow": range(60, 110), "heavy": [min(capacity, int(rng.paretovariate(1) * 5)) for _ in range(200)], "few": [rng.randint(1, capacity) for _ in range(5)]}[shape]
    counts = {x: rng.randint(1, 30) for x in lengths}
    patterns = b.plan(counts, capacity)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(counts)
    n, plain = sum(times for _, times in patterns), best_fit_decreasing(counts, capacity)
    assert -(-sum(x * k for x, k in counts.items()) // capacity) <= n <= plain
    assert sum(times for _, times in b._best_fit(np.array([counts.get(x, 0) for x in range(capacity + 1)]), capacity)) == plain


def test_ids_of_every_plain_character():
    chars = [chr(k) for k in range(0x250)]
    for text in ("".join(chars), " ".join(chars), " x".join(chars), *chars, *(f"a{c}1'{c}S" for c in chars)):
        assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
