import random

import numpy as np
import pytest

from bitloom.llm import minhash_forest as f
from bitloom.llm import ngram_join as j
from bitloom.llm.components import components


def plain(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = {k: plain(t) for k, t in docs}
    distinct = set(sets.values())
    near = {s: {r for r in distinct if r is not s and r != s and s and r and 5 * len(s & r) >= 4 * len(s | r)} for s in distinct}
    group = {}
    for s in distinct:
        if s not in group:
            todo, seen = [s], {s}
            while todo:
                for r in near[todo.pop()] - seen:
                    seen.add(r)
                    todo.append(r)
            least = min(k for k, x in sets.items() if x in seen)
            group.update(dict.fromkeys(seen, least))
    copies = {s: [k for k, x in sets.items() if x == s] for s in distinct}
    return sorted((k, group[s], min(copies[s]), len(copies[s]), len(near[s])) for k, s in sets.items())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    seeds = [[word() for _ in range(rng.randint(3, 120))] for _ in range(12)]
    docs = []
    for _ in range(90):
        w = list(rng.choice(seeds)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = word()
        docs.append((len(docs) * 3 + 1, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \n")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(k, t, "s") for k, t in docs], "doc_id long, text string, class_id string")
    rows = sorted(tuple(r) for r in j.near_duplicates(df, block_bytes=4000).collect())
    assert rows == brute(docs)


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in j.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(4, 4, 4, 3, 0), (4, 4, 4, 3, 0), (None, 4, 4, 3, 0), (None, None, None, 1, 0)], key=str)
    assert j.near_duplicates(df.limit(0)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f", "x", 3, "T"), (2, "a b c d e f", "y", 4, "T"), (3, "z", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, u string, key int, TEXT string")
    got = j.representatives(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_depth_and_recall():
    depth = f.matched_depth()
    assert f.recall(depth) >= f.RECALL > f.recall(depth + 1)
    assert f.depth_for(6) > f.depth_for(5) == f.depth_for(1000) == depth


def test_trie_matches_all_common_prefixes():
    rng = np.random.default_rng(3)
    records = np.zeros(400, f.RECORD)
    records["own"]["a"] = rng.permutation(400)
    digits = rng.integers(0, 3, (400, f.DEPTH)).astype(np.uint64)
    string = rng.integers(0, 2, 400).astype(np.uint64)
    for k in range(f.DEPTH):
        string = string << np.uint64(f.LABEL) | digits[:, k]
    ends = rng.choice([f.matched_depth(), f.DEPTH], 400).astype(np.uint64)
    records["string"] = string << np.uint64(f.SPARE) | ends
    records["bits"] = rng.choice(np.array([[0, 0], [0, 7], [0, (1 << 64) - 1], [(1 << 64) - 1, 5]], np.uint64), 400)
    found, left, right = f.matches(records)
    label = np.arange(400)
    j._joined(label, left, right)
    for x in range(400):
        for y in range(x):
            a, b = found[x], found[y]
            depth = int(max(a["string"] & 31, b["string"] & 31))
            if f.prefixes(a["string"], depth) == f.prefixes(b["string"], depth) and f.differing(a["bits"], b["bits"]) <= f.most_differing():
                assert label[x] == label[y]
    assert len(set(label.tolist())) > 20


def test_minhash_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    a, b = x[:900], x[100:]
    same = (f.labels(a) == f.labels(b)).mean()
    assert abs(same - 0.8) < 0.12
    assert (f.labels(x) == np.minimum(f.labels(a), f.labels(b))).all()


def test_sketches_differ_by_half_the_distance():
    rng = np.random.default_rng(2)
    found = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        found.append(int(f.differing(f.signature(x[:800])[1], f.signature(x[100:])[1])))  # 700 of 900
    assert abs(np.mean(found) - 128 / 9) < 2 and max(found) <= f.most_differing()


def test_recall_near_the_threshold(spark):
    # 2,000 pairs of similarity 0.8 to 0.85, none of which may be lost
    rng = random.Random(7)
    docs = []
    for k in range(2000):
        words = [f"p{k}w{i}" for i in range(rng.randint(60, 200))]
        n = len(words) - 4
        cut = rng.randint(int(0.155 * n), n - -(-8 * n // 10))
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[cut:]))]
    got = {r.doc_id: r.class_id for r in j.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=300_000).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(2000)) >= 1999


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    docs = [(0, " ".join(base))]
    for k in range(1, 5000):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        docs.append((k, " ".join(words)))
    sets = {k: plain(t) for k, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in j.near_duplicates(df, block_bytes=200_000).collect()}
    assert {r.class_id for r in rows.values()} == {0}
    distinct = list(set(sets.values()))
    for k in range(0, 5000, 500):
        s = sets[k]
        want = sum(5 * (o := len(s & r)) >= 4 * (len(s) + len(r) - o) for r in distinct) - 1
        assert 0.9995 * want <= rows[k].n_links <= want


def test_groups_larger_than_a_tile(spark):
    docs = corpus(8)
    df = spark.createDataFrame([(k, t) for k, t in docs], "doc_id long, text string")
    assert not all(r.whole for r in j.links(df.toDF("key", "text"), 4000, 700).collect())
    assert sorted(tuple(r) for r in j.near_duplicates(df, block_bytes=4000, tile_bytes=700).collect()) == brute(docs)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(300, k) for k in range(301, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in range(200):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root


def test_query_on_the_small_table(spark):
    base = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    rows = sorted(tuple(r) for r in j.op6_ngram_jaccard_join(spark, base).collect())
    want = brute(docs)
    assert rows == want and any(r[4] for r in want)
