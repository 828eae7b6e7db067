import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import toxicity as t

BASE = "/root/testdata/sf0.001"


def corpus(n, seed):
    rng = random.Random(seed)
    fill = ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        bad = rng.random() < 0.2
        words = rng.choices(fill, k=rng.randint(3, 60)) + ([rng.choice(["zorgak", "Zorgaken", "unzorgak"])] if bad else [])
        rng.shuffle(words)
        out.append((" ".join(words), int(bad)))
    return out


def trained(spark, rows):
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    return t.train(docs, labels)


def plain(rows, sizes=(3, 4, 5), smooth=0.5, min_z=3.0, penalty=0.02, rounds=400):
    """The same model by dictionaries and a dense matrix. rows: text, label."""
    counts, total = (Counter(), Counter()), [0, 0]
    for text, y in rows:
        words = t.words_of(text)
        total[y] += len(words)
        for w in words:
            counts[y].update({f"^{w}$"[k : k + n] for n in sizes for k in range(len(w) + 3 - n)})
    ratio = {}
    for g in counts[0].keys() | counts[1].keys():
        a, b = counts[1][g] + smooth, counts[0][g] + smooth
        r = math.log(a / (total[1] + smooth)) - math.log(b / (total[0] + smooth))
        if abs(r) >= min_z * math.sqrt(1 / a + 1 / b):
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] if any(g in f"^{w}$" for w in t.words_of(text)) else 0.0 for g in names] for text, _ in rows])
    y = np.array([y for _, y in rows], float)
    v = np.ones(len(names))
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * (np.sum((x @ v) ** 2) + len(y)) / len(y) + penalty)
    w = ahead = np.zeros(len(names))
    bias = ahead_bias = math.log(y.mean() / (1 - y.mean()))
    s = 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ ahead + ahead_bias))) - y) / len(y)
        new, new_bias = ahead - step * (x.T @ g + penalty / len(names) * ahead), ahead_bias - step * g.sum()
        s_new = (1 + math.sqrt(1 + 4 * s * s)) / 2
        ahead, ahead_bias = new + (s - 1) / s_new * (new - w), new_bias + (s - 1) / s_new * (new_bias - bias)
        w, bias, s = new, new_bias, s_new
    return {g: a * ratio[g] for g, a in zip(names, w, strict=True)}, bias


@pytest.fixture(scope="module")
def model(spark):
    return trained(spark, corpus(800, 1))


def test_model_equals_dictionaries_and_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(t, "ENTRIES", 50)
    rows = corpus(200, 3)
    weights, bias = plain([r for i, r in enumerate(rows) if t.fold(i)])
    got = trained(spark, rows)
    assert abs(got.bias - bias) < 1e-9 and set(got.weights) == {g for g, a in weights.items() if abs(a) > 1e-9}
    assert all(abs(a - weights[g]) < 1e-9 for g, a in got.weights.items())


def test_held_out_accuracy(model):
    score = t.Scorer(model)
    fresh = corpus(400, 2)
    assert sum((score(x) >= 0.5) == bool(y) for x, y in fresh) >= 396
    assert score("ZORGAKS are here") > 0.5 > score("")


def test_scores_are_the_linear_model(model):
    for text, _ in corpus(20, 4):
        grams = {g for w in t.words_of(text) for g in t.ngrams(w, model.sizes)}
        z = model.bias + sum(w for g, w in model.weights.items() if g in grams)
        assert abs(t.Scorer(model)(text) - 1 / (1 + math.exp(-z))) < 1e-9


def test_one_class_none_and_no_telling_ngrams(spark):
    for rows in ([("a", 0)] * 9, [("a", 1), ("", 1), ("b c", 1)], [("same", k % 2) for k in range(20)]):
        assert 0 <= t.Scorer(trained(spark, rows))("a b") <= 1


def test_fold_is_the_contract():
    assert [t.fold(k) for k in (0, 7, 123)] == [zlib.crc32(str(k).encode()) % 5 for k in (0, 7, 123)]


def test_rows_and_nulls(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, x, 0.0) for i, (x, _) in enumerate(rows)] + [(None, None, 0.0), (1000, "", 0.0), (3, rows[3][0], 0.0), (1001, rows[3][0] * 5000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(rows)] + [(None, 1, "x"), (7, None, "x"), (99999, 1, "x")], "doc_id long, toxic int, text string")
    model = t.train(docs, labels)
    got = t.scored(docs, model).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == bool(rows[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 300) >= 295
    assert t.scored(docs.limit(0), model).count() == 0
    assert t.train(docs, labels.limit(0)).weights == {} == t.train(docs.limit(0), labels).weights


def test_held_out_labels_are_never_read(spark):
    rows = corpus(120, 6)
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    true = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    other = spark.createDataFrame([(i, y if t.fold(i) else 1 - y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    assert t.train(docs, true) == t.train(docs, other)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()]
    weights, bias = plain([(docs[k], y) for k, y in sorted(labels) if t.fold(k) and k in docs])
    got = t.op7_toxicity(spark, BASE).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        z = bias + sum(weights.get(g, 0.0) for g in {g for w in t.words_of(docs[r.doc_id]) for g in t.ngrams(w, (3, 4, 5))})
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6
        assert (r.held_out, r.predicted) == (t.fold(r.doc_id) == 0, int(r.score >= 0.5))
