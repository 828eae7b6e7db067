import corpus_pipeline as c
import test_decontamination
import test_line_dedup
import test_ngram_join

from bitloom.llm import toxicity

BASE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    for name, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, BASE), name)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        texts = [(k, r.text) for k, r in before.items()]
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet"))
            assert set(after) == {k for k, t in texts if toxicity.Scorer(model)(t) < 0.5}
        elif name == "line_dedup":
            gone = test_line_dedup.brute(texts)
            want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts}
            assert {k: r.text for k, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_jaccard_join":
            assert set(after) == {group for _, group, *_ in test_ngram_join.brute(texts)}
        else:
            assert set(after) == {k for k, _, hits, _ in test_decontamination.brute(texts, items) if not hits}
        if name != "line_dedup":
            assert all(tuple(after[k]) == tuple(before[k]) for k in after)
        before = after
    pieces = c.STAGES[-1][1](spark, docs, BASE).collect()
    assert {r.doc_id for r in pieces} == set(before)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "other words are here now", "x"), (2, "a b c d e f", "y"), (None, "n o p q r", None), (None, "n o p q r", None), (None, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = c.ngram_jaccard_join(spark, docs, BASE).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a b c d e f", "x"), (1, "other words are here now", "x"), (None, "n o p q r", None), (3, "", None)]))
    items = c.benchmark_decontamination(spark, docs, BASE)
    assert items.count() == len(rows)


def test_empty_table_goes_through_all_stages(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{BASE}/{t}.parquet").limit(0 if t == "documents" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_run_is_its_stages(spark, tmp_path):
    from bitloom.llm import tables

    tables.discard(spark)
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, BASE)
    assert {r.doc_id for r in c.run(spark, BASE).collect()} == {r.doc_id for r in docs.collect()}
