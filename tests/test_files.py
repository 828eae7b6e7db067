import json
import os

import pytest
from pyspark.sql import functions as F

from bitloom.operators import accounting, datasets
from bitloom.operators.codec_pages import containers
from bitloom.plans import registry, tensor_queries
from bitloom.sources import files

SF = "/root/testdata/sf0.001"


def test_records_are_written_whole_or_not_at_all(tmp_path, monkeypatch):
    path = str(tmp_path / "r.json")
    first = files.write_record(path, {"schema_version": 1, "kind": "x", "b": 2, "a": "é"}, "x")
    assert open(path).read() == '{"a":"\\u00e9","b":2,"kind":"x","schema_version":1}\n' and len(first) == 64
    monkeypatch.setattr(os, "replace", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        files.write_record(path, {"schema_version": 1, "kind": "x"}, "x")
    assert json.load(open(path))["b"] == 2 and len(os.listdir(tmp_path)) == 1
    for bad in ({"kind": "x"}, {"schema_version": 1, "kind": "y"}):
        with pytest.raises(ValueError):
            files.write_record(path, bad, "x")
    with pytest.raises(ValueError):
        files.canonical(float("nan"))


def test_content_store(tmp_path):
    name = files.store_content(str(tmp_path), ".txt", b"one")
    assert files.store_content(str(tmp_path), ".txt", b"one") == name
    (tmp_path / name).write_bytes(b"two")
    with pytest.raises(ValueError):
        files.store_content(str(tmp_path), ".txt", b"one")


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".cache").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    (tmp_path / "a" / ".cache" / "y.txt").write_text("no")
    assert [r.text for r in files.whole_texts(spark, str(tmp_path / "a" / "x.txt")).collect()] == ["one\ntwo"]
    rows = files.digests(spark, str(tmp_path / "a")).collect()
    assert [(r.path, r.bytes) for r in rows] == [("x.txt", 7)]
    lines = str(tmp_path / "m.jsonl")
    made = spark.createDataFrame([("dev", "code", 3, "ab", ["s/1"])], files.MANIFEST)
    files.write_lines(lines, made)
    with open(lines, "a") as f:
        f.write("\n\n")
    assert files.json_lines(spark, lines, files.MANIFEST).collect() == made.collect()
    (tmp_path / "g.json").write_text(json.dumps({"schema_version": 1, "kind": "gate", "name": "G1", "status": "stop", "reason": "r", "evidence": [{"path": "p", "sha256": "s"}]}, indent=1))
    gate = files.json_record(spark, str(tmp_path / "g.json"), files.GATE)
    assert gate.select(F.inline("evidence")).first().path == "p"
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), files.MANIFEST).collect()


def test_generated_lines_repeat(spark):
    one = files.generated(spark, 5, ("a", "b"), 10).collect()
    assert one == files.generated(spark, 5, ("a", "b"), 10).collect() and json.loads(one[3].line)["kind"] == "b"


def test_reservation_values(spark):
    rows = {(r.prompt, r.output): r for r in registry.QUERIES["tail_reservations"](spark, SF).collect()}
    assert rows[2048, 256].payload == 224 << 20 and rows[512, 256].raw_tail_bytes == 28 << 20
    assert rows[512, 256].extra_tokens == 512 and rows[512, 256].shared_tail_bytes == 46_907_392


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "split string, identity string")
    assert datasets.shared_across(empty, "identity").count() == 0
    some = spark.createDataFrame([("a", None), ("b", None), ("a", "x"), ("b", "x"), ("b", "y")], "split string, identity string")
    assert [r.identity for r in datasets.shared_across(some, "identity").collect()] == ["x"]
    old = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert {(r.k, r.outcome) for r in datasets.upsert(old, old.limit(0), ["k"], ["v"]).collect()} == {(1, "kept"), (2, "kept")}
    assert {(r.k, r.outcome) for r in datasets.upsert(old, old, ["k"], ["v"]).collect()} == {(1, "equal"), (2, "equal")}
    entries = spark.createDataFrame([], "seq int, owner string, category string, allocated long, logical long")
    assert accounting.ledger(entries).count() == 0


def test_stored_containers(spark, tmp_path):
    rows = registry.QUERIES["stream_containers"](spark, SF)
    boxes = containers(tensor_queries._blobs(spark, SF)).select("label", "container", "pages").collect()
    assert len(boxes) == rows.count()
    for r in boxes:
        (tmp_path / f"{r.label}.box").write_bytes(bytes(r.container))
    (tmp_path / "cut.box").write_bytes(bytes(boxes[0].container)[:-5])
    (tmp_path / "short.box").write_bytes(b"abc")
    found = files.stored_containers(spark, str(tmp_path)).collect()
    assert {r.path.rpartition("/")[2] for r in found if r.problem} == {"cut.box", "short.box"}
    counts = {}
    for r in found:
        if not r.problem:
            counts[r.stream] = counts.get(r.stream, 0) + 1
    assert counts == {str(r.label): r.pages for r in boxes}


def test_summary_is_one_line(spark):
    assert files.summary(spark.createDataFrame([(1, "a\nb")], "n int, `x.y` string")) == '{"n":1,"x.y":"a\\nb"}'
    with pytest.raises(ValueError):
        files.summary(spark.createDataFrame([], "n int"))


def test_environment_tells_why_what_is_missing(spark):
    row = files.environment(spark).first()
    assert row.ram_bytes > 0 and row.pyspark_version and all((row[c] is None) == (c in row.unavailable) for c in row.asDict() if c != "unavailable")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
