"""Reading tables, mapping texts through Arrow, and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: whatever names it has, repeated ones or such as differ in case alone, none clashes."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Just the named columns under fixed names, with the casts given: id="doc_id:long". Other columns, however named, are left out.

    Names are taken as they are written; of columns with one name the first counts, and where none is written so, one that differs in case alone.
    """
    names, own, out = df.columns, positional(df), []
    for name, source in wanted.items():
        column, _, kind = source.partition(":")
        at = names.index(column) if column in names else [n.lower() for n in names].index(column.lower())
        out.append(own[f"c{at}"].cast(kind or "string").alias(name))
    return own.select(out)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


#: What a worker process keeps from task to task, for one operator at a time: workers outlive stages, and their memory is shared by all.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What make() gave in this worker under the name, made now if another operator's task has run since."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """At the start of a task that keeps nothing: frees what another operator has kept."""
    _KEPT.clear()


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str, chunk_rows: int = 256, keeps: bool = False) -> DataFrame:
    """Each row of df through a function; make() builds it once per task, it takes the row's values and yields any number of output rows.

    Rows are handled a few at a time, so memory holds an input batch and a small output batch only.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        each = make()
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                rows = [out for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for out in each(*values)]
                if rows:
                    yield record_batch(rows, kinds)

    return df.mapInArrow(run, schema)


def record_batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="bitloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it, whatever executors are lost, and don't compute it again. It stays until forget() or discard()."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/bitloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written() table that no later step reads."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this application has written and not forgotten: for the end of a job, when its results are stored."""
    _delete(spark, _own_folder(spark))


def scan_bytes(df: DataFrame, column: str) -> int:
    """The bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
