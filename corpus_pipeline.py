"""The corpus pipeline: from raw documents to packed training sequences.

Toxic documents go; repeated and near-repeated lines are removed from what is left; of near-duplicate documents one stays; documents with benchmark passages
go; the rest is packed. Stages but the last return the columns of documents. A document that has lost all lines stays, with an empty text,
until the join of near-duplicates, where empty texts are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import best_fit_packing, decontamination, line_dedup, ngram_join, toxicity
from bitloom.llm.tables import forget, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    found = line_dedup.deduplicated(docs).toDF(*names, "n_lines_", "removed_", "kept_")
    changed = {"text": F.col("kept_").alias("text"), "n_chars": F.char_length("kept_").cast("long").alias("n_chars")}
    return found.select([changed.get(c, F.col(c)) for c in names])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_pack),
]

#: The stages are beyond SQL: trained scores, similarity joins and tokenizers. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder; what a stage has read goes when the next one's table is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
