"""Byte accounting: rollups of page metrics, container sizes, projections, counterfactuals and the ledger of owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.words import round_up

# The reservation for outputs and the geometry behind the payload formula.
LAYERS, HEADS, WIDTH, GROWTH = 28, 8, 128, 256
FIELDS = ("raw_bytes", "q_bytes", "scales_biases_bytes", "refinement_payload_bytes", "metadata_bytes", "refinement_bytes", "literal_bytes", "palette_bytes", "shared_bytes", "dual_palette_bytes")


def payload_bytes(tokens: Column) -> Column:
    """Bytes of keys and values of so many tokens in 16-bit words."""
    return 2 * LAYERS * HEADS * WIDTH * 2 * tokens


def tail_columns(prompt: Column, output: Column, workspace: Column) -> dict[str, Column]:
    """What a prompt's outputs and verifier reserve."""
    extra = round_up(prompt + output + workspace, GROWTH) - round_up(prompt, GROWTH)
    draft = F.floor(payload_bytes(extra) * 36 / 128).cast("long")
    return {
        "exact_bytes": payload_bytes(output),
        "candidate_bytes": payload_bytes(workspace),
        "extra_tokens": extra,
        "draft_bytes": draft,
        "shared_tail_bytes": payload_bytes(output) + payload_bytes(workspace) + draft,
        "raw_tail_bytes": payload_bytes(output),
    }


def rollup(pages: DataFrame) -> DataFrame:
    """Totals by role, by head, by stream and over all, in one pass: level says which."""
    sums = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in (*FIELDS, "mode0", "mode1", "mode2", "values"))
    level = "CASE grouping_id(role, head, label) WHEN 3 THEN 'role' WHEN 5 THEN 'head' WHEN 0 THEN 'stream' ELSE 'all' END"
    text = f"SELECT {level} AS level, role, head, CAST(label AS INT) AS label, count(*) AS pages, {sums} FROM {{pages}} GROUP BY GROUPING SETS ((role), (head), (role, head, label), ())"
    return pages.sparkSession.sql(text, pages=pages)


def descriptors(pages: DataFrame) -> DataFrame:
    """Per stream: the position of its first page in page order, its number of pages, and its breaks of the rule that pages count up from 0."""
    per = pages.groupBy("label").agg(F.count("*").alias("page_count"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count_distinct("page_id").alias("ids"))
    # as many rows as streams
    position = F.sum("page_count").over(Window.orderBy("label")) - F.col("page_count")
    broken = (F.col("first_id") != 0) | (F.col("last_id") != F.col("page_count") - 1) | (F.col("ids") != F.col("page_count"))
    return per.select("label", position.alias("first_page"), "page_count", broken.cast("int").alias("breaks"))


def ledger(entries: DataFrame) -> DataFrame:
    """Owned bytes by owner from (seq, owner, category, allocated, logical): equal sizes under one owner count once, other categories become aliases, unequal sizes are flagged."""
    first = F.min_by("category", "seq")
    return entries.groupBy("owner").agg(
        first.alias("category"), F.min("allocated").alias("allocated"), F.min("logical").alias("logical"),
        F.array_join(F.array_sort(F.array_except(F.collect_set("category"), F.array(first))), ",").alias("aliases"),
        ((F.min("allocated") != F.max("allocated")) | (F.min("logical") != F.max("logical")) | (F.min("allocated") < 0) | (F.max(F.col("logical") > F.col("allocated")))).alias("conflict"),
    )


#: Projections: components, stages, and which tail they bear.
SCENARIOS = tuple(
    [("shared_one_stage", "shared_bytes", 1, "shared"), ("shared_two_stage", "shared_bytes", 2, "shared"), ("raw_exact", "raw_bytes", 0, "raw")]
    + [(f"{name}_{label}", column, n, tail) for name, column, tail in (("palette_dual", "dual_palette_bytes", "shared"), ("palette_exact_only", "palette_bytes", "raw"), ("zstd_dual", "dual_zstd_bytes", "shared"), ("zstd_exact_only", "zstd_bytes", "raw")) for label, n in (("one_stage", 1), ("two_stage", 2))]
)


def projections(prompts: DataFrame, scenarios: tuple = SCENARIOS) -> DataFrame:
    """Peak bytes of each prompt in each scenario: components, stages and tail. The scenarios are an array of fixed length in each row, not a join.

    prompts: prompt, raw_bytes and the byte columns that the scenarios name, stage_bytes, shared_tail_bytes, raw_tail_bytes.
    """
    each = F.array(*[F.struct(F.lit(name).alias("scenario"), F.col(column).alias("resident_bytes"), (F.lit(n) * F.col("stage_bytes")).alias("stages_bytes"), F.col(f"{tail}_tail_bytes").alias("tail_bytes")) for name, column, n, tail in scenarios])
    rows = prompts.select("prompt", "raw_bytes", "raw_tail_bytes", F.explode(each).alias("s")).select("prompt", "raw_bytes", "raw_tail_bytes", "s.*")
    peak = F.col("resident_bytes") + F.col("stages_bytes") + F.col("tail_bytes")
    return rows.select("prompt", "scenario", "resident_bytes", peak.alias("peak_bytes"), F.round(peak / (F.col("raw_bytes") + F.col("raw_tail_bytes")), 2).alias("ratio"))
