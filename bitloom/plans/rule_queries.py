"""Queries that find what breaks the rules of locks, gates, records, reports and canonical lines. Their tables are made from the text tables with broken rows among the sound ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import datasets as D
from bitloom.plans import dataset_queries, tensor_queries

QUERIES: dict = {}
ORACLES: dict = {}


def _ruled(name: str, table: str, made: dict[str, str], rules: dict[str, str | tuple[str, str]]):
    """A query that counts the rows which break each rule. made: columns of the table; texts that both dialects read, or a pair of Spark's and DuckDB's."""
    spark_of = lambda x: x if isinstance(x, str) else x[0]
    duck_of = lambda x: x if isinstance(x, str) else x[1]
    rows = f"SELECT {', '.join(f'{duck_of(x)} AS {c}' for c, x in made.items())} FROM {table}"
    ORACLES[name] = f"WITH made AS ({rows}) " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) FILTER (NOT coalesce({duck_of(x)}, false)) AS broken FROM made" for rule, x in rules.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{spark_of(x)} AS {c}" for c, x in made.items()])
        return D.violations(own, {rule: F.expr(spark_of(x)) for rule, x in rules.items()})

    QUERIES[name] = run


_HEX = ("{0} RLIKE '^[0-9a-f]{{40}}$'", "regexp_matches({0}, '^[0-9a-f]{{40}}$')")
_DIGEST = ("sha2(cast(text AS binary), 256)", "sha256(text)")

_ruled(
    "lock_rules",
    "documents",
    {
        "revision": tuple(f"CASE WHEN doc_id % 11 = 0 THEN 'main' ELSE substr({d}, 1, 40) END" for d in _DIGEST),
        "tokenizer_revision": tuple(f"CASE WHEN doc_id % 13 = 0 THEN substr({d}, 2, 40) WHEN doc_id % 11 = 0 THEN 'main' ELSE substr({d}, 1, 40) END" for d in _DIGEST),
        "remote_code": "doc_id % 17 = 0",
        "number_type": "CASE WHEN doc_id % 7 = 0 THEN 'float16' WHEN doc_id % 7 = 1 THEN NULL ELSE 'bfloat16' END",
        "layers": "CASE WHEN doc_id % 19 = 0 THEN 27 ELSE 28 END",
        "quantised": "CASE WHEN doc_id % 23 = 0 THEN 'four bits' END",
        "path": "CASE doc_id % 29 WHEN 0 THEN '/shard' WHEN 1 THEN 'a/../shard' WHEN 2 THEN '..' ELSE 'a/shard..1' END",
        "positions": "n_chars",
        "context": "CASE WHEN doc_id % 31 = 0 THEN 32769 ELSE least(32768, n_chars) END",
    },
    {
        "revision_is_fixed": tuple(x.format("revision") for x in _HEX),
        "tokenizer_revision_is_fixed": tuple(x.format("tokenizer_revision") for x in _HEX),
        "revisions_agree": "revision = tokenizer_revision",
        "no_remote_code": "NOT remote_code",
        "original_numbers": "number_type = 'bfloat16'",
        "geometry": "layers = 28",
        "not_quantised": "quantised IS NULL",
        "path_stays_inside": ("NOT startswith(path, '/') AND NOT array_contains(split(path, '/'), '..')", "NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..')"),
        "context_is_the_least": "context > 0 AND context = least(32768, positions)",
    },
)

_ruled(
    "gate_rules",
    "documents",
    {
        "name": "CASE doc_id % 5 WHEN 0 THEN concat('gate', doc_id) WHEN 1 THEN 'G' WHEN 2 THEN concat('G', doc_id, 'b') ELSE concat('G', doc_id % 7) END",
        "status": "CASE doc_id % 6 WHEN 0 THEN 'maybe' WHEN 1 THEN 'narrow' WHEN 2 THEN 'stop' WHEN 3 THEN 'blocked' WHEN 4 THEN NULL ELSE 'pass' END",
        "evidence": "doc_id % 4",
    },
    {
        "status_is_known": "status IN ('pass', 'narrow', 'stop', 'blocked')",
        "name_is_a_number": ("name RLIKE '^G[0-9]+$'", "regexp_matches(name, '^G[0-9]+$')"),
        "has_evidence": "evidence > 0",
        "authorises": "status IN ('pass', 'narrow')",
    },
)

# What a record must have, by kind.
_REQUIRED = {"gate": ("name", "status", "reason"), "environment": ("python", "ram")}
_FIELDS = {
    "version": "CASE WHEN doc_id % 9 = 0 THEN 2 WHEN doc_id % 9 = 1 THEN NULL ELSE 1 END",
    "kind": "CASE WHEN doc_id % 8 = 0 THEN 'other' WHEN doc_id % 2 = 0 THEN 'gate' ELSE 'environment' END",
    "name": "CASE WHEN doc_id % 3 > 0 THEN 'x' END",
    "status": "CASE WHEN doc_id % 10 > 0 THEN 'pass' END",
    "reason": "CASE WHEN doc_id % 7 > 0 THEN lang END",
    "python": "CASE WHEN doc_id % 3 < 2 THEN '3' END",
    "ram": "CASE WHEN doc_id % 5 > 0 THEN n_chars END",
}
_MISSING = " ".join(f"WHEN '{kind}' THEN concat_ws(',', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in names)})" for kind, names in _REQUIRED.items())
_MADE = ", ".join(f"{x} AS {c}" for c, x in _FIELDS.items())
_PROBLEM = f"CASE WHEN coalesce(version, 0) <> 1 THEN 'version' WHEN kind NOT IN ('gate', 'environment') THEN 'kind' ELSE CASE kind {_MISSING} ELSE '' END END"
_RECORD_PROBLEMS = f"SELECT doc_id, kind, {_PROBLEM} AS problem FROM (SELECT doc_id, {_MADE} FROM {{table}}) AS made WHERE {_PROBLEM} <> ''"


def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an unknown version or kind, and those without fields that their kind requires, with these."""
    return spark.sql(_RECORD_PROBLEMS.format(table="{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES["record_problems"], ORACLES["record_problems"] = record_problems, _RECORD_PROBLEMS.format(table="documents")


def noncanonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines that aren't what the record in them is written as: with blanks, with keys out of order, with a line end, or cut."""
    line = F.expr(_LINE)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", line.alias("line"))
    again = F.to_json(F.from_json("line", "id long, kind string, user long", {"mode": "PERMISSIVE"}))
    return rows.where(~F.coalesce(again == F.col("line"), F.lit(False))).select("event_id", F.sha2(F.col("line").cast("binary"), 256).alias("sha256"))


_LINE = """CASE event_id % 7 WHEN 0 THEN concat('{"id": ', event_id, ',"kind":"', event_type, '","user":', user_id, '}') WHEN 1 THEN concat('{"kind":"', event_type, '","id":', event_id, ',"user":', user_id, '}')
    WHEN 2 THEN concat('{"id":', event_id, ',"kind":"', event_type, '","user":', user_id, '}', chr(10)) WHEN 3 THEN concat('{"id":', event_id, ',"kind":"', event_type) ELSE concat('{"id":', event_id, ',"kind":"', event_type, '","user":', user_id, '}') END"""
QUERIES["noncanonical_lines"] = noncanonical_lines
ORACLES["noncanonical_lines"] = f"SELECT event_id, sha256({_LINE}) AS sha256 FROM events WHERE event_id % 7 < 4"

_WANTED = "VALUES ('dev', 'prose', 0), ('dev', 'code', 1000), ('heldout', 'structured', 500), ('heldout', 'prose', 100000000), ('other', 'prose', 0)"


def prompts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each filter of prompts, how many there are; a filter that finds none is an error."""
    wanted = spark.sql(f"SELECT * FROM {_WANTED} AS t(split, domain, least)")
    counts = dataset_queries._records(spark, sf_dir).select("split", "domain", "n_chars").join(F.broadcast(wanted), ["split", "domain"]).where("n_chars >= least").groupBy("split", "domain", "least").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return wanted.join(counts, ["split", "domain", "least"], "left").select("split", "domain", "least", n.alias("n"), (n == 0).alias("is_error"))


QUERIES["prompts_found"] = prompts_found
ORACLES["prompts_found"] = f"""WITH {dataset_queries.RECORDS}, wanted(split, domain, least) AS ({_WANTED}), counts AS (SELECT w.split, w.domain, w.least, count(*) AS n FROM records r JOIN wanted w ON r.split = w.split AND r.domain = w.domain AND r.n_chars >= w.least GROUP BY ALL)
    SELECT w.split, w.domain, w.least, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS is_error FROM wanted w LEFT JOIN counts c ON w.split = c.split AND w.domain = c.domain AND w.least = c.least"""

# A report's prompts, one stream each, some with a wrong figure.
_WRONG = {
    "raw": "raw_bytes + CASE WHEN prompt % 3 = 0 THEN 2 ELSE 0 END",
    "shared": "shared_bytes + CASE WHEN prompt % 4 = 1 THEN 1 ELSE 0 END",
    "container": "CASE WHEN prompt % 5 = 2 THEN 0 ELSE 64 END",
    "raw_projected": "raw_bytes + raw_tail_bytes + CASE WHEN prompt % 7 = 3 THEN 9 ELSE 0 END",
    "one_stage": "shared_bytes + shared_tail_bytes + CASE WHEN prompt % 6 = 5 THEN 0 ELSE stage_bytes END",
    "two_stage": "shared_bytes + shared_tail_bytes + CASE WHEN prompt % 6 = 4 THEN 1 ELSE 2 END * stage_bytes",
    "palette_one_stage": "dual_palette_bytes + shared_tail_bytes + CASE WHEN prompt % 8 = 6 THEN 1 ELSE 0 END + stage_bytes",
}
_REPORT = {
    "raw_is_the_formula": "raw = 128 * tokens",
    "shared_is_the_sum": "shared = shared_bytes",
    "container_is_counted": "container > 0",
    "raw_and_tail": "raw_projected = raw_bytes + raw_tail_bytes",
    "one_stage_is_some": "one_stage - shared_bytes - shared_tail_bytes > 0",
    "two_stages_are_twice": "two_stage - shared_bytes - shared_tail_bytes = 2 * (one_stage - shared_bytes - shared_tail_bytes)",
    "palette_with_its_stage": "palette_one_stage = dual_palette_bytes + shared_tail_bytes + one_stage - shared_bytes - shared_tail_bytes",
}
_MADE_REPORT = ", ".join(f"{x} AS {c}" for c, x in _WRONG.items())


def report_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many prompts of a report break each of its rules: sums, the formula of raw bytes (64 values of two bytes a token), projections by stage."""
    pages = tensor_queries._pages(spark, sf_dir)
    tokens = pages.groupBy(F.col("label").alias("prompt")).agg((F.sum("values") / 64).cast("long").alias("tokens"))
    return D.violations(tensor_queries._prompts(pages).join(tokens, "prompt").selectExpr("*", *[f"{x} AS {c}" for c, x in _WRONG.items()]), {rule: F.expr(x) for rule, x in _REPORT.items()})


QUERIES["report_rules"] = report_rules
ORACLES["report_rules"] = f'WITH {tensor_queries.PROMPTS}, tokens AS (SELECT label AS prompt, sum("values")::BIGINT // 64 AS tokens FROM page GROUP BY label), made AS (SELECT *, {_MADE_REPORT} FROM prompts JOIN tokens USING (prompt)) ' + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER (NOT coalesce({x}, false)) AS broken FROM made" for rule, x in _REPORT.items()
)
