"""Queries that prepare and check datasets, over the text tables, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import datasets as D
from bitloom.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'heldout' ELSE 'dev' END"
DOMAIN = "CASE lang WHEN 'en' THEN 'prose' WHEN 'de' THEN 'code' ELSE 'structured' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPLIT} AS split", f"{DOMAIN} AS domain", "concat(source, '/', lang) AS source_id", "sha2(cast(text AS binary), 256) AS text_sha256", "text", "n_chars")


RECORDS = f"records AS (SELECT doc_id, {SPLIT} AS split, {DOMAIN} AS domain, source || '/' || lang AS source_id, sha256(text) AS text_sha256, text, n_chars FROM documents)"


@query("text_scan", "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_texts FROM documents")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("text").agg(F.count("*").alias("n"), F.sum(F.char_length(t)).alias("chars"), F.sum(F.octet_length(t)).alias("bytes"), F.count_distinct(F.sha2(t.cast("binary"), 256)).alias("distinct_texts"))


# Lines that end a sentence early begin a segment: short first lines are titles in these texts.
_LINES = "lines AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"
_SEGMENTS = f"""{_LINES}, flagged AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[^ ]+( [^ ]+){{0,5}}\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS segment FROM lines),
segs AS (SELECT doc, min(line)::INTEGER AS first_line, trim(arg_min(text, line), ' ' || chr(9) || chr(10) || chr(13)) AS title, trim(string_agg(text, chr(10) ORDER BY line), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM flagged WHERE segment > 0 GROUP BY doc, segment)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return D.segments(lines, F.col("text").rlike(r"^[^ ]+( [^ ]+){0,5}\.$"))


@query("article_segments", f"WITH {_SEGMENTS} SELECT doc, first_line, title, length(body)::BIGINT AS chars, sha256(body) AS body_sha256, doc::VARCHAR || ':' || first_line::VARCHAR || ':' || title AS identity FROM segs WHERE length(body) >= 300")
def article_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    return _segments(spark, sf_dir).where(F.char_length(body) >= 300).select("doc", "first_line", "title", F.char_length(body).cast("long").alias("chars"), F.sha2(body.cast("binary"), 256).alias("body_sha256"), F.concat_ws(":", "doc", "first_line", "title").alias("identity"))


@query(
    "running_pieces",
    f"""WITH {RECORDS}, kept AS (SELECT split, doc_id, length(text) AS n FROM records WHERE length(text) >= 300),
    piece AS (SELECT *, n + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY doc_id) = 1 THEN 0 ELSE 2 END AS piece FROM kept), run AS (SELECT *, sum(piece) OVER (PARTITION BY split ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - piece AS before FROM piece)
    SELECT split, doc_id, (before + piece - n)::BIGINT AS start, least(before + piece, 120000)::BIGINT AS "end" FROM run WHERE before < 150000 AND before + piece - n < 120000""",
)
def running_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of the texts that fill 150,000 characters of a split, clipped to the 120,000 that are used. Counts of stretches of ids come first, so that only
    the stretches within reach are ordered in a task."""
    kept = _records(spark, sf_dir).select("split", "doc_id", F.char_length("text").cast("long").alias("n")).where("n >= 300")
    stretch = F.floor(F.col("doc_id") / 1024)
    sums = D.running(kept.groupBy("split", stretch.alias("stretch")).agg(F.sum("n").alias("n")), "split", ["stretch"], F.col("n")).where("before < 150000").select("split", "stretch")
    near = kept.withColumn("stretch", stretch).join(sums, ["split", "stretch"])
    first = F.row_number().over(D.Window.partitionBy("split").orderBy("doc_id")) == 1
    pieces = D.running(near.withColumn("piece", F.col("n") + F.when(first, 0).otherwise(2)), "split", ["doc_id"], F.col("piece"))
    end = F.col("before") + F.col("piece")
    return pieces.where("before < 150000").select("split", "doc_id", (end - F.col("n")).alias("start"), F.least(end, F.lit(120000)).alias("end")).where("start < 120000")


@query(
    "exact_token_fits",
    f"""WITH t AS (SELECT doc_id AS doc, substr(text, 1, 6000) AS text FROM documents), p AS (SELECT doc, text, unnest(range(0, length(text) + 1)) AS n FROM t),
    c AS (SELECT doc, n, n - length(replace(substr(text, 1, n::INTEGER), ' ', '')) AS tokens FROM p) SELECT d.doc_id AS doc, (SELECT min(n)::INTEGER FROM c WHERE c.doc = d.doc_id AND tokens = 80) AS chars FROM documents d""",
)
def exact_token_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stand-in tokenizer that counts blanks, the shortest prefix of 80 tokens."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return D.fitted(texts, 80, lambda t: F.char_length(t) - F.char_length(F.replace(t, F.lit(" "), F.lit(""))), 6000)


@query(
    "split_overlaps",
    f"""WITH {RECORDS}, o AS (SELECT 'source' AS kind, source_id AS identity, split FROM records UNION ALL SELECT 'directory', split_part(source_id, '/', 1), split FROM records WHERE domain = 'code' UNION ALL SELECT 'text', text_sha256, split FROM records WHERE text_sha256 IS NOT NULL)
    SELECT kind, identity, count(DISTINCT split) AS splits FROM o GROUP BY ALL HAVING count(DISTINCT split) > 1""",
)
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    kinds = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("identity")),
        F.struct(F.lit("directory").alias("kind"), F.when(F.col("domain") == "code", F.split_part("source_id", F.lit("/"), F.lit(1))).alias("identity")),
        F.struct(F.lit("text").alias("kind"), F.col("text_sha256").alias("identity")),
    )
    rows = records.select("split", F.inline(kinds)).where("identity IS NOT NULL").withColumn("both", F.struct("kind", "identity"))
    return D.shared_across(rows, "both").select("both.kind", "both.identity", "splits")


_OLD, _NEW = "doc_id % 3 <> 0", "doc_id % 2 = 0"


@query(
    "manifest_upsert",
    f"""WITH {RECORDS}, o AS (SELECT doc_id, n_chars FROM records WHERE {_OLD}), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM records WHERE {_NEW})
    SELECT doc_id, coalesce(o.n_chars, n.n_chars)::BIGINT AS n_chars, CASE WHEN n.n_chars IS NULL THEN 'kept' WHEN o.n_chars IS NULL THEN 'added' WHEN o.n_chars = n.n_chars THEN 'equal' ELSE 'conflict' END AS outcome FROM o FULL JOIN n USING (doc_id)""",
)
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).select("doc_id", "n_chars")
    new = records.where(_NEW).withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return D.upsert(records.where(_OLD), new, ["doc_id"], ["n_chars"])


@query(
    "evidence_problems",
    f"""WITH {RECORDS}, declared AS (SELECT 'G' || (item_id % 3)::VARCHAR AS gate, 'doc/' || item_id::VARCHAR AS path, CASE WHEN item_id % 4 = 0 THEN 'stale' ELSE (SELECT text_sha256 FROM records r WHERE r.doc_id = item_id) END AS sha256 FROM benchmark),
    actual AS (SELECT 'doc/' || doc_id::VARCHAR AS path, text_sha256 AS sha256 FROM records WHERE doc_id % 7 <> 0)
    SELECT gate, d.path, CASE WHEN a.sha256 IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM declared d LEFT JOIN actual a USING (path) WHERE a.sha256 IS NULL OR a.sha256 <> d.sha256""",
)
def evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    declared = items.join(records.select("doc_id", "text_sha256"), "doc_id", "left").select(F.concat(F.lit("G"), (F.col("doc_id") % 3).cast("string")).alias("gate"), path.alias("path"), F.when(F.col("doc_id") % 4 == 0, "stale").otherwise(F.col("text_sha256")).alias("sha256"))
    return D.unproven(declared, records.where("doc_id % 7 <> 0").select(path.alias("path"), F.col("text_sha256").alias("sha256")))


@query("gates_with_evidence", "SELECT 'G' || (item_id % 3)::VARCHAR AS gate, bool_or(item_id = 1) AS binds_first, count(*) AS files FROM benchmark WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = item_id) GROUP BY 1")
def gates_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    return items.groupBy(F.concat(F.lit("G"), (F.col("item_id") % 3).cast("string")).alias("gate")).agg(F.bool_or(F.col("item_id") == 1).alias("binds_first"), F.count("*").alias("files"))


_RULES = {
    "chars_counted": ("n_chars = char_length(text)", "n_chars = length(text)"),
    "digest_shape": ("text_sha256 RLIKE '^[0-9a-f]{64}$'", "regexp_matches(text_sha256, '^[0-9a-f]{64}$')"),
    "domain_known": ("domain IN ('prose', 'code', 'structured')", "domain IN ('prose', 'code', 'structured')"),
    "relative_source": ("NOT startswith(source_id, '/') AND NOT array_contains(split(source_id, '/'), '..')", "NOT starts_with(source_id, '/') AND NOT list_contains(string_split(source_id, '/'), '..')"),
    "within_context": ("least(32768, n_chars) > 0", "least(32768, n_chars) > 0"),
    "long_enough": ("n_chars >= 300", "n_chars >= 300"),
}


@query("record_rules", f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (NOT coalesce({sql}, false)) AS broken FROM records" for name, (_, sql) in _RULES.items()))
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.violations(_records(spark, sf_dir), {name: F.expr(text) for name, (text, _) in _RULES.items()})


@query("prompt_filter", f"WITH {RECORDS} SELECT split, domain, doc_id, n_chars FROM records WHERE split = 'dev' AND n_chars BETWEEN 1000 AND 2000 ORDER BY n_chars, split, domain")
def prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("split = 'dev' AND n_chars BETWEEN 1000 AND 2000").select("split", "domain", "doc_id", "n_chars").orderBy("n_chars", "split", "domain")


@query(
    "canonical_records",
    "SELECT event_id, '{\"id\":' || event_id::VARCHAR || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id::VARCHAR || '}' AS record, sha256('{\"id\":' || event_id::VARCHAR || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id::VARCHAR || '}') AS sha256, true AS is_canonical FROM events",
)
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    again = F.to_json(F.from_json("record", "id long, kind string, user long"))
    return _table(spark, sf_dir, "events").select("event_id", record.alias("record")).select("event_id", "record", F.sha2(F.col("record").cast("binary"), 256).alias("sha256"), (again == F.col("record")).alias("is_canonical"))


@query("text_functions", "SELECT page_id, regexp_replace(url, '^https?://', '') AS bare, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS top, list_has_any(string_split(url, '/'), ['en', 'de']) AS reserved, concat_ws(':', 'prompt', page_id, 'K') AS identity, trim(' ' || chr(9) || url || chr(10), ' ' || chr(9) || chr(10)) AS stripped FROM pages")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    return _table(spark, sf_dir, "pages").select("page_id", bare.alias("bare"), F.split_part(bare, F.lit("/"), F.lit(1)).alias("top"), F.arrays_overlap(F.split("url", "/"), F.array(F.lit("en"), F.lit("de"))).alias("reserved"), F.concat_ws(":", F.lit("prompt"), "page_id", F.lit("K")).alias("identity"), D.stripped(F.concat(F.lit(" \t"), "url", F.lit("\n"))).alias("stripped"))


@query("new_contents", "SELECT sha256(text) AS sha256, min(length(text))::BIGINT AS chars FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    have = docs.where("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return files.new_content(have, docs.select("text"), F.char_length("text").cast("long").alias("chars"))


@query("template_cycle", "SELECT i::BIGINT AS sequence, ['order', 'invoice', 'ticket'][(i % 3 + 1)::INTEGER] AS kind FROM range(5000) t(i)")
def template_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("order", "invoice", "ticket")])
    return spark.range(5000).select(F.col("id").alias("sequence"), F.element_at(names, (F.col("id") % 3 + 1).cast("int")).alias("kind"))


@query("generated_records")
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.generated(spark, 11, ("order", "invoice", "ticket"))


@query("host_environment")
def host_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.environment(spark)


_LAYOUT = '{"bits":4,"code_type":"uint32","group_size":64,"metadata_type":"bf16","mode":"affine","nibble_order":"low-first","token_growth":256}'


@query("layout_identity", f"SELECT '{_LAYOUT}' AS layout, sha256('{_LAYOUT}') AS layout_id")
def layout_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.layout_fingerprint(spark)


@query("table_digests")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.digests(spark, sf_dir)
