"""Queries over the table of vectors, read as a quantised tensor store, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import words as W
from bitloom.operators import accounting as A
from bitloom.operators import groups as G
from bitloom.operators.codec_pages import coded, containers, page_rows
from bitloom.plans import sql_parts as P

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _groups(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = G.SMALL) -> DataFrame:
    return G.encoded_groups(G.tokens(_vectors(spark, sf_dir)), columns=columns)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pages(_groups(spark, sf_dir))


def _all(names: str, source: str) -> str:
    return f"SELECT {names} FROM {source}"


E_W = "id::INTEGER"


@query(
    "all_words",
    f"""SELECT id::INTEGER AS w, {P.order_key(E_W)}::INTEGER AS order_key, {P.from_key(P.order_key(E_W))}::INTEGER AS back,
    ({E_W} & 32640) <> 32640 AS finite, (({E_W} & 32640) = 0 AND ({E_W} & 127) <> 0) AS subnormal, {P.ok(E_W)} AS supported,
    ((({E_W} & 32768) >> 8) | ({E_W} & 127))::INTEGER AS sign_fraction, (({E_W} >> 7) & 255)::INTEGER AS exponent, id::INTEGER AS rejoined,
    (CASE WHEN id = 0 THEN 0 ELSE length(bin(id)) END)::INTEGER AS bits, ((id + 31) // 32 * 32)::BIGINT AS aligned, xor(id::INTEGER, 21845)::INTEGER AS residual, id::INTEGER AS unresidual
    FROM range(65536) t(id)""",
)
def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    sf, e = W.sign_fraction(w), W.exponent(w)
    residual = w.bitwiseXOR(F.lit(21845))
    return spark.range(65536).select(F.col("id").cast("int").alias("w")).select(
        "w", W.order_key(w).alias("order_key"), W.from_order_key(W.order_key(w)).alias("back"), W.is_finite(w).alias("finite"), W.is_subnormal(w).alias("subnormal"), W.is_supported(w).alias("supported"),
        sf.alias("sign_fraction"), e.alias("exponent"), W.rejoined(sf, e).alias("rejoined"), W.bit_length(w).alias("bits"), W.round_up(w, 32).alias("aligned"), residual.alias("residual"), residual.bitwiseXOR(F.lit(21845)).alias("unresidual"),
    )


@query("float_words", f"WITH {P.LANES} SELECT vec_id, lane::INTEGER AS lane, w, f AS widened, {P.float_ok('f')} AS float_supported FROM wide")
def float_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _vectors(spark, sf_dir).select("vec_id", W.word_array(F.col("embedding")).alias("w"))
    pairs = words.select("vec_id", F.posexplode(F.arrays_zip("w", W.float_array(F.col("w")).alias("f"))).alias("lane", "x"))
    return pairs.select("vec_id", "lane", F.col("x.w").alias("w"), F.col("x.f").alias("widened"), W.is_supported_float(F.col("x.f")).alias("float_supported"))


@query("quantised_groups", f"WITH {P.GROUPS} SELECT vec_id, scale_w, bias_w, string_agg(q::VARCHAR, ',' ORDER BY lane) AS codes FROM quant GROUP BY ALL")
def quantised_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.encoded_groups(_vectors(spark, sf_dir).select("vec_id", "embedding"), columns=("scale_w", "bias_w", "q")).select("vec_id", "scale_w", "bias_w", F.array_join("q", ",").alias("codes"))


@query(
    "packed_codes",
    f"WITH {P.GROUPS}, packed AS (SELECT vec_id, lane // 8 AS k, sum(q::BIGINT << (4 * (lane % 8))::INTEGER)::BIGINT AS word FROM quant GROUP BY ALL) SELECT vec_id, k::INTEGER AS k, word, true AS unpacked_equal FROM packed",
)
def packed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.encoded_groups(_vectors(spark, sf_dir).select("vec_id", "embedding"), columns=("q", "packed"))
    unpacked = F.flatten(F.transform("packed", lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", x, 4 * i).bitwiseAND(F.lit(15)).cast("int"))))
    return found.withColumn("unpacked_equal", unpacked == F.col("q")).select("vec_id", F.posexplode("packed").alias("k", "word"), "unpacked_equal")


@query("predicted_words", f"WITH {P.GROUPS} SELECT vec_id, lane::INTEGER AS lane, {P.rne('((q::FLOAT * s)::FLOAT + b)::FLOAT')} AS predicted, xor(w, {P.rne('((q::FLOAT * s)::FLOAT + b)::FLOAT')})::INTEGER AS residual FROM quant")
def predicted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.encoded_groups(_vectors(spark, sf_dir).select("vec_id", "embedding"), columns=("w", "predicted"))
    lanes = found.select("vec_id", F.posexplode(F.arrays_zip("w", "predicted")).alias("lane", "x"))
    return lanes.select("vec_id", "lane", F.col("x.predicted").alias("predicted"), F.col("x.w").bitwiseXOR(F.col("x.predicted")).alias("residual"))


@query("value_intervals", f"WITH {P.INTERVALS} SELECT vec_id, lane::INTEGER AS lane, mode::INTEGER AS mode, lower_key::INTEGER AS lower_key, upper_key::INTEGER AS upper_key, width, safe FROM iv")
def value_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{m}_{p}" for m in ("tight", "wide") for p in ("lower", "upper", "width", "safe")]
    found = G.encoded_groups(_vectors(spark, sf_dir).select("vec_id", "embedding"), columns=tuple(names))
    lanes = found.select("vec_id", F.posexplode(F.arrays_zip(*names)).alias("lane", "x"))
    each = F.array(*[F.struct(F.lit(k).alias("mode"), *[F.col(f"x.{m}_{p}").alias(p) for p in ("lower", "upper", "width", "safe")]) for k, m in enumerate(("tight", "wide"))])
    return lanes.select("vec_id", "lane", F.inline(each)).select("vec_id", "lane", "mode", F.col("lower").alias("lower_key"), F.col("upper").alias("upper_key"), "width", "safe")


@query("group_modes", f"WITH {P.MODES} SELECT vec_id, tight_bits, wide_bits, mode, mode_bits FROM grp")
def group_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.encoded_groups(_vectors(spark, sf_dir).select("vec_id", "embedding"), columns=("tight_bits", "wide_bits", "mode", "mode_bits"))


RANKS = f"""{P.MODES},
ranked AS (SELECT g.label, g.token, q.lane, g.mode, CASE g.mode WHEN 2 THEN q.w ELSE {P.order_key('q.w')} - i.lower_key END AS rank, CASE g.mode WHEN 2 THEN 16 ELSE i.width END AS width
  FROM grp g JOIN quant q USING (vec_id) LEFT JOIN iv i ON i.vec_id = g.vec_id AND i.lane = q.lane AND i.mode = g.mode)"""


@query(
    "rank_offsets",
    f"""WITH {RANKS} SELECT label, token::BIGINT AS token, lane::INTEGER AS lane, mode::INTEGER AS mode, rank::INTEGER AS rank, width::INTEGER AS width,
    (sum(width) OVER (PARTITION BY label, token // 32, (token % 32) // 2 ORDER BY token, lane ROWS UNBOUNDED PRECEDING) - width)::BIGINT AS bit_offset FROM ranked""",
)
def rank_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _groups(spark, sf_dir, ("mode", "w", "tight_lower", "tight_width", "wide_lower", "wide_width"))
    # a group's bits come first, so that the window orders groups and not lanes
    sized = found.withColumn("bits", F.aggregate(_widths(), F.lit(0).cast("long"), lambda s, x: s + x))
    in_restart = Window.partitionBy("label", F.floor(F.col("token") / G.RESTART_GROUPS)).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("before", F.sum("bits").over(in_restart) - F.col("bits"))
    running = F.aggregate(_widths(), F.array().cast("array<bigint>"), lambda s, x: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")) + x))  # 64 lanes
    return _lanes(sized.withColumn("ends", running), ("before", "ends")).select("label", "token", "lane", "mode", "rank", "width", (F.col("before") + F.element_at("ends", F.col("lane") + 1) - F.col("width")).alias("bit_offset"))


def _widths():
    """The widths of a group's lanes under its mode."""
    return F.when(F.col("mode") == 0, F.col("tight_width")).when(F.col("mode") == 1, F.col("wide_width")).otherwise(F.transform("w", lambda _: F.lit(16))).cast("array<int>")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(_groups(spark, sf_dir, ("mode", "w", "tight_lower", "tight_width", "wide_lower", "wide_width")), ())


def _lanes(groups: DataFrame, more: tuple[str, ...]) -> DataFrame:
    lanes = groups.select("label", "token", "mode", *more, F.posexplode(F.arrays_zip("w", "tight_lower", "tight_width", "wide_lower", "wide_width")).alias("lane", "x"))
    w = F.col("x.w")
    pick = lambda part, literal: F.when(F.col("mode") == 0, F.col(f"x.tight_{part}")).when(F.col("mode") == 1, F.col(f"x.wide_{part}")).otherwise(literal)
    return lanes.select("label", "token", "lane", "mode", *more, F.when(F.col("mode") == 2, w).otherwise(W.order_key(w) - pick("lower", F.lit(0))).alias("rank"), pick("width", F.lit(16)).alias("width"))


@query(
    "restart_words",
    f"""WITH {P.PAGES} SELECT label, page_id::BIGINT AS page_id, r::BIGINT AS restart, words, (sum(words) OVER (PARTITION BY label, page_id ORDER BY r ROWS UNBOUNDED PRECEDING) - words)::BIGINT AS first_word FROM restart""",
)
def restart_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir, ("mode_bits",))
    restart = F.floor(F.col("token") % G.PAGE_TOKENS / G.RESTART_GROUPS)
    # partitioned by page at once, so that the window needs no shuffle of its own
    by = groups.repartition("label", "page_id").groupBy("label", "page_id", restart.alias("restart")).agg(F.floor((F.sum("mode_bits") + 31) / 32).alias("words"))
    w = Window.partitionBy("label", "page_id").orderBy("restart").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("first_word", F.sum("words").over(w) - F.col("words"))


@query("mode_maps", f"WITH {P.MODES} SELECT label, (token // 32)::BIGINT AS page_id, ((token % 32) // 4)::BIGINT AS byte, sum(mode << (2 * (token % 4))::INTEGER)::BIGINT AS bits FROM grp GROUP BY ALL")
def mode_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir, ("mode",))
    part = F.call_function("shiftleft", F.col("mode").cast("long"), (2 * (F.col("token") % 4)).cast("int"))
    return groups.groupBy("label", "page_id", F.floor(F.col("token") % 32 / 4).alias("byte")).agg(F.bit_or(part).alias("bits"))


PAGE_COLUMNS = 'label, role, head, page_id, "values", raw_bytes, q_bytes, scales_biases_bytes, refinement_payload_bytes, metadata_bytes, literal_bytes, palette_bytes, mode0, mode1, mode2, refinement_bytes, shared_bytes, dual_palette_bytes'


@query("page_sizes", f"WITH {P.PAGES} SELECT {PAGE_COLUMNS} FROM page")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)


SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*A.FIELDS, "mode0", "mode1", "mode2", '"values"'))


@query(
    "stream_byte_costs",
    f"""WITH {P.PAGES} SELECT CASE WHEN grouping(role, head, label) = 3 THEN 'role' WHEN grouping(role, head, label) = 5 THEN 'head' WHEN grouping(role, head, label) = 0 THEN 'stream' ELSE 'all' END AS level,
    role, head, label::INTEGER AS label, count(*) AS pages, {SUMS} FROM page GROUP BY GROUPING SETS ((role), (head), (role, head, label), ())""",
)
def stream_byte_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rollup(_pages(spark, sf_dir))


@query("mode_histogram", f"WITH {P.MODES} SELECT m.mode::INTEGER AS mode, count(grp.mode) AS n FROM (VALUES (0), (1), (2)) m(mode) LEFT JOIN grp USING (mode) GROUP BY 1")
def mode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _groups(spark, sf_dir, ("mode",)).agg(*[F.count_if(F.col("mode") == m).alias(f"n{m}") for m in range(3)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"n{m}").alias("n")) for m in range(3)])))


@query("rank_width_histogram", f"WITH {RANKS} SELECT width::INTEGER AS width, count(*) AS n FROM ranked WHERE mode <> 2 GROUP BY 1 ORDER BY 1")
def rank_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("mode <> 2").groupBy("width").agg(F.count("*").alias("n")).orderBy("width")


@query("exponent_palettes", f"WITH {P.LANES} SELECT label, (token // 32)::BIGINT AS page_id, string_agg(DISTINCT ((w >> 7) & 255)::VARCHAR, ',' ORDER BY ((w >> 7) & 255)::VARCHAR) AS palette, count(DISTINCT (w >> 7) & 255) AS n FROM word GROUP BY ALL")
def exponent_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _groups(spark, sf_dir, ("exponents",)).groupBy("label", "page_id").agg(F.array_distinct(F.flatten(F.collect_list("exponents"))).alias("e"))
    return found.select("label", "page_id", F.array_join(F.array_sort(F.col("e").cast("array<string>")), ",").alias("palette"), F.size("e").cast("long").alias("n"))


@query(
    "stream_descriptors",
    f"""WITH {P.SRC}, per AS (SELECT label, token // 32 AS page_id FROM src GROUP BY ALL), s AS (SELECT label, count(*) AS page_count FROM per GROUP BY ALL)
    SELECT label, (sum(page_count) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) - page_count)::BIGINT AS first_page, page_count, 0 AS breaks FROM s""",
)
def stream_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.descriptors(G.tokens(_vectors(spark, sf_dir)).select("label", "page_id").distinct())


CONTAINER = f"""{P.PAGES}, ordered AS (SELECT label, page_id, refinement_bytes, (sum(refinement_bytes) OVER (PARTITION BY label ORDER BY page_id ROWS UNBOUNDED PRECEDING))::BIGINT AS ends FROM page),
manifest AS (SELECT label, sum(refinement_bytes)::BIGINT AS arena, count(*) AS pages, '{{"page_offsets":[0,' || string_agg(ends::VARCHAR, ',' ORDER BY page_id) || '],"stream":' || label::VARCHAR || '}}' AS json FROM ordered GROUP BY label)"""


@query("container_sizes", f"WITH {CONTAINER} SELECT label, pages, json AS manifest, (16 + strlen(json) + 7) // 8 * 8 AS head_bytes, (16 + strlen(json) + 7) // 8 * 8 + arena AS container_bytes FROM manifest")
def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(_pages(spark, sf_dir)).select("label", "pages", "manifest", "head_bytes", (F.col("head_bytes") + F.col("arena")).alias("container_bytes"))


def _containers(pages: DataFrame) -> DataFrame:
    """Per stream its manifest with the ends of its pages, from running sums, and sums of its pages."""
    ends = F.sum("refinement_bytes").over(Window.partitionBy("label").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0))
    sums = [F.sum(c).alias(c) for c in ("refinement_bytes", "metadata_bytes", "shared_bytes")]
    by = pages.withColumn("ends", ends).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("page_id", "ends"))).alias("p"), F.sum("refinement_bytes").alias("arena"), F.count("*").alias("pages"), *sums)
    manifest = F.concat(F.lit('{"page_offsets":[0,'), F.array_join(F.transform("p", lambda x: x["ends"].cast("string")), ","), F.lit('],"stream":'), F.col("label").cast("string"), F.lit("}"))
    return by.withColumn("manifest", manifest).withColumn("head_bytes", W.round_up(F.octet_length("manifest") + 16, 8))


@query(
    "container_totals",
    f"""WITH {CONTAINER}, c AS (SELECT sum((16 + strlen(json) + 7) // 8 * 8)::BIGINT AS head FROM manifest)
    SELECT sum(refinement_bytes)::BIGINT AS refinement_page_bytes, any_value(c.head) AS container_metadata_bytes, (sum(refinement_bytes) + any_value(c.head))::BIGINT AS refinement_bytes,
    (sum(metadata_bytes) + any_value(c.head))::BIGINT AS metadata_bytes, (sum(shared_bytes) + any_value(c.head))::BIGINT AS shared_bytes FROM page, c""",
)
def container_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _containers(_pages(spark, sf_dir)).agg(F.sum("head_bytes").alias("head"), *[F.sum(c).alias(c) for c in ("refinement_bytes", "metadata_bytes", "shared_bytes")])
    h = F.col("head")
    return totals.select(F.col("refinement_bytes").alias("refinement_page_bytes"), h.alias("container_metadata_bytes"), *[(F.col(c) + h).alias(c) for c in ("refinement_bytes", "metadata_bytes", "shared_bytes")])


@query(
    "page_invariants",
    f"""WITH {P.PAGES} SELECT count(*) AS pages, count(*) FILTER (shared_bytes <> q_bytes + scales_biases_bytes + refinement_bytes) AS shared_broken, count(*) FILTER (refinement_bytes <> refinement_payload_bytes + metadata_bytes) AS refinement_broken,
    count(*) FILTER (raw_bytes <> 2 * "values") AS raw_broken, count(*) FILTER (mode0 + mode1 + mode2 <> "values" // 64) AS mode_broken, count(*) FILTER ("values" % 64 <> 0 OR "values" < 64 OR "values" > 4096) AS contract_broken, count(DISTINCT label) = 10 AS all_streams FROM page""",
)
def page_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _pages(spark, sf_dir).agg(
        F.count("*").alias("pages"), F.count_if(c("shared_bytes") != c("q_bytes") + c("scales_biases_bytes") + c("refinement_bytes")).alias("shared_broken"), F.count_if(c("refinement_bytes") != c("refinement_payload_bytes") + c("metadata_bytes")).alias("refinement_broken"),
        F.count_if(c("raw_bytes") != 2 * c("values")).alias("raw_broken"), F.count_if(c("mode0") + c("mode1") + c("mode2") != c("values") / 64).alias("mode_broken"), F.count_if((c("values") % 64 != 0) | ~c("values").between(64, 4096)).alias("contract_broken"), (F.count_distinct("label") == 10).alias("all_streams"),
    )


@query(
    "pages_with_sides",
    f"""WITH {P.GROUPS} SELECT label, (token // 32)::BIGINT AS page_id, count(DISTINCT vec_id) AS groups, sum(w)::BIGINT AS word_sum, sum(q)::BIGINT AS code_sum, sum(DISTINCT (token * 65536 + scale_w)::BIGINT)::BIGINT AS scale_sum FROM quant GROUP BY ALL""",
)
def pages_with_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _groups(spark, sf_dir, ("w", "q", "scale_w"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    key = ["label", "page_id", "token"]
    words = found.select(*key, total("w").alias("ws"))
    sides = found.select(*key, total("q").alias("qs"), "scale_w")
    return words.join(sides, key).groupBy("label", "page_id").agg(F.count("*").alias("groups"), F.sum("ws").alias("word_sum"), F.sum("qs").alias("code_sum"), F.sum(F.col("token") * 65536 + F.col("scale_w")).alias("scale_sum"))


@query(
    "abi_and_allocation",
    f"""WITH {P.PAGES} SELECT head, count(DISTINCT CASE WHEN label % 4 = 3 AND page_id % 2 = 1 THEN 'affine-4-32' ELSE 'affine-4-64' END) = 1 AS one_layout, sum(raw_bytes)::BIGINT AS raw_allocated, sum(q_bytes + scales_biases_bytes)::BIGINT AS native_allocated, bool_and("values" <= 4096) AS all_fit, bool_or("values" < 2048) AS any_short FROM page GROUP BY head""",
)
def abi_and_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages of some streams are said to have another layout, which their heads must show."""
    pages = _pages(spark, sf_dir).withColumn("layout", F.when((F.col("label") % 4 == 3) & (F.col("page_id") % 2 == 1), "affine-4-32").otherwise("affine-4-64"))
    return pages.groupBy("head").agg((F.count_distinct("layout") == 1).alias("one_layout"), F.sum("raw_bytes").alias("raw_allocated"), F.sum(F.col("q_bytes") + F.col("scales_biases_bytes")).alias("native_allocated"), F.bool_and(F.col("values") <= 4096).alias("all_fit"), F.bool_or(F.col("values") < 2048).alias("any_short"))


TAIL = "2*28*8*128*2"


def _aligned(x: str) -> str:
    return f"(({x}) + 255) // 256 * 256"


@query(
    "tail_reservations",
    f"""SELECT p::BIGINT AS prompt, o::BIGINT AS output, ({TAIL} * p)::BIGINT AS payload, ({TAIL} * o)::BIGINT AS exact_bytes, ({TAIL} * 9)::BIGINT AS candidate_bytes, ({_aligned('p + o + 9')} - {_aligned('p')})::BIGINT AS extra_tokens,
    ({TAIL} * ({_aligned('p + o + 9')} - {_aligned('p')}) * 36 // 128)::BIGINT AS draft_bytes, ({TAIL} * o + {TAIL} * 9 + {TAIL} * ({_aligned('p + o + 9')} - {_aligned('p')}) * 36 // 128)::BIGINT AS shared_tail_bytes, ({TAIL} * o)::BIGINT AS raw_tail_bytes
    FROM (SELECT unnest([0, 1, 255, 256, 512, 2048, 16384]) AS p), (SELECT unnest([0, 256]) AS o)""",
)
def tail_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p, o) for p in (0, 1, 255, 256, 512, 2048, 16384) for o in (0, 256)], "prompt long, output long")
    return rows.withColumn("payload", A.payload_bytes(F.col("prompt"))).withColumns(A.tail_columns(F.col("prompt"), F.col("output"), F.lit(9).cast("long")))


PROMPTS = f"""{P.PAGES}, prompts AS (SELECT label AS prompt, sum(raw_bytes)::BIGINT AS raw_bytes, sum(shared_bytes)::BIGINT AS shared_bytes, sum(metadata_bytes)::BIGINT AS metadata_bytes, sum(palette_bytes)::BIGINT AS palette_bytes, sum(dual_palette_bytes)::BIGINT AS dual_palette_bytes,
  sum(raw_bytes)::BIGINT // 28 AS stage_bytes, 46907392 AS shared_tail_bytes, 29360128 AS raw_tail_bytes FROM page GROUP BY label)"""
_CASES = " UNION ALL ".join(f"SELECT prompt, '{name}' AS scenario, {column} AS resident_bytes, {column} + {n} * stage_bytes + {tail}_tail_bytes AS peak, raw_bytes + raw_tail_bytes AS base FROM prompts" for name, column, n, tail in A.SCENARIOS if "zstd" not in name)


def _prompts(pages: DataFrame) -> DataFrame:
    sums = pages.groupBy(F.col("label").alias("prompt")).agg(*[F.sum(c).alias(c) for c in ("raw_bytes", "shared_bytes", "metadata_bytes", "palette_bytes", "dual_palette_bytes")])
    tail = A.tail_columns(F.lit(512).cast("long"), F.lit(256).cast("long"), F.lit(9).cast("long"))
    return sums.withColumns({"stage_bytes": F.floor(F.col("raw_bytes") / 28), "shared_tail_bytes": tail["shared_tail_bytes"], "raw_tail_bytes": tail["raw_tail_bytes"]})


@query("projected_peaks", f"WITH {PROMPTS}, cases AS ({_CASES}) SELECT prompt, scenario, resident_bytes, peak::BIGINT AS peak_bytes, round(peak / base, 2) AS ratio FROM cases")
def projected_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.projections(_prompts(_pages(spark, sf_dir)), tuple(s for s in A.SCENARIOS if "zstd" not in s[0]))


@query(
    "counterfactuals",
    f"""WITH {PROMPTS}, c AS (SELECT *, shared_bytes + stage_bytes + raw_tail_bytes AS optimistic, raw_bytes + raw_tail_bytes AS raw_projected FROM prompts)
    SELECT min(raw_bytes) AS raw_low, max(raw_bytes) AS raw_high, min(raw_bytes - shared_bytes) AS saving_low, max(raw_bytes - shared_bytes) AS saving_high, round(min(shared_bytes) / 1048576, 2) AS shared_low_mib, max(raw_projected - (optimistic - metadata_bytes))::BIGINT AS headroom,
    bool_and(shared_bytes + 2 * stage_bytes + raw_tail_bytes - metadata_bytes > raw_projected) AS two_stages_lose, bool_or(optimistic > raw_projected) AS any_loses FROM c""",
)
def counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = _prompts(_pages(spark, sf_dir)).withColumns({"optimistic": c("shared_bytes") + c("stage_bytes") + c("raw_tail_bytes"), "raw_projected": c("raw_bytes") + c("raw_tail_bytes")})
    saving = c("raw_bytes") - c("shared_bytes")
    return p.agg(
        F.min("raw_bytes").alias("raw_low"), F.max("raw_bytes").alias("raw_high"), F.min(saving).alias("saving_low"), F.max(saving).alias("saving_high"), F.round(F.min("shared_bytes") / 1048576, 2).alias("shared_low_mib"), F.max(c("raw_projected") - (c("optimistic") - c("metadata_bytes"))).alias("headroom"),
        F.bool_and(c("shared_bytes") + 2 * c("stage_bytes") + c("raw_tail_bytes") - c("metadata_bytes") > c("raw_projected")).alias("two_stages_lose"), F.bool_or(c("optimistic") > c("raw_projected")).alias("any_loses"),
    )


_LEDGER = "VALUES (1, 'q-host', 'codes', 1024, 512), (2, 'q-host', 'mirror', 1024, 512), (3, 'q-gpu', 'mirror', 1024, 512), (4, 'q-gpu', 'mirror', 1024, 512), (5, 'bad', 'codes', 10, 5), (6, 'bad', 'codes', 11, 5)"


@query(
    "byte_ledger",
    f"""WITH e(seq, owner, category, allocated, logical) AS ({_LEDGER}), f AS (SELECT owner, arg_min(category, seq) AS category, min(allocated)::INTEGER AS allocated, min(logical)::INTEGER AS logical, min(allocated) <> max(allocated) OR min(logical) <> max(logical) AS conflict FROM e GROUP BY owner)
    SELECT f.owner, f.category, f.allocated, f.logical, coalesce((SELECT string_agg(DISTINCT e.category, ',' ORDER BY e.category) FROM e WHERE e.owner = f.owner AND e.category <> f.category), '') AS aliases, conflict FROM f""",
)
def byte_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ledger(spark.sql(f"SELECT * FROM {_LEDGER} AS e(seq, owner, category, allocated, logical)"))


@query(
    "ledger_categories",
    f"""WITH e(seq, owner, category, allocated, logical) AS ({_LEDGER}), f AS (SELECT owner, arg_min(category, seq) AS category, min(allocated) AS allocated, min(logical) AS logical FROM e GROUP BY owner HAVING min(allocated) = max(allocated))
    SELECT category, sum(allocated)::BIGINT AS allocated, sum(logical)::BIGINT AS logical FROM f GROUP BY ROLLUP (category)""",
)
def ledger_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ledger(spark, sf_dir).where("NOT conflict").rollup("category").agg(F.sum("allocated").alias("allocated"), F.sum("logical").alias("logical"))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(page_rows(_groups(spark, sf_dir, ("scale_w", "bias_w", "w", "q", "predicted"))))


@query("codec_sizes", f"WITH {P.PAGES} SELECT label, page_id, \"values\"::INTEGER AS n_values, refinement_bytes::INTEGER AS refinement_bytes, palette_bytes::INTEGER AS palette_bytes, true AS exact FROM page")
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the codecs really write, held against the sizes by formula."""
    return _blobs(spark, sf_dir).select("label", "page_id", "n_values", F.length("refinement").alias("refinement_bytes"), F.length("palette").alias("palette_bytes"), "exact")


@query("compressed_pages")
def compressed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes under the compressing codecs, and what they come to with the quantised form beside them."""
    side = F.col("n_values") / 64 * 36
    return _blobs(spark, sf_dir).select("label", "page_id", F.length("fields").alias("field_bytes"), F.length("xor").alias("xor_bytes"), (side + F.length("fields")).cast("long").alias("dual_field_bytes"), "exact")


@query("stream_containers")
def stream_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(_blobs(spark, sf_dir)).select("label", "pages", F.length("container").alias("container_bytes"), "side_sha256", "exact")


@query("compressed_projections")
def compressed_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projections that rest on compressed sizes."""
    sizes = _blobs(spark, sf_dir).groupBy(F.col("label").alias("prompt")).agg(F.sum(F.length("fields")).alias("zstd_bytes"), F.sum(F.length("fields") + F.col("n_values") / 64 * 36).cast("long").alias("dual_zstd_bytes"))
    return A.projections(_prompts(_pages(spark, sf_dir)).join(sizes, "prompt"), tuple(s for s in A.SCENARIOS if "zstd" in s[0]))
