"""Pieces of the DuckDB statements that the queries are checked against."""

from __future__ import annotations


def rne(x: str) -> str:
    """The word of a float, rounded half to even on its bits."""
    bits = f"((({x})::FLOAT::BIT::INTEGER)::BIGINT & 4294967295)"
    return f"((({bits} + 32767 + (({bits} >> 16) & 1)) >> 16) & 65535)::INTEGER"


def f32(w: str) -> str:
    return f"((CASE WHEN ({w}) >= 32768 THEN ({w})::BIGINT - 65536 ELSE ({w})::BIGINT END) * 65536)::INTEGER::BIT::FLOAT"


def order_key(w: str) -> str:
    return f"(CASE WHEN (({w}) & 32768) <> 0 THEN 65535 - ({w}) ELSE ({w}) + 32768 END)"


def from_key(k: str) -> str:
    return f"(CASE WHEN (({k}) & 32768) <> 0 THEN ({k}) - 32768 ELSE 65535 - ({k}) END)"


def ok(w: str) -> str:
    return f"((({w}) & 32640) <> 32640 AND NOT ((({w}) & 32640) = 0 AND (({w}) & 127) <> 0))"


def float_ok(x: str) -> str:
    return f"(isfinite({x}) AND (({x}) = 0 OR abs({x}) >= 1.17549435e-38::FLOAT))"


SRC = "src AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS token FROM embeddings)"
LANES = f"""{SRC},
lane0 AS (SELECT vec_id, label, token, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS lane FROM src),
word AS (SELECT vec_id, label, token, lane, {rne('v')} AS w FROM lane0),
wide AS (SELECT *, {f32('w')} AS f FROM word)"""
GROUPS = f"""{LANES},
ext AS (SELECT vec_id, min(f) AS lo, max(f) AS hi FROM wide GROUP BY vec_id),
sel AS (SELECT vec_id, CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END AS b, CASE WHEN abs(hi) >= abs(lo) THEN lo ELSE hi END AS o FROM ext),
side AS (SELECT vec_id, {rne('((o::DOUBLE - b::DOUBLE) / 15)::FLOAT')} AS scale_w, {rne('b')} AS bias_w FROM sel),
quant AS (SELECT wide.*, scale_w, bias_w, {f32('scale_w')} AS s, {f32('bias_w')} AS b,
  CASE WHEN {f32('scale_w')} = 0 THEN 0 ELSE greatest(0, least(15, round_even((f::DOUBLE - {f32('bias_w')}::DOUBLE) / {f32('scale_w')}::DOUBLE, 0)))::INTEGER END AS q
  FROM wide JOIN side USING (vec_id))"""
INTERVALS = f"""{GROUPS},
p0 AS (SELECT *, (q::FLOAT * s)::FLOAT AS product FROM quant),
p1 AS (SELECT *, (product + b)::FLOAT AS centre FROM p0),
p2 AS (SELECT p1.*, mode, ((CASE mode WHEN 0 THEN 0.5 ELSE 1.0 END)::FLOAT * abs(s))::FLOAT AS radius FROM p1, (VALUES (0), (1)) m(mode)),
p3 AS (SELECT *, (centre - radius)::FLOAT AS lf, (centre + radius)::FLOAT AS hf FROM p2),
p4 AS (SELECT *, {rne('lf')} AS lw, {rne('hf')} AS hw FROM p3),
p5 AS (SELECT *, greatest({order_key('lw')} - 1, 0) AS lower_key, least({order_key('hw')} + 1, 65535) AS upper_key FROM p4),
iv AS (SELECT *, (CASE WHEN upper_key <= lower_key THEN 0 ELSE length(bin(upper_key - lower_key)) END)::INTEGER AS width,
  ({ok('scale_w')} AND {ok('bias_w')} AND s <> 0 AND {float_ok('product')} AND {float_ok('centre')} AND {float_ok('radius')} AND {float_ok('lf')} AND {float_ok('hf')} AND lf <= hf
   AND {ok('lw')} AND {ok('hw')} AND {ok(from_key('lower_key'))} AND {ok(from_key('upper_key'))} AND lower_key <= upper_key) AS safe FROM p5)"""
MODES = f"""{INTERVALS},
fit AS (SELECT vec_id, label, token, mode, bool_and({ok('w')} AND safe AND lower_key <= {order_key('w')} AND {order_key('w')} <= upper_key) AS member, sum(width)::BIGINT AS bits FROM iv GROUP BY ALL),
duo AS (SELECT vec_id, label, token, max(CASE WHEN mode = 0 AND member THEN bits ELSE -1 END) AS tight_bits, max(CASE WHEN mode = 1 AND member THEN bits ELSE -1 END) AS wide_bits FROM fit GROUP BY ALL),
pick AS (SELECT *, CASE WHEN tight_bits >= 0 AND tight_bits < 1024 AND (wide_bits < 0 OR tight_bits <= wide_bits) THEN 0 WHEN wide_bits >= 0 AND wide_bits < 1024 THEN 1 ELSE 2 END AS mode FROM duo),
grp AS (SELECT vec_id, label, token, tight_bits::INTEGER AS tight_bits, wide_bits::INTEGER AS wide_bits, mode::INTEGER AS mode, (CASE mode WHEN 0 THEN tight_bits WHEN 1 THEN wide_bits ELSE 1024 END)::INTEGER AS mode_bits FROM pick)"""
PAGES = f"""{MODES},
restart AS (SELECT label, token // 32 AS page_id, (token % 32) // 2 AS r, (sum(mode_bits) + 31)::BIGINT // 32 AS words FROM grp GROUP BY ALL),
pay AS (SELECT label, page_id, sum(words)::BIGINT AS payload_words, count(*) AS restarts FROM restart GROUP BY ALL),
pal AS (SELECT label, token // 32 AS page_id, count(DISTINCT (w >> 7) & 255) AS palette FROM word GROUP BY ALL),
cnt AS (SELECT label, token // 32 AS page_id, count(*) AS n, count(*) FILTER (mode = 0) AS mode0, count(*) FILTER (mode = 1) AS mode1, count(*) FILTER (mode = 2) AS mode2 FROM grp GROUP BY ALL),
pg0 AS (SELECT *, CASE WHEN palette = 1 THEN 0 ELSE length(bin(palette - 1)) END AS width FROM cnt JOIN pay USING (label, page_id) JOIN pal USING (label, page_id)),
pg1 AS (SELECT label, CASE WHEN label % 2 = 0 THEN 'K' ELSE 'V' END AS role, (label // 2)::INTEGER AS head, page_id::BIGINT AS page_id, 64 * n AS "values", 128 * n AS raw_bytes, 32 * n AS q_bytes, 4 * n AS scales_biases_bytes,
  4 * payload_words AS refinement_payload_bytes, 32 + (((n + 3) // 4) + 3) // 4 * 4 + 4 * (restarts + 1) + 4 AS metadata_bytes, 128 * mode2 AS literal_bytes,
  20 + least((palette + 64 * n + (64 * n * width + 7) // 8 + 3) // 4 * 4, 128 * n) AS palette_bytes, mode0, mode1, mode2 FROM pg0),
page AS (SELECT *, refinement_payload_bytes + metadata_bytes AS refinement_bytes, q_bytes + scales_biases_bytes + refinement_payload_bytes + metadata_bytes AS shared_bytes, q_bytes + scales_biases_bytes + palette_bytes AS dual_palette_bytes FROM pg1)"""
