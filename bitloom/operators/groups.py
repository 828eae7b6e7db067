"""Groups of 64 values: quantisation, value intervals, exact membership and choice of mode, as array kernels over Arrow batches.

A group is one row: narrow, without a shuffle. Kernels work on (groups, 64) arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bitloom.functions.words import bit_lengths, floats_of_words, keys_of_words, supported, supported_float, words_of_floats, words_of_keys

# Geometry and the numbers of the modes.
GROUP, PAGE_TOKENS, RESTART_GROUPS = 64, 32, 2
TIGHT, WIDE, LITERAL = 0, 1, 2
LITERAL_BITS = 16 * GROUP


@dataclass
class Quantised:
    scale: np.ndarray  # words, by group
    bias: np.ndarray
    q: np.ndarray  # codes 0..15, by group and lane


def quantise(words: np.ndarray) -> Quantised:
    """Affine four-bit codes. The bias is the extreme of larger magnitude, the scale a fifteenth of the way to the other; a zero or unusable scale gives codes of 0."""
    with np.errstate(all="ignore"):
        x = floats_of_words(words).astype(np.float64)
        low, high = x.min(1), x.max(1)
        bias = np.where(np.abs(high) >= np.abs(low), high, low)
        other = np.where(np.abs(high) >= np.abs(low), low, high)
        scale = words_of_floats(((other - bias) / 15).astype(np.float32))
        s = floats_of_words(scale).astype(np.float64)[:, None]
        q = np.rint((x - bias[:, None]) / s)
        q = np.where((s != 0) & np.isfinite(q), np.clip(q, 0, 15), 0).astype(np.int32)
    return Quantised(scale.astype(np.int32), words_of_floats(bias.astype(np.float32)).astype(np.int32), q)


def predicted(group: Quantised) -> np.ndarray:
    """Dequantised words, with a rounding after each step."""
    with np.errstate(all="ignore"):
        s, b = floats_of_words(group.scale)[:, None], floats_of_words(group.bias)[:, None]
        return words_of_floats(group.q.astype(np.float32) * s + b).astype(np.int32)


def intervals(q: np.ndarray, scale: np.ndarray, bias: np.ndarray, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper order key, width in bits, and whether the interval is safe, for arrays that broadcast. mode: TIGHT or WIDE."""
    if mode not in (TIGHT, WIDE):
        raise ValueError("intervals are tight or wide")
    s, b = floats_of_words(scale), floats_of_words(bias)
    with np.errstate(all="ignore"):
        product = q.astype(np.float32) * s
        centre = product + b
        radius = np.float32(0.5 if mode == TIGHT else 1) * np.abs(s)
        ends = centre - radius, centre + radius
    safe = supported(scale) & supported(bias) & (s != 0) & (ends[0] <= ends[1])
    for x in (product, centre, radius, *ends):
        safe = safe & supported_float(x)
    rounded = [words_of_floats(x).reshape(x.shape) for x in ends]
    lower, upper = np.maximum(keys_of_words(rounded[0]) - 1, 0), np.minimum(keys_of_words(rounded[1]) + 1, 0xFFFF)
    for w in (*rounded, words_of_keys(lower), words_of_keys(upper)):
        safe = safe & supported(w)
    safe = safe & (lower <= upper)
    return lower, upper, bit_lengths(np.maximum(upper - lower, 0)), safe


@dataclass
class Encoded:
    group: Quantised
    #: by mode: lower keys, upper keys, widths, safety
    bounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: by mode: bits of a group, or -1 where some value lies outside
    bits: list[np.ndarray]
    mode: np.ndarray
    mode_bits: np.ndarray


def encode(words: np.ndarray, group: Quantised | None = None) -> Encoded:
    """Both intervals of every value, and for each group the mode of fewest bits; of equals literal goes before tight, tight before wide."""
    group = group or quantise(words)
    keys, fine = keys_of_words(words), supported(words)
    bounds = [intervals(group.q, group.scale[:, None], group.bias[:, None], m) for m in (TIGHT, WIDE)]
    mode, best, bits = np.full(len(words), LITERAL), np.full(len(words), LITERAL_BITS), []
    for m, (lower, upper, width, safe) in enumerate(bounds):
        member = (fine & safe & (lower <= keys) & (keys <= upper)).all(1)
        own = np.where(member, width.sum(1), -1)
        bits.append(own)
        better = member & (own < best)
        mode, best = np.where(better, m, mode), np.where(better, own, best)
    return Encoded(group, bounds, bits, mode, best)


def pack_codes(q: np.ndarray) -> np.ndarray:
    """Eight codes to a 32-bit word, the first in the lowest bits."""
    return (q.reshape(len(q), -1, 8).astype(np.uint32) << (4 * np.arange(8, dtype=np.uint32))).sum(2, dtype=np.uint32)


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    return ((packed[:, :, None] >> (4 * np.arange(8, dtype=np.uint32))) & 15).reshape(len(packed), -1).astype(np.int32)


def numbered(df: DataFrame, key: str, order: str, to: str, width: int = 4096) -> DataFrame:
    """df with the row's number, from 0, among the rows of its key by `order`, an integer. Counts of stretches of `width` values of the order make the
    numbers, so a key with most of the rows is numbered by many tasks."""
    cut = df.withColumn("stretch_", F.floor(F.col(order) / width))
    counts = cut.groupBy(key, "stretch_").agg(F.count("*").alias("n_"))
    before = counts.select(key, "stretch_", (F.sum("n_").over(Window.partitionBy(key).orderBy("stretch_")) - F.col("n_")).alias("before_"))
    local = F.row_number().over(Window.partitionBy(key, "stretch_").orderBy(order)) - 1
    return cut.withColumn(to, local).join(before, [key, "stretch_"]).withColumn(to, F.col(to) + F.col("before_")).drop("stretch_", "before_")


GROUPS = (
    "scale_w int, bias_w int, tight_bits int, wide_bits int, mode int, mode_bits int, exponents array<int>, "
    "w array<int>, q array<int>, predicted array<int>, packed array<bigint>, "
    "tight_lower array<int>, tight_upper array<int>, tight_width array<int>, tight_safe array<boolean>, wide_lower array<int>, wide_upper array<int>, wide_width array<int>, wide_safe array<boolean>"
)
SMALL = tuple(f.split()[0] for f in GROUPS.split(", ")[:7])


def encoded_groups(df: DataFrame, values: str = "embedding", columns: tuple[str, ...] = SMALL) -> DataFrame:
    """df's other columns and the wanted columns of GROUPS for each row's 64 floats. Rows whose values are null, or not 64 without nulls, are an error."""
    kept = [f for f in df.schema.fields if f.name != values]
    every = StructType.fromDDL(GROUPS)
    schema = StructType(kept + [every[c] for c in columns])
    arrow = to_arrow_schema(schema)

    def nested(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        n, lanes = x.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * lanes + 1, lanes), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind.value_type)).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(values)
            flat = column.flatten()
            if column.null_count or flat.null_count or len(flat) != GROUP * len(column) or len(column) and (np.diff(column.offsets.to_numpy()) != GROUP).any():
                raise ValueError(f"{values} must hold {GROUP} values in every row")
            words = words_of_floats(flat.to_numpy(zero_copy_only=False)).reshape(-1, GROUP).astype(np.int32)
            found = encode(words)
            out = {"scale_w": found.group.scale, "bias_w": found.group.bias, "tight_bits": found.bits[0], "wide_bits": found.bits[1], "mode": found.mode, "mode_bits": found.mode_bits}
            arrays = {"w": lambda: words, "q": lambda: found.group.q, "predicted": lambda: predicted(found.group), "packed": lambda: pack_codes(found.group.q).astype(np.int64)}
            for m, name in enumerate(("tight", "wide")):
                for k, part in enumerate(("lower", "upper", "width", "safe")):
                    arrays[f"{name}_{part}"] = lambda m=m, k=k: found.bounds[m][k]
            made = []
            for c in columns:
                kind = arrow.field(c).type
                if c in out:
                    made.append(pa.array(out[c], kind))
                elif c == "exponents":
                    made.append(pa.array([np.unique(e).tolist() for e in (words >> 7) & 0xFF], kind))
                else:
                    made.append(nested(arrays[c](), kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], schema=arrow)

    return df.mapInArrow(run, schema)


def tokens(embeddings: DataFrame) -> DataFrame:
    """Streams, tokens and pages of a table of vectors: stream is the label, tokens are its vectors by id, 32 to a page; even vectors are keys, odd ones values."""
    found = numbered(embeddings.select("vec_id", "label", "embedding"), "label", "vec_id", "token")
    return found.withColumns({"token": F.col("token").cast("long"), "page_id": F.floor(F.col("token") / PAGE_TOKENS).cast("long"), "role": F.when(F.col("label") % 2 == 0, "K").otherwise("V"), "head": F.floor(F.col("label") / 2).cast("int")})


def pages(groups: DataFrame) -> DataFrame:
    """Byte metrics of each page from its groups: one shuffle on the page's key; a page has at most 32 groups."""
    by_page = groups.groupBy("label", "role", "head", "page_id").agg(
        F.array_sort(F.collect_list(F.struct("token", "mode_bits"))).alias("g"),
        F.count("*").alias("n"),
        *[F.count_if(F.col("mode") == m).alias(f"mode{m}") for m in (TIGHT, WIDE, LITERAL)],
        F.size(F.array_distinct(F.flatten(F.collect_list("exponents")))).cast("long").alias("palette"),
    )
    n = F.col("n")
    words = "aggregate(sequence(0, cast(n - 1 as int), 2), 0L, (s, i) -> s + (g[i].mode_bits + coalesce(try_element_at(g, i + 2).mode_bits, 0) + 31) div 32)"
    with_sizes = by_page.withColumns({"restarts": F.ceil(n / RESTART_GROUPS).cast("long"), "payload_words": F.expr(words), "width": F.expr("if(palette = 1, 0, length(bin(palette - 1)))").cast("long")})
    metadata = F.lit(32) + F.ceil(F.ceil(n / 4) / 4) * 4 + 4 * (F.col("restarts") + 1) + 4
    candidate = F.ceil((F.col("palette") + 64 * n + F.ceil(64 * n * F.col("width") / 8)) / 4) * 4
    out = with_sizes.select(
        "label", "role", "head", "page_id", (64 * n).alias("values"), (128 * n).alias("raw_bytes"), (32 * n).alias("q_bytes"), (4 * n).alias("scales_biases_bytes"),
        (4 * F.col("payload_words")).alias("refinement_payload_bytes"), metadata.cast("long").alias("metadata_bytes"), (128 * F.col("mode2")).alias("literal_bytes"),
        (F.lit(20) + F.least(candidate, 128 * n)).cast("long").alias("palette_bytes"), "mode0", "mode1", "mode2",
    )
    return out.withColumn("refinement_bytes", F.col("refinement_payload_bytes") + F.col("metadata_bytes")).withColumns(
        {"shared_bytes": F.col("q_bytes") + F.col("scales_biases_bytes") + F.col("refinement_bytes"), "dual_palette_bytes": F.col("q_bytes") + F.col("scales_biases_bytes") + F.col("palette_bytes")}
    )
