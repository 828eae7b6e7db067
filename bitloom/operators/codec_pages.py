"""Pages through the byte codecs: each page's at most 32 groups meet in one row, which is encoded, decoded and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bitloom.functions import codecs as C
from bitloom.operators.groups import Quantised

BLOBS = "label int, page_id bigint, n_values int, refinement binary, palette binary, fields binary, xor binary, side_bytes binary, exact boolean"


def page_rows(groups: DataFrame) -> DataFrame:
    """One row for each page with its groups in token order. groups: label, page_id, token, scale_w, bias_w, w, q, predicted."""
    part = F.struct("token", "scale_w", "bias_w", "w", "q", "predicted")
    return groups.groupBy("label", "page_id").agg(F.array_sort(F.collect_list(part)).alias("g")).select(F.col("label").cast("int").alias("label"), "page_id", *[F.col(f"g.{c}").alias(c) for c in ("scale_w", "bias_w", "w", "q", "predicted")])


def coded(pages: DataFrame) -> DataFrame:
    """The four encodings of each page, and whether all decode to its words."""
    schema = to_arrow_schema(StructType.fromDDL(BLOBS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, page, scale, bias, w, q, predicted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side = Quantised(np.array(scale), np.array(bias), np.array(q))
                words, guess = np.array(w).ravel(), np.array(predicted).ravel()
                blobs = C.encode_page(words, side, label, page), C.palette_encode(words), C.fields_encode(words), C.xor_encode(words, guess)
                back = C.decode_page(blobs[0], side, label, page), C.palette_decode(blobs[1]), C.fields_decode(blobs[2]), C.xor_decode(blobs[3], guess)
                packed = side.q.astype(np.uint8).tobytes() + side.scale.astype("<u2").tobytes() + side.bias.astype("<u2").tobytes()
                rows.append((label, page, len(words), *blobs, packed, all((b == words).all() for b in back)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return pages.mapInArrow(run, BLOBS)


def containers(blobs: DataFrame) -> DataFrame:
    """Each stream's pages in one container, with the digest of its side information in page order; read back and compared. A stream is one output value, so it is what a task holds."""

    def box(found: pa.Table) -> pa.Table:
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("page_id", "label", "refinement", "side_bytes")), strict=True))
        label, pages = rows[0][1], [r[2] for r in rows]
        digest = hashlib.sha256(b"".join(r[3] for r in rows)).hexdigest()
        blob = C.pack_container({"side_sha256": digest, "stream": label}, pages)
        manifest, back = C.unpack_container(blob)
        return pa.table({"label": pa.array([label], pa.int32()), "pages": pa.array([len(pages)], pa.int64()), "container": pa.array([blob], pa.binary()), "side_sha256": [digest], "exact": [back == pages and manifest["side_sha256"] == digest]})

    return blobs.groupBy("label").applyInArrow(box, "label int, pages bigint, container binary, side_sha256 string, exact boolean")
