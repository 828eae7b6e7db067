"""Media columns: texts as lossless grey images in a binary column, and perceptual hashes of the images.

A payload becomes a PNG file of 8-bit grey samples, 64 to a row. The reader goes through the chunks, tests
each checksum, inflates the data and undoes the row filters with numpy, those that need neighbours to the left and above by diagonals. The feature is the sign pattern of the
lowest 8 x 8 cosine-transform coefficients of the image, shrunk to 32 x 32 by area.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.tables import columns, map_rows, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SHRUNK, LOW = 32, 8
_N = np.arange(SHRUNK)
COSINES = np.cos(np.pi * (2 * _N[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SHRUNK))


class BadImage(ValueError):
    """Bytes that aren't a PNG file of the kind read here."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """data with zero bytes up to a positive multiple of width."""
    return data + bytes(-len(data) % width if data else width)


def filtered(rows: np.ndarray, allowed: tuple[int, ...] = (0, 1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the kind of filter and the filtered bytes: of the allowed kinds the one whose bytes, as signed numbers, are least in sum, as is customary."""
    wide = rows.astype(np.int16)
    up = np.zeros_like(wide)
    up[1:] = wide[:-1]
    left, corner = np.zeros_like(wide), np.zeros_like(wide)
    left[:, 1:], corner[:, 1:] = wide[:, :-1], up[:, :-1]
    guess = (lambda: 0, lambda: left, lambda: up, lambda: (left + up) >> 1, lambda: _nearest(left, up, corner))
    made = np.stack([(wide - guess[k]()).astype(np.uint8) for k in allowed])
    best = np.abs(made.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    return np.array(allowed, np.uint8)[best], made[best, np.arange(len(rows))]


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + up - corner; the first of equals."""
    from_left, from_up, from_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((from_left <= from_up) & (from_left <= from_corner), left, np.where(from_up <= from_corner, up, corner))


#: Rows whose filters are chosen together, and rows gone through by diagonals together: they bound memory.
ROWS, SLOPE = 1 << 14, 256


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1, chunk_bytes: int = 1 << 18, allowed: tuple[int, ...] = (0, 1, 2)) -> bytes:
    """A grey PNG of the payload, whose length is a positive multiple of width, with a filter of the allowed kinds chosen for each row. By default those that are undone by sums."""
    if not payload or len(payload) % width:
        raise ValueError(f"{len(payload)} bytes are no whole rows of {width}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    for k in range(0, len(rows), ROWS):
        first = max(0, k - 1)  # a filter looks at the row above
        kinds, made = filtered(rows[first : k + ROWS], allowed)
        lines[k : k + ROWS, 0], lines[k : k + ROWS, 1:] = kinds[k - first :], made[k - first :]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[k : k + chunk_bytes]) for k in range(0, len(packed), chunk_bytes))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, rows by columns; BadImage if a chunk, checksum or length is wrong."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            raise BadImage("cut chunk")
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise BadImage(f"wrong checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadImage(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not a whole 8-bit grey image")
    width, height = head[:2]
    try:
        flat = zlib.decompress(b"".join(parts))
    except zlib.error as error:
        raise BadImage(str(error)) from error
    if len(flat) != height * (width + 1):
        raise BadImage("wrong number of samples")
    lines = np.frombuffer(flat, np.uint8).reshape(height, width + 1)
    return unfiltered(lines[:, 0], lines[:, 1:])


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples from filtered rows; one byte is one sample. Rows that look at none above, or at whole ones alone, are sums; the others need their neighbours to the left and above
    first, so runs of them are gone through by diagonals, each of which is one array step."""
    if (kinds > 4).any():
        raise BadImage(f"unknown filter {int(kinds.max())}")
    out = lines.copy()
    left = kinds == 1
    out[left] = np.cumsum(lines[left], axis=1, dtype=np.uint64).astype(np.uint8)
    edges = np.flatnonzero(np.diff(np.where(kinds < 2, 0, np.where(kinds == 2, 1, 2)), prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        above = out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kinds[a] == 2:
            out[a:b] = np.cumsum(np.concatenate([above[None], lines[a:b]]), axis=0, dtype=np.uint64)[1:].astype(np.uint8)
        elif kinds[a] > 2:
            for k in range(a, b, SLOPE):
                out[k : min(b, k + SLOPE)] = above = _by_diagonals(kinds[k : min(b, k + SLOPE)], lines[k : min(b, k + SLOPE)], above)
                above = above[-1]
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of average and Paeth rows. Sample x of row y lies on diagonal x + y; its neighbours lie on the two before."""
    height, width = lines.shape
    slope = np.zeros((height, height + width - 1), np.int16)  # sample x of row y at column x + y
    x, y = np.arange(width), np.arange(height)[:, None]
    slope[y, x + y] = lines
    value = np.zeros((height + 1, height + width + 1), np.int16)  # one row and one column more before the first; row y at column x + y + 2
    value[0, 1 : width + 1] = above
    mean = (kinds == 3)[:, None]
    for d in range(height + width - 1):
        low, high = max(0, d - width + 1), min(height, d + 1)
        rows = np.arange(low, high)
        start = (d - rows) == 0
        own_left = np.where(start, 0, value[rows + 1, d + 1])
        up = value[rows, d + 1]
        corner = np.where(start, 0, value[rows, d])
        guess = np.where(mean[rows, 0], (own_left + up) >> 1, _nearest(own_left, up, corner))
        value[rows + 1, d + 2] = (slope[rows, d] + guess) & 255
    return value[y + 1, x + y + 2].astype(np.uint8)


def _shrunk(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over `size` equal parts of an axis, whose edges may cut samples."""
    n = image.shape[axis]
    sums = np.concatenate([np.zeros_like(image.take([0], axis)), np.cumsum(image, axis)], axis)
    edges = np.arange(size + 1) * (n / size)
    low = np.minimum(edges.astype(np.int64), n - 1)
    part = edges - low
    shape = [1, 1]
    shape[axis] = -1
    at = sums.take(low, axis) * (1 - part).reshape(shape) + sums.take(low + 1, axis) * part.reshape(shape)
    return np.diff(at, axis=axis) / (n / size)


def cosine_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 64 lowest coefficients lie above their median (the mean level is left out of the median)."""
    small = _shrunk(_shrunk(image.astype(np.float64), SHRUNK, 0), SHRUNK, 1)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, media (the PNG file). Null texts count as empty; repeated rows give repeated rows."""

    def make():
        def each(key: int | None, text: str | None) -> Iterator[tuple]:
            data = (text or "").encode()
            yield key, len(data), encode_png(padded(data, width), width)

        return each

    return map_rows(columns(docs, key=f"{id_col}:long", text=text_col), make, "doc_id long, n_bytes long, media binary", 64)


def features(found: DataFrame) -> DataFrame:
    """What reading back the media column shows: sizes, digests and the cosine hash. Damaged media raise BadImage; null media count as no row's."""

    def make():
        def each(key: int | None, n_bytes: int | None, data: bytes | None) -> Iterator[tuple]:
            if data is None:
                return
            image = decode_png(data)
            payload = image.tobytes()
            yield key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

        return each

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(found.select("doc_id", "n_bytes", "media"), make, schema, 64)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(media(table(spark, sf_dir, "documents")))
