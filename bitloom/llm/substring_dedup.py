"""Substring dedup by difference-cover anchors.

A window of 35 words is removed wherever the same words begin anywhere else. Positions of a document are anchors if, modulo a
period, they lie in a difference cover: for any two positions i and j some step below the period takes both to anchors.
So two equal windows hold, at one step from their starts, equal anchor strings of (window - period + 1) words.
Only anchor strings are hashed and exchanged over the whole corpus; where one recurs, the windows over it are extended to all 35
words, and 128-bit hashes of these windows decide. Both exchanges carry distinct hashes of blocks of documents, so that
copies by the thousand neither pair up nor meet in one task beyond one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.key_exchange import KEYS, PAIR, blocks_for, contains, in_blocks, opened, packed_keys, per_block, repeated, unpacked
from bitloom.llm.tables import columns, scan_bytes, table
from bitloom.llm.word_hashes import Words

WINDOW = 35
# A perfect difference cover, each difference modulo the period once.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit numbers for a few words."""
    return Words([b" ".join(words)]).hashes


def _joined(a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    """Numbers of runs made of a's run and b's behind it. Shifts between the products keep words of a pattern from cancelling out."""
    with np.errstate(over="ignore"):
        out = a >> np.uint64(29)
        out ^= a
        out *= base
        out += b
    out ^= out >> np.uint64(32)
    return out


def rolled(hashes: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, from one row of word hashes: O(log width) array steps, by doubling."""
    base, row = BASES[which], hashes[which]
    if len(row) < width:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    run, size, rest = row, 1, width
    while rest:
        if rest & 1:  # out covers `done` words, then run covers `size` more
            out = run if out is None else _joined(out[: len(row) - done - size + 1], run[done:], base)
            done += size
        rest >>= 1
        if rest:
            run = _joined(run[: len(row) - 2 * size + 1], run[size:], base)
            size *= 2
    return out[: len(row) - width + 1]


def anchors(hashes: np.ndarray, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and the hashes of the words that begin there; nothing for documents shorter than a window."""
    if hashes.shape[1] < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = rolled(hashes, window - period + 1, 0)
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    at = np.flatnonzero(inside[np.arange(len(runs)) % period])
    return at, runs[at]


def candidates(n_words: int, at: np.ndarray, window: int = WINDOW, period: int = PERIOD) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at a step below the period."""
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, np.maximum(at - period + 1, 0), 1)
    np.add.at(marks, at + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[: n_words - window + 1] > 0)


def window_keys(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    out = np.zeros(len(starts), PAIR)
    if len(starts):
        out["a"], out["b"] = rolled(hashes, window, 0)[starts], rolled(hashes, window, 1)[starts]
    return out


def _bytes(own: pa.Table) -> list[bytes]:
    return [t or b"" for t in unpacked(own.column("text"))]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, block_bytes: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, removed (start and end of each stretch of removed words), kept (the other words joined by a space).

    Null and empty texts have no words; equal rows repeat each other; documents shorter than a window lose nothing.
    """
    own = columns(docs, key=f"{id_col}:long", text=text_col)
    n = blocks_for(scan_bytes(own, "text"), *([block_bytes] if block_bytes else []))
    own = in_blocks(own, n)

    def send_anchors(block: int, rows: pa.Table, _: None) -> list[tuple]:
        texts = _bytes(rows)
        words = Words(texts, 1)
        return packed_keys(block, np.concatenate([anchors(words.of(k), window, period, cover)[1] for k in range(len(texts))]), n)

    def send_windows(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        live = opened(told, np.dtype("<u8"))
        if not len(live):
            return []
        texts = _bytes(rows)
        words, found = Words(texts), []
        for k in range(len(texts)):
            hashes = words.of(k)
            at, keys = anchors(hashes, window, period, cover)
            at = at[contains(live, keys)]
            if len(at):
                found.append(window_keys(hashes, candidates(hashes.shape[1], at, window, period), window))
        return packed_keys(block, np.concatenate(found), n) if found else []

    def cut(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        live = opened(told, PAIR)
        texts = _bytes(rows)
        hashed = Words(texts) if len(live) else None
        out = []
        for k, (key, text) in enumerate(zip(rows.column("key").to_pylist(), texts, strict=True)):
            words = text.split()
            edges = np.zeros((0, 2), np.int64)
            if hashed is not None and len(words) >= window:
                starts = np.arange(len(words) - window + 1)
                starts = starts[contains(live, window_keys(hashed.of(k), starts, window))]
                if len(starts):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                    lost = np.cumsum(gone)[:-1] > 0
                    edges = np.flatnonzero(np.diff(lost, prepend=False, append=False)).reshape(-1, 2)
                    words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            out.append((key, len(words) + int((edges[:, 1] - edges[:, 0]).sum()), [{"start": a, "end": b} for a, b in edges.tolist()], b" ".join(words).decode()))
        return out

    live_anchors = repeated(per_block(own, None, send_anchors, KEYS), np.dtype("<u8"))
    live_windows = repeated(per_block(own, live_anchors, send_windows, KEYS), PAIR)
    return per_block(own, live_windows, cut, "doc_id long, n_words long, removed array<struct<start: int, end: int>>, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "aggregate(removed, 0L, (n, x) -> n + x.end - x.start) AS n_removed",
        "sha2(kept, 256) AS kept_sha256",
    )
