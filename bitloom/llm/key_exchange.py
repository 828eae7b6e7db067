"""Which keys occur more than once in a corpus, found in packed form.

Documents lie in blocks. Each block sends its distinct keys, packed as bytes, to hash buckets; a bucket tells each block which of
its keys occur elsewhere too, or twice in the block. A key that millions of documents share is sent once by each
block, so none is hot; a block's and a bucket's bytes are bounded by the numbers of blocks and buckets, which grow with
the corpus. Rows depend on keys alone, so a lost task may be done again, whatever the order of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.tables import arrow_schema, record_batch, release

BLOCK_BYTES = 8 << 20
KEYS = "bucket int, block int, keys binary, often binary"
LIVE = "block int, live binary"
#: Keys are pairs of unsigned 64-bit numbers, or single ones.
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def blocks_for(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-n_bytes // block_bytes))


def ranked(keys: np.ndarray) -> np.ndarray:
    """The order of keys. Pairs are sorted by their first half; both halves are compared only where the first isn't enough."""
    if keys.dtype != PAIR:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys["a"], kind="stable")
    a, b = keys["a"][order], keys["b"][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((keys["b"], keys["a"]))
    return order


def alike(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, which equal the one before."""
    if keys.dtype != PAIR:
        return keys[1:] == keys[:-1]
    return (keys["a"][1:] == keys["a"][:-1]) & (keys["b"][1:] == keys["b"][:-1])


def packed_keys(block: int, keys: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for each bucket: the block's distinct keys and which of them it has more than once."""
    if not len(keys):
        return []
    keys = keys[ranked(keys)]
    firsts = np.flatnonzero(np.concatenate([[True], ~alike(keys)]))
    distinct, counts = keys[firsts], np.diff(firsts, append=len(keys))
    lead = distinct["a"] if distinct.dtype == PAIR else distinct
    bucket = ((lead >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for k in range(buckets):
        at = order[edges[k] : edges[k + 1]]
        if len(at):
            out.append((k, block, distinct[at].tobytes(), np.packbits(counts[at] > 1).tobytes()))
    return out


def repeated(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """From packed_keys() rows: per block, its keys that occur more than once anywhere, packed and in parts."""
    schema = arrow_schema(LIVE)

    def bucket(found: pa.Table) -> pa.Table:
        names = found.column("block").to_pylist()
        parts = [np.frombuffer(x.as_buffer(), kind) for x in found.column("keys")]
        often = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool) for x, p in zip(found.column("often"), parts, strict=True)]
        keys = np.concatenate(parts)
        order = ranked(keys)
        live = np.zeros(len(keys), bool)
        same = alike(keys[order])
        live[order[1:][same]] = True
        live[order[:-1][same]] = True
        live |= np.concatenate(often)
        ends = np.cumsum([len(p) for p in parts])
        out = [(name, part[live[end - len(part) : end]].tobytes()) for name, part, end in zip(names, parts, ends, strict=True)]
        out = [x for x in out if x[1]]
        return pa.Table.from_batches([record_batch(out, schema)] if out else [], schema)

    return rows.groupBy("bucket").applyInArrow(bucket, LIVE)


def contains(live: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are in `live`, which is sorted."""
    if not len(live):
        return np.zeros(len(keys), bool)
    if live.dtype != PAIR:
        return live[np.minimum(np.searchsorted(live, keys), len(live) - 1)] == keys
    first = np.ascontiguousarray(live["a"])
    at, found = np.searchsorted(first, keys["a"]), np.zeros(len(keys), bool)
    while True:  # almost always once: first halves hardly ever agree alone
        near = np.minimum(at, len(live) - 1)
        same = (at < len(live)) & (first[near] == keys["a"])
        found |= same & (live["b"][near] == keys["b"])
        if not (same & ~found).any():
            return found
        at = at + 1


def opened(table: pa.Table, kind: np.dtype) -> np.ndarray:
    """The sorted keys of one block's live rows."""
    if not table.num_rows:
        return np.zeros(0, kind)
    keys = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("live")])
    return keys[ranked(keys)]


#: Rows alike in all columns go to a block from so many tasks, and so many from each task; the others to other blocks.
TASKS, COPIES = 256, 16


def in_blocks(docs: DataFrame, n_blocks: int, text: str = "text") -> DataFrame:
    """docs with the number of a block, by the hash of the columns `key` and `text`, and with the text as packed bytes, of which an exchange has less to write.

    Rows that are alike in both spread over blocks by task and by how many a task has had before, which is the same for them in any order.
    """
    at, names = docs.columns.index(text), [*docs.columns, "block"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema} | {text: "binary", "block": "int"}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pack, seen, task = zstandard.ZstdCompressor(level=1), {}, TaskContext.get().partitionId() // TASKS
        for batch in batches:
            blocks = []
            for h in batch.column(batch.num_columns - 1).to_pylist():
                seen[h] = copies = seen.get(h, -1) + 1
                blocks.append((h + (task << 20) * 0x9E3779B1 + copies // COPIES * 0x85EBCA77) % n_blocks if copies >= COPIES or task else h % n_blocks)
            packed = [None if t is None else pack.compress(t.encode()) for t in batch.column(at).to_pylist()]
            parts = [*batch.columns[:-1], pa.array(blocks, pa.int32())]
            parts[at] = pa.array(packed, pa.binary())
            yield pa.RecordBatch.from_arrays(parts, schema=schema)

    return docs.withColumn("block", F.xxhash64("key", text)).mapInArrow(run, ddl)


def unpacked(column: pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an in_blocks() column."""
    pack = zstandard.ZstdDecompressor()
    return [None if x is None else pack.decompress(x) for x in column.to_pylist()]


def in_order(own: pa.Table) -> pa.Table:
    """A block's rows by id, nulls last, and packed text: in one order, whatever order they came in."""
    key, text = own.column("key").to_pylist(), own.column("text").to_pylist()
    return own.take(sorted(range(len(key)), key=lambda k: (key[k] is None, key[k] or 0, text[k] or b"", text[k] is None)))


def per_block(docs: DataFrame, live: DataFrame | None, each: Callable[[int, pa.Table, pa.Table | None], list[tuple]], schema: str) -> DataFrame:
    """each(block, its documents, its live rows) for every block that has documents."""
    kinds = arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.Table:
        release()
        return pa.Table.from_batches([record_batch(rows, kinds)] if rows else [], kinds)

    if live is None:
        return docs.groupBy("block").applyInArrow(lambda own: table(each(own.column("block")[0].as_py(), own, None)), schema)

    def both(own: pa.Table, told: pa.Table) -> pa.Table:
        return table(each(own.column("block")[0].as_py(), own, told) if own.num_rows else [])

    return docs.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(both, schema)
