"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words. It is removed if a line before it, by document id and then line number, has a Jaccard similarity of
0.8 or more to it, wherever that line is and whether or not it is removed itself; of equal sets the first stays. Lines without words stay.

Sets are joined by prefix filtering: the words of a line are ordered by rarity, and similar lines share a word among the rarest
few. Rarity is how often a word stands in all documents, counted in a table of fixed size in which words share
places by hash: any common order gives exact results, this one short lists. Lines that share a word of their prefixes pass a length filter, a positional filter (what
stands before and after the word must be enough) and a filter on bits that the words flip, of which no more can differ than words do. A line needs one earlier partner to
go, so the first that passes is verified on whole sets, and the others only if that fails (block_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.block_join import ENTRIES, MOST, SERVED, TOLD, asked_items, first_parcels, first_places, later, others, parcels, posting, prefix_length, proposals, served, told_items, verified
from bitloom.llm.key_exchange import PAIR, blocks_for, in_blocks, in_order, per_block, unpacked
from bitloom.llm.tables import arrow_schema, record_batch, release, table
from bitloom.llm.word_hashes import Words, mixed

#: Places of the table of word counts: 4 MB as levels. It is added up in slices, and in so many tasks' parts first.
PLACES = 1 << 22
SLICES, PARTS = 64, 1024
BLOCK_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max


class Lines:
    """Lines of text, joined by line breaks, as their distinct words: line numbers and hashes, sorted by both."""

    def __init__(self, whole: bytes):
        found = Words([whole], 1)
        owner, hashes = _sorted(found.line, found.hashes[0])
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, bool)
        self.owner, self.hashes = owner[fresh], hashes[fresh]
        #: of each line: number of distinct words, first of them
        self.n = np.bincount(self.owner, minlength=whole.count(b"\n") + 1)
        self.first = np.cumsum(self.n) - self.n

    def keys(self) -> np.ndarray:
        """128 bits for each line's set."""
        out = np.zeros(len(self.n), PAIR)
        for name, by in zip(("a", "b"), (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), strict=True):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes, by))])
            out[name] = sums[self.first + self.n] - sums[self.first]
        return out


def _sorted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by line and hash. A line's number and the upper bits of the hash are one sorting key wherever that is enough."""
    if len(owner) and owner[-1] < 1 << 20:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        sorted_owner, sorted_hashes = owner[order], hashes[order]
        if not ((sorted_owner[1:] == sorted_owner[:-1]) & (sorted_hashes[1:] < sorted_hashes[:-1])).any():
            return sorted_owner, sorted_hashes
    order = np.lexsort((hashes, owner))
    return owner[order], hashes[order]


def _by_rarity(owner: np.ndarray, level: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by owner, level and hash, by one sorting key where the hashes' upper bits are enough."""
    if len(owner) and owner[-1] < 1 << 20:
        key = (owner.astype(np.uint64) << np.uint64(44)) | (level.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28))
        order = np.argsort(key)
        key = key[order]
        if not (key[1:] == key[:-1]).any():
            return order
    return np.lexsort((hashes, level, owner))


def _texts(own: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The texts of a block's rows, and the order of the document of each line."""
    texts = [t or b"" for t in unpacked(own.column("text"))]
    order = np.array([LAST if k is None else k for k in own.column("key").to_pylist()], np.int64)
    return texts, np.repeat(order, [t.count(b"\n") + 1 for t in texts])


def rarity(docs: DataFrame) -> np.ndarray:
    """For each place of the table, a level that grows with how often its words stand in all texts; 0 for once or never. docs: text."""
    parts = "slice int, part int, counts binary"
    schema = arrow_schema(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(PLACES, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                hashes = Words([(t or "").encode() for t in batch.column(0).slice(start, 256).to_pylist()], 1).hashes[0]
                np.add.at(total, (hashes % np.uint64(PLACES)).astype(np.int64), np.uint64(1))
        pack = zstandard.ZstdCompressor(level=1)
        if total.any():
            yield record_batch([(k, TaskContext.get().partitionId() // PARTS, pack.compress(part.tobytes())) for k, part in enumerate(np.split(total, SLICES))], schema)

    def add(found: pa.Table) -> pa.Table:
        pack, total = zstandard.ZstdDecompressor(), np.zeros(PLACES // SLICES, np.uint64)
        for x in found.column("counts"):
            total += np.frombuffer(pack.decompress(x.as_py()), np.uint64)
        return pa.Table.from_batches([record_batch([(found.column("slice")[0].as_py(), found.column("part")[0].as_py(), zstandard.ZstdCompressor(level=1).compress(total.tobytes()))], schema)], schema)

    added = docs.select("text").mapInArrow(count, parts).groupBy("slice", "part").applyInArrow(add, parts).groupBy("slice").applyInArrow(add, parts)
    levels = np.zeros(PLACES, np.uint8)
    for row in added.collect():  # SLICES rows, a few bytes for each place
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.uint64)
        levels[row["slice"] * len(counts) : (row["slice"] + 1) * len(counts)] = np.minimum(255, np.ceil(8 * np.log2(np.maximum(counts, 1))))
    return levels


def postings(found: Lines, items: np.ndarray, order: np.ndarray, levels: np.ndarray, kind: np.dtype, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Records of the prefixes of lines, and the hash each goes by. Words that stand nowhere else are left out. items, order: what the lines are called, and where their documents stand."""
    n, owner, hashes, starts = found.n, found.owner, found.hashes, found.first
    level = levels[(hashes % np.uint64(PLACES)).astype(np.int64)]
    bits, some = np.zeros((len(items), 2), np.uint64), n > 0
    spread = mixed(hashes, 0xA24BAED4963EE407)
    one = np.uint64(1) << (spread & np.uint64(63))
    half = ((spread >> np.uint64(6)) & np.uint64(1)).astype(bool)
    for k, mask in enumerate((half, ~half)):
        bits[some, k] = np.bitwise_xor.reduceat(np.where(mask, one, np.uint64(0)), starts[some]) if some.any() else 0
    rank = _by_rarity(owner, level, hashes)
    place = np.arange(len(rank)) - np.repeat(starts, n)
    chosen = (place < np.repeat(prefix_length(n), n)) & (level[rank] > 0)
    rank, place = rank[chosen], place[chosen]
    records = np.zeros(len(rank), kind)
    lead = mixed(hashes[rank], 0x9FB21C651E98DF25)
    own = owner[rank]
    records["key"], records["item"] = (lead >> np.uint64(32)).astype(np.uint32), items[own]
    records["n"], records["at"], records["bits"] = np.minimum(n[own], MOST), np.minimum(place, MOST), bits[own]
    order = order[own]
    records["order"] = np.where(order == LAST, np.iinfo(kind["order"]).max, order.astype(np.uint64) - np.uint64(lowest % (1 << 64)))
    return records, lead & np.uint64(0xFFFFFFFF)


def _extent(own: DataFrame) -> tuple[int, int, bool]:
    """Bytes of all texts, the least id, and whether ids are too far apart for 32 bits."""
    size, low, high = own.agg(F.sum(F.octet_length("text").cast("long")), F.min("key"), F.max("key")).first()
    return size or 0, low or 0, (high or 0) - (low or 0) >= (1 << 32) - 1


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """All rows and columns of docs (the id as a long, the text as a string), and n_lines, removed (numbers of the removed lines), kept_text (the lines left, joined by line breaks).

    A line is what stands between line breaks. A null text has no lines and stays null, an empty one has one, empty, line. A null id comes after all
    others. Rows with one id come by their blocks, which follow from hashes of id and text, and in a block by packed text; of rows that are alike in both
    either may keep its lines. The last three columns have these names even where docs has them, too.
    """
    names = [{id_col: "key", text_col: "text"}.get(c, f"c{k}") for k, c in enumerate(docs.columns)]
    own = docs.toDF(*names).withColumns({"key": F.col("key").cast("long"), "text": F.col("text").cast("string")})
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    size, lowest, wide = _extent(own)
    n, kind = blocks_for(size, block_bytes or BLOCK_BYTES), posting(wide)
    # PLACES bytes, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(rarity(own))
    # all steps read one exchange of the documents
    own = in_blocks(own, n)

    def send_keys(block: int, rows: pa.Table, _: None) -> list[tuple]:
        texts, order = _texts(in_order(rows))
        found = Lines(b"\n".join(texts))
        full = np.flatnonzero(found.n)  # lines without words are no items
        keys = found.keys()[full]
        at = first_places(keys)
        return first_parcels(block, keys[at], order[full[at]], full[at], np.delete(full, at), n)

    def send_postings(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        texts, order = _texts(in_order(rows))
        lines = b"\n".join(texts).split(b"\n")
        items = np.setdiff1d(np.arange(len(lines)), told_items(told, "later"))
        if not len(items):
            return []
        return parcels(block, *postings(Lines(b"\n".join([lines[k] for k in items.tolist()])), items, order[items], shared.value, kind, lowest), n)

    def serve(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        if not told.num_rows:
            return []
        lines = b"\n".join(_texts(in_order(rows))[0]).split(b"\n")
        found = Lines(b"\n".join([lines[k] for k in asked_items(told).tolist()]))
        return served(block, told, found.n, found.hashes)

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_lines int, removed array<int>, kept_text string"

    def cut(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        rows = in_order(rows)
        gone = np.sort(np.concatenate([told_items(told, "later"), told_items(told, "near")])).astype(np.int64)
        texts = [t if t is None else t.decode() for t in unpacked(rows.column("text"))]
        out, k = [], 0
        for row, text in zip(zip(*(texts if c == "text" else rows.column(c).to_pylist() for c in names), strict=True), texts, strict=True):
            size = (text or "").count("\n") + 1
            mine = np.unique(gone[np.searchsorted(gone, k) : np.searchsorted(gone, k + size)] - k).tolist()
            k += size
            kept = text
            if mine:
                lost = set(mine)
                kept = "\n".join([x for j, x in enumerate(text.split("\n")) if j not in lost])
            out.append((*row, 0 if text is None else size, mine, kept))
        return out

    again = later(per_block(own, None, send_keys, ENTRIES))
    entries = per_block(own, again, send_postings, ENTRIES)
    near = verified(per_block(own, proposals(entries, kind), serve, SERVED))
    last = verified(per_block(own, others(entries, near, kind), serve, SERVED))
    # what failed goes by buckets, which have the numbers of blocks: blocks pass it over
    found = per_block(own, again.unionAll(near).unionAll(last), cut, schema)
    return found.toDF(*docs.columns, "n_lines", "removed", "kept_text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "text", "n_lines", "removed", "kept_text"]
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).toDF(*names).selectExpr(
        "doc_id",
        "cast(n_lines AS long) AS n_lines",
        "cast(size(removed) AS long) AS n_removed",
        "array_join(removed, ',') AS removed_lines",
        "sha2(coalesce(kept_text, ''), 256) AS kept_sha256",
    )
