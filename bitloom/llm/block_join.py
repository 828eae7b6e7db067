"""Which items of a corpus have a similar one before them: a set-similarity join between blocks, without hot keys and without rows for pairs.

Items are numbered within their block, in order. Each sends a record under every word of its prefix to hash buckets. In a bucket, a record is compared with those
before it that have its word, first with a few leaders of the word, and only where none fits with all others; what fits first is proposed as its partner. So a
group of thousands that are nearly alike makes as many proposals as it has members, not as many as it has pairs. A proposal is verified on whole sets at the partner's
block. Only items whose proposals fail go back to the buckets that made them, and are verified with every partner that fits there. What a task
holds is bounded by blocks and buckets, whose number grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bitloom.llm.key_exchange import PAIR, alike
from bitloom.llm.tables import arrow_schema, record_batch

ENTRIES = "bucket int, block int, records binary"
TOLD = "block int, kind string, data binary"
SERVED = "place int, block int, numbers binary, sizes binary, members binary, pairs binary"
#: An item asked for: where its set is to go, and if it is to be verified, with which item there, and which bucket proposes it.
ASKED = np.dtype([("item", "<u4"), ("place", "<u4"), ("other", "<u4"), ("bucket", "<u4")])
NONE = np.uint32(0xFFFFFFFF)
FAILED = np.dtype([("block", "<u4"), ("item", "<u4")])
FIRSTS = np.dtype([("key", PAIR), ("order", "<i8"), ("item", "<u4")])
#: Pairs looked at together in one array, and how many leaders of a word the others are compared with before all are.
CHUNK, LEADERS = 1 << 16, 4
#: Jaccard similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Sizes and places in records end here; beyond it filters let pass.
MOST = 0xFFFF


def posting(wide: bool) -> np.dtype:
    """Records of items under a word: wide if the order of documents takes more than 32 bits."""
    return np.dtype([("key", "<u4"), ("item", "<u4"), ("n", "<u2"), ("at", "<u2"), ("order", "<u8" if wide else "<u4"), ("bits", "<u8", (2,))])


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes at which their similarity is reached: o / (a + b - o) >= t."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """So many members, in a common order, of similar sets hold a common one; none of sets too small to have a similar one that isn't equal."""
    return np.where(n < NUMERATOR, 0, n - -(-NUMERATOR * n // DENOMINATOR) + 1)


def parcels(block: int, records: np.ndarray, lead: np.ndarray, buckets: int) -> list[tuple]:
    """Records by bucket, which follows from `lead`."""
    bucket = (lead % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, block, records[order[edges[k] : edges[k + 1]]].tobytes()) for k in range(buckets) if edges[k] < edges[k + 1]]


def _gathered(found: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's records and their blocks, by block."""
    found = found.sort_by("block")
    parts = [np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in found.column("records"))]
    return np.concatenate(parts), np.repeat(np.array(found.column("block").to_pylist(), np.int64), [len(p) for p in parts[1:]])


def _distinct(records: np.ndarray) -> np.ndarray:
    """The different ones of a few records, sorted."""
    records = records[np.lexsort([records[f] for f in records.dtype.names[::-1]])]
    fresh = np.zeros(len(records), bool)
    fresh[:1] = True
    for f in records.dtype.names:
        fresh[1:] |= records[f][1:] != records[f][:-1]
    return records[fresh]


class Bucket:
    """A bucket's records by word, and in order within each."""

    def __init__(self, found: pa.Table, kind: np.dtype):
        records, block = _gathered(found, kind)
        # records come by block and item
        narrow = records["order"].dtype == np.uint32
        order = np.argsort((records["key"].astype(np.uint64) << np.uint64(32)) | records["order"], kind="stable") if narrow else np.lexsort((records["order"], records["key"]))
        self.records, self.block = records[order], block[order]
        # columns of their own: filters look at few of them
        self.size, self.at = (self.records[c].astype(np.int32) for c in ("n", "at"))
        self.after = self.size - self.at
        self.bits = [np.ascontiguousarray(self.records["bits"][:, k]) for k in (0, 1)]
        self.large = bool((self.size == MOST).any())
        key = self.records["key"]
        self.run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        self.first = np.searchsorted(self.run, self.run)

    def fitting(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of places pass the filters: length and position, and bits that the words flip, of which no more can differ than words do."""
        both = self.size[x] + self.size[y]
        rest = np.minimum(self.at[x], self.at[y]) + np.minimum(self.after[x], self.after[y])
        rest *= NUMERATOR + DENOMINATOR
        good = rest >= NUMERATOR * both
        if self.large:
            good |= (self.size[x] == MOST) | (self.size[y] == MOST)
        good = np.flatnonzero(good)
        x, y, both = x[good], y[good], both[good]
        differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int32) for b in self.bits)
        near = differ <= both - 2 * -(-NUMERATOR * both // (NUMERATOR + DENOMINATOR))
        if self.large:
            near |= (self.size[x] == MOST) | (self.size[y] == MOST)
        return good[near]

    def before(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs, in chunks, of the places `which` and all places before them of the same word and of a size that may fit, that pass the filters."""
        n = self.size.astype(np.uint64)
        by_size = np.lexsort((n, self.run))
        size = (self.run[by_size].astype(np.uint64) << np.uint64(32)) | n[by_size]
        run, own = self.run[which].astype(np.uint64) << np.uint64(32), n[which]
        low = np.searchsorted(size, run | -(-own.astype(np.int64) * NUMERATOR // DENOMINATOR).astype(np.uint64))
        high = np.searchsorted(size, run | own * np.uint64(DENOMINATOR) // np.uint64(NUMERATOR) + (own == MOST) * np.uint64(MOST), "right")
        sums = np.cumsum(high - low)
        start = 0
        while start < len(which):
            done = sums[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sums, done + CHUNK, "right")))
            count = (high - low)[start:end]
            x = np.repeat(which[start:end], count)
            y = by_size[np.repeat(low[start:end] - (sums[start:end] - count - done), count) + np.arange(len(x))]
            earlier = np.flatnonzero(y < x)
            x, y = x[earlier], y[earlier]
            good = self.fitting(x, y)
            yield x[good], y[good]
            start = end

    def proposed(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of records, each with the place of the first one found before it that may be similar."""
        n = len(self.records)
        partner = np.full(n, -1)
        led = np.unique(self.first)  # of each word, the leader looked at
        ends = np.append(led[1:], n)
        free = np.ones(n, bool)
        free[led] = False
        for _ in range(LEADERS):
            x = np.flatnonzero(free)
            y = led[self.run[x]]
            later = x > y
            x, y = x[later], y[later]
            good = self.fitting(x, y)
            partner[x[good]] = y[good]
            free[x[good]] = False
            rest = np.append(np.flatnonzero(free), n)
            nearest = rest[np.searchsorted(rest, led)]
            led = np.where(nearest < ends, nearest, led)
            free[led] = False
            if not free.any():
                break
        open_ = np.flatnonzero((partner < 0) & (self.first < np.arange(n)))
        for x, y in self.before(open_):
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.diff(x, prepend=-1))
            partner[x[first]] = y[first]
        x = np.flatnonzero(partner >= 0)
        return x, partner[x]

    def asking(self, bucket: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        """TOLD rows of kind "ask": x's set is to go to y's block to be verified with y's."""
        if not len(x):
            return []
        asked = np.zeros(2 * len(x), ASKED)
        asked["item"] = np.concatenate([self.records["item"][x], self.records["item"][y]])
        asked["place"] = np.tile(self.block[y], 2)
        asked["other"] = np.concatenate([self.records["item"][y], np.full(len(y), NONE)])
        asked["bucket"] = np.repeat([bucket, 0], len(x))
        block = np.concatenate([self.block[x], self.block[y]])
        return [(int(b), "ask", _distinct(asked[block == b]).tobytes()) for b in np.unique(block)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([record_batch(rows, schema)] if rows else [], schema)


def proposals(entries: DataFrame, kind: np.dtype) -> DataFrame:
    """TOLD rows: what the blocks are to serve, from the postings in buckets."""
    schema = arrow_schema(TOLD)

    def bucket(found: pa.Table) -> pa.Table:
        own = Bucket(found, kind)
        return _table(own.asking(found.column("bucket")[0].as_py(), *own.proposed()), schema)

    return entries.groupBy("bucket").applyInArrow(bucket, TOLD)


def others(entries: DataFrame, told: DataFrame, kind: np.dtype) -> DataFrame:
    """TOLD rows for items whose proposals failed: every partner before them that fits, in the buckets that had made proposals."""
    schema = arrow_schema(TOLD)

    def bucket(found: pa.Table, told: pa.Table) -> pa.Table:
        failed = told_items(told, "fail", FAILED)
        if not len(failed) or not found.num_rows:
            return _table([], schema)
        own = Bucket(found, kind)
        names = np.zeros(len(own.records), FAILED)
        names["block"], names["item"] = own.block, own.records["item"]
        which = np.flatnonzero(np.isin(names.view("<u8").ravel(), failed.view("<u8")))
        number = found.column("bucket")[0].as_py()
        return _table([row for x, y in own.before(which) for row in own.asking(number, x, y)], schema)

    return entries.groupBy("bucket").cogroup(told.groupBy("block")).applyInArrow(bucket, TOLD)


def told_items(told: pa.Table, kind: str, dtype: np.dtype | str = "<u4") -> np.ndarray:
    """What a block or bucket was told under this kind."""
    parts = [np.frombuffer(d, dtype) for k, d in zip(told.column("kind").to_pylist(), told.column("data").to_pylist(), strict=True) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def asked_items(told: pa.Table) -> np.ndarray:
    """The items that a block is asked for, sorted."""
    return np.unique(told_items(told, "ask", ASKED)["item"])


def served(block: int, told: pa.Table, size: np.ndarray, members: np.ndarray) -> list[tuple]:
    """Answers to requests by place. size, members: of asked_items(), the sizes of their sets, and these one after the other, each sorted."""
    asked = told_items(told, "ask", ASKED)
    known, first = np.unique(asked["item"]), np.cumsum(size) - size
    asked = asked[np.lexsort((asked["item"], asked["other"] == NONE, asked["place"]))]
    part = np.flatnonzero(np.diff(asked["place"].astype(np.int64) * 2 + (asked["other"] == NONE), prepend=-1, append=-1))
    rows = []
    for s, e in zip(part[:-1], part[1:], strict=True):
        own = asked[s:e]
        numbers = np.unique(own["item"])
        k = np.searchsorted(known, numbers)
        at = np.repeat(first[k] - np.cumsum(size[k]) + size[k], size[k]) + np.arange(size[k].sum())
        rows.append((int(own["place"][0]), block, numbers.tobytes(), size[k].astype("<u4").tobytes(), members[at].astype("<u8").tobytes(), None if own["other"][0] == NONE else _distinct(own).tobytes()))
    return rows


class Side:
    """Items with their sets."""

    def __init__(self, rows: list[tuple]):
        number = [np.frombuffer(r[1], "<u4").astype(np.uint64) | np.uint64(r[0] << 32) for r in rows]
        self.numbers = np.concatenate(number) if number else np.zeros(0, np.uint64)  # rows come by block
        self.sizes = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.members = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows]) if rows else np.zeros(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])


def overlaps(a: Side, b: Side, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members the items have in common, pair by pair; `left` is sorted."""
    common = np.zeros(len(left), np.int64)
    edges = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        own = a.members[a.starts[left[s]] : a.starts[left[s] + 1]]
        n = b.sizes[right[s:e]]
        ends = np.cumsum(n)
        at = np.repeat(b.starts[right[s:e]] - ends + n, n) + np.arange(ends[-1])
        other = b.members[at]
        hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        common[s:e] = np.add.reduceat(hit, ends - n)
    return common


def verified(answers: DataFrame) -> DataFrame:
    """TOLD rows: of kind "near", the items of a block that have a similar one before them; of kind "fail", for a bucket, those that haven't the one it proposed. Sets are never empty."""
    schema = arrow_schema(TOLD)

    def place(given: pa.Table) -> pa.Table:
        rows = sorted(zip(*(given.column(c).to_pylist() for c in ("block", "numbers", "sizes", "members", "pairs")), strict=True), key=lambda r: r[0])
        a, b = Side([r for r in rows if r[4] is None]), Side([r for r in rows if r[4] is not None])
        block = np.concatenate([np.repeat(r[0], len(r[4]) // ASKED.itemsize) for r in rows if r[4] is not None])
        pairs = np.concatenate([np.frombuffer(r[4], ASKED) for r in rows if r[4] is not None])
        own = (block.astype(np.uint64) << np.uint64(32)) | pairs["item"]
        order = np.lexsort((own, pairs["other"]))
        pairs, own, block = pairs[order], own[order], block[order]
        # several buckets may propose one pair
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (pairs["other"][1:] != pairs["other"][:-1])])
        left = np.searchsorted(a.numbers & np.uint64(0xFFFFFFFF), pairs["other"][fresh])
        right = np.searchsorted(b.numbers, own[fresh])
        good = (overlaps(a, b, left, right) >= needed(a.sizes[left], b.sizes[right]))[np.cumsum(fresh) - 1]
        out = [(int(k), "near", np.unique(pairs["item"][good & (block == k)]).tobytes()) for k in np.unique(block[good])]
        failed = ~good & ~np.isin(own, own[good])
        names = np.zeros(len(pairs), FAILED)
        names["block"], names["item"] = block, pairs["item"]
        out += [(int(k), "fail", names[failed & (pairs["bucket"] == k)].tobytes()) for k in np.unique(pairs["bucket"][failed])]
        return _table(out, schema)

    return answers.groupBy("place").applyInArrow(place, TOLD)


def first_parcels(block: int, keys: np.ndarray, order: np.ndarray, items: np.ndarray, copies: np.ndarray, buckets: int) -> list[tuple]:
    """By bucket, a block's distinct keys, each with its first item and the order of its document; and, to be told back, the items that are copies of these."""
    records = np.zeros(len(keys), FIRSTS)
    records["key"], records["order"], records["item"] = keys, order, items
    back = [(block % buckets, -1 - block, copies.astype("<u4").tobytes())] if len(copies) else []
    return parcels(block, records, keys["a"], buckets) + back


def firsts(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's keys of first_parcels(), and their blocks."""
    return _gathered(found.filter(pc.greater_equal(found.column("block"), 0)), FIRSTS)


def later(entries: DataFrame) -> DataFrame:
    """TOLD rows of kind "later": the items of a block whose key stands before them, in the block, in an earlier document or in a lower block."""
    schema = arrow_schema(TOLD)

    def bucket(found: pa.Table) -> pa.Table:
        rows = [(-1 - b, "later", data) for b, data in zip(found.column("block").to_pylist(), found.column("records").to_pylist(), strict=True) if b < 0]
        records, block = firsts(found)
        order = np.lexsort((block, records["order"], records["key"]["b"], records["key"]["a"]))
        repeat = np.zeros(len(records), bool)
        repeat[order[1:]] = alike(records["key"][order])
        return _table(rows + [(int(b), "later", records["item"][repeat & (block == b)].tobytes()) for b in np.unique(block[repeat])], schema)

    return entries.groupBy("bucket").applyInArrow(bucket, TOLD)


def first_places(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key stands first."""
    ranks = np.lexsort((keys["b"], keys["a"]))
    return np.sort(ranks[np.concatenate([[True], ~alike(keys[ranks])])]) if len(keys) else ranks
