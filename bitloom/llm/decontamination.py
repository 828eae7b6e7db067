"""Benchmark decontamination over a distributed positional inverted index.

The index has a row for each shard, a run of documents of a few million characters: all terms of the shard, and for each the list of
positions it stands at, counted over the whole shard. Documents are parted by a position that holds no term. It is built in
one pass without a shuffle, stored, and may be searched as often as there are phrases to seek. A shard looks up the terms of the phrases; those of which it lacks a term are
out, and for the others the terms' lists, each less the term's offset in its phrase, are intersected from the rarest term in the shard to the most frequent, for many
phrases at once. Proximity matches come from the same lists.

Phrases travel to the shards as numbers of terms, in blocks of bounded size, whose number grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.tables import arrow_schema, columns, positional, record_batch, release, table, written
from bitloom.llm.word_hashes import Words

WINDOW = 10
#: Words that may stand between those of a window for a proximity match.
SLOP = 2
SHARD_CHARS = 8_000_000
#: Bytes of benchmark text in one block of phrases; a block is a broadcast of about ten times that.
BLOCK_BYTES = 2 << 20
#: Candidate positions looked at together.
CHUNK = 1 << 19

# A-Z to lower case, digits, letters and bytes of other alphabets as they are, all else to spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard long, terms binary, counts binary, positions binary, doc_ids array<long>, n_words array<int>, marks array<long>"
MATCHES = "shard long, slot int, doc_id long, n_words int, mark long, hits array<int>, items array<string>"
NEAR = ", near array<int>, near_items array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; all but letters, digits and characters beyond ASCII parts them."""
    return (text or "").encode().translate(FOLDED).split()


def indexed(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's terms joined by spaces, how many positions each has, all positions term by term, and the number of words of each text."""
    folded = [(t or "").encode().translate(FOLDED) for t in texts]
    found = Words(folded, spans=True)
    n_words = np.diff(found.first)
    a, b = found.hashes
    order = np.argsort(a, kind="stable")
    if (np.diff(a[order]) == 0)[np.diff(b[order]) != 0].any():
        order = np.lexsort((b, a))
    firsts = np.flatnonzero(np.concatenate([[True], (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])])) if len(a) else np.zeros(0, np.int64)
    whole = b"\n".join(folded)
    terms = b" ".join([whole[i : i + n] for i, n in zip(found.begin[order[firsts]].tolist(), found.size[order[firsts]].tolist(), strict=True)])
    positions = np.arange(len(a)) + np.repeat(np.arange(len(texts)), n_words)
    return terms, np.diff(firsts, append=len(a)), positions[order], n_words


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all terms of all documents. Null texts have no words; every row of docs has its place, repeated ones too."""
    schema = arrow_schema(INDEX)

    def shard(number: int, rows: list[tuple]) -> pa.RecordBatch:
        terms, counts, positions, lengths = indexed([t for _, t, _ in rows])
        gaps = np.diff(positions, prepend=0).astype("<i4")
        return record_batch([(number, terms, counts.astype("<i4").tobytes(), gaps.tobytes(), [k for k, _, _ in rows], lengths.tolist(), [m for _, _, m in rows])], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    rows.append(row)
                    size += len(row[1] or "")
                    if size >= SHARD_CHARS:
                        yield shard(number, rows)
                        number, rows, size = number + 1, [], 0
        if rows:
            yield shard(number, rows)

    own = columns(docs, key=f"{id_col}:long", text=text_col).withColumn("mark", F.xxhash64("text"))
    return own.mapInArrow(run, INDEX)


class Phrases:
    """The distinct windows of some items, as numbers of terms, -1 beyond the end of a short one; and each one's items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        numbers: dict[bytes, int] = {}
        self.names = sorted({k for k, _ in items})
        known = {k: i for i, k in enumerate(self.names)}
        rows, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for key, text in items:
            found = np.array([numbers.setdefault(w, len(numbers)) for w in words(text)], np.int32)
            if len(found):
                short = np.pad(found, (0, max(0, size - len(found))), constant_values=-1)
                rows.append(np.lib.stride_tricks.sliding_window_view(short, size))
                owners.append(np.full(len(rows[-1]), known[key]))
        self.terms = list(numbers)
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.sizes = (self.windows >= 0).sum(1)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
        #: items of window k: owners[firsts[k] : firsts[k + 1]]
        self.owners, self.firsts = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))


class Shard:
    """One row of the index, opened."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, n_words: list[int]):
        self.counts = np.frombuffer(counts, "<i4")
        self.positions = np.cumsum(np.frombuffer(positions, "<i4"), dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.numbers = {t: k for k, t in enumerate(terms.split(b" "))} if terms else {}
        self.bases = np.concatenate([[0], np.cumsum(np.array(n_words, np.int64) + 1)])

    def postings(self, term: bytes) -> np.ndarray:
        k = self.numbers[term]
        return self.positions[self.ends[k] - self.counts[k] : self.ends[k]]

    def seek(self, phrases: Phrases, near: int | None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Exact matches: numbers of windows and the positions where they start. And, with near, the windows that may have proximity matches of that slop."""
        place = np.array([self.numbers.get(t, -1) for t in phrases.terms], np.int64)
        place = np.where(phrases.windows < 0, -2, place[phrases.windows] if len(place) else -2)
        alive = np.flatnonzero((place != -1).all(1))
        place = place[alive]
        count = np.append(self.counts.astype(np.int64), np.iinfo(np.int64).max)[np.where(place < 0, len(self.counts), place)]
        order = np.argsort(count, axis=1, kind="stable")  # the rarest term first, what is no term last
        place = np.take_along_axis(place, order, 1)
        n = np.take_along_axis(count, order, 1)[:, 0]
        lists = (np.repeat(np.arange(len(self.counts)), self.counts) << 32) + self.positions  # all lists as one, sorted
        sums, start, found, close = np.cumsum(n), 0, [], []
        while start < len(n):
            done = sums[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sums, done + CHUNK, "right")))
            first = np.repeat(np.arange(start, end), n[start:end])
            at = self.positions[np.repeat((self.ends - self.counts)[place[start:end, 0]] - sums[start:end] + n[start:end] + done, n[start:end]) + np.arange(len(first))]
            w, begin = first, at - order[first, 0]
            for k in range(1, place.shape[1]):
                term, sought = place[w, k], begin + order[w, k]
                sought = (term << 32) + sought
                i = np.searchsorted(lists, sought)
                good = (term < 0) | (lists[np.minimum(i, len(lists) - 1)] == sought) & (i < len(lists))
                w, begin = w[good], begin[good]
            found.append((alive[w], begin))
            if near is not None:
                w, width = first, (phrases.sizes[alive] + near)
                for k in range(1, place.shape[1]):
                    term = place[w, k]
                    i = np.searchsorted(lists, (term << 32) + np.maximum(at - width[w] + 1, 0))
                    good = (term < 0) | (lists[np.minimum(i, len(lists) - 1)] < (term << 32) + at + width[w]) & (i < len(lists))
                    w, at = w[good], at[good]
                close.append(alive[np.unique(w)])
            start = end
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none), np.concatenate([none, *close])

    @staticmethod
    def _within(own: np.ndarray, around: np.ndarray, width: int) -> np.ndarray:
        """The positions that are less than width away from one of the others."""
        low, high = np.searchsorted(own, around - width + 1), np.searchsorted(own, around + width)
        n = high - low
        return own[np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))]

    def near(self, terms: tuple[bytes, ...], width: int) -> np.ndarray:
        """Positions of the first word of each stretch of at most width words of one document that begins and ends with, and has all of, the terms."""
        lists = [self.postings(t) for t in sorted(set(terms), key=lambda t: self.counts[self.numbers[t]])]
        around = rarest = lists[0]  # the rarest term first: at most places the others are not near
        for own in lists[1:]:
            if not len(around):
                break
            k = np.searchsorted(own, around - width + 1)
            around = around[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] < around + width)]
        if not len(around):
            return around
        lists = [self._within(own, around, width) for own in lists]
        starts, rarest = np.unique(np.concatenate(lists)), lists[0]
        k = np.searchsorted(rarest, starts)
        starts = starts[(k < len(rarest)) & (rarest[np.minimum(k, len(rarest) - 1)] < starts + width)]
        last = starts.copy()
        for own in lists:
            k = np.searchsorted(own, starts)
            last = np.where(k < len(own), np.maximum(last, own[np.minimum(k, len(own) - 1)]), np.iinfo(np.int64).max)
        same = np.searchsorted(self.bases, starts, "right") == np.searchsorted(self.bases, np.minimum(last, self.bases[-1]), "right")
        return starts[(last - starts < width) & same]


def search(index: DataFrame, phrases: Phrases, near: int | None = None) -> DataFrame:
    """Per document: the offsets of its words inside matches and the ids of the matching items; documents without any, too.

    With near, proximity matches are given besides: stretches of at most the phrase's length and so many more words that have all its terms; the offsets of the words
    that they begin with, and the items.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # a block of the benchmark: some times BLOCK_BYTES
    columns_of = MATCHES + (NEAR if near is not None else "")
    schema = arrow_schema(columns_of)

    def matches(number: int, terms: bytes, counts: bytes, positions: bytes, doc_ids: list, n_words: list[int], marks: list[int]) -> list[tuple]:
        shard, phrases = Shard(terms, counts, positions, n_words), shared.value
        (which, starts), close = shard.seek(phrases, near)
        kinds = [(which, starts)]
        hits = np.zeros((1 if near is None else 2, int(shard.bases[-1]) + WINDOW), bool)
        for k in range(phrases.windows.shape[1]):
            hits[0, starts[phrases.sizes[which] > k] + k] = True
        if near is not None:
            starts = [shard.near(tuple(phrases.terms[t] for t in phrases.windows[w] if t >= 0), int(phrases.sizes[w]) + near) for w in close.tolist()]
            kinds.append((np.repeat(close, [len(s) for s in starts]), np.concatenate([np.zeros(0, np.int64), *starts])))
            hits[1, kinds[1][1]] = True
        items = []
        for which, starts in kinds:
            slots = np.searchsorted(shard.bases, starts, "right") - 1
            found: dict[int, set[int]] = {}
            for slot, w in np.unique(np.stack([slots, which]), axis=1).T.tolist():
                found.setdefault(slot, set()).update(phrases.owners[phrases.firsts[w] : phrases.firsts[w + 1]].tolist())
            items.append({slot: [phrases.names[k] for k in sorted(own)] for slot, own in found.items()})
        out = []
        for slot, (key, n, mark, base) in enumerate(zip(doc_ids, n_words, marks, shard.bases.tolist(), strict=False)):
            row = [number, slot, key, n, mark]
            for own, found in zip(hits, items, strict=True):
                row += [np.flatnonzero(own[base : base + n]).tolist() if slot in found else [], found.get(slot, [])]
            out.append(tuple(row))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = matches(*(c[0].as_py() for c in batch.slice(k, 1).columns))
                for start in range(0, len(rows), 2000):
                    yield record_batch(rows[start : start + 2000], schema)

    return index.mapInArrow(run, columns_of)


def contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", near: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, hits (offsets of hit words), items (ids of items with matching windows, sorted as strings), mark (xxhash64 of the text).
    With near: near (offsets of words that begin a proximity match of that slop), near_items, too.

    Items with a null id are left out; null and empty texts have no words and match nothing; repeated rows give repeated rows.
    """
    items = columns(benchmark, key=item_col, text=text_col).where("key IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES))
    index = written(build_index(docs, id_col, text_col), "index")
    more, found = [] if near is None else ["near", "near_items"], None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == k)
        one = search(index, Phrases([(r["key"], r["text"]) for r in part.collect()], size), near)  # about BLOCK_BYTES
        found = one if found is None else found.unionAll(one)
    if blocks > 1:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("shard", "slot", "doc_id", "n_words", "mark").agg(*map(merged, ["hits", "items", *more]))
    return found.select("doc_id", "n_words", "hits", "items", "mark", *more)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any word in a benchmark window, in all their columns. docs: doc_id, text and any others."""
    found = contamination(docs, benchmark).where(F.size("hits") > 0).select(F.col("doc_id").alias("key"), "mark").distinct()
    docs, names = positional(docs), docs.columns
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    return docs.join(found, key.cast("long").eqNullSafe(found["key"]) & (F.xxhash64(text.cast("string")) == found["mark"]), "left_anti").toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=SLOP)
    return found.selectExpr(
        "doc_id",
        "cast(n_words AS long) AS n_words",
        "cast(size(hits) AS long) AS n_hit",
        "cast(size(items) AS long) AS n_items",
        "sha2(array_join(items, ','), 256) AS items_sha256",
        "size(hits) > 0 AS contaminated",
        "cast(size(near) AS long) AS n_near",
        "array_join(near_items, ',') AS near_items",
    )
