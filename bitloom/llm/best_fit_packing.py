"""Best-fit packing with exact complements.

Documents become pieces of at most `capacity` tokens. Only how many pieces there are of each length decides how they are packed, so
the driver plans over a table of at most `capacity` counts, whatever the size of the corpus. The planner indexes the
lengths still available by single, pair and triple sum. A sequence starts with the longest piece left; if a single, pair or triple
fills its gap exactly, that is taken, else the longest piece that fits, and again. One such pattern is used as often as
the counts allow, so each step uses up a length or nearly so and the plan stays about as long as the table of lengths. Where plain best fit of the same counts, which
is made too, takes fewer sequences, its patterns are used.

Pieces then get their number among the pieces of their length and look up, by that number, which sequence of which pattern holds them. Numbers are made
of counts per (length, hash bucket), so no length, however frequent, is collected in one task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm.tables import arrow_schema, columns, kept, record_batch, table, written

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps; beyond it, it starts anew. It bounds memory, not results.
KEPT_WORDS = 400_000
#: Documents whose new words are looked up together.
CHUNK_ROWS = 8
#: Pieces to a hash bucket, about: what one task numbers at once.
BUCKET_PIECES = 20_000

# The tokenizer's own split of a word, for characters on which all Unicode versions agree; and the same for whole texts, in lower case, of characters up to U+024F, the lower case of which goes up to U+02AF.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-\u02af]+|[0-9²³¹¼-¾]|[^\sa-zªµºÀ-ÖØ-öø-\u02af0-9²³¹¼-¾]+")
PLAIN = re.compile(r"[!-~¡-¬®-\u024f]+")
#: Texts that PARTS splits: without characters whose lower case is beyond U+02AF or two characters.
PLAIN_TEXT = re.compile(r"[\t-\r -~¡-¬®-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]*")
#: Python's white space that the tokenizer takes for characters, and the start of its special tokens.
ODD = re.compile(r"[\x1c-\x1f]|<\|")


#: Packers of so many ids.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of texts as little-endian bytes, equal to the tokenizer's own, with the ids of words remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn_parts(self, parts: set[str]) -> None:
        new = list(parts.difference(self.parts))
        self.parts.update(zip(new, [_packed(found.ids) for found in self.bare.encode_batch_fast(new, add_special_tokens=False)], strict=True))

    def _learn(self, words: set[str]) -> None:
        split = {w: PIECES.findall(w.lower()) for w in words if PLAIN.fullmatch(w)}
        self._learn_parts({p for ps in split.values() for p in ps})
        for word, ps in split.items():
            self.words[word] = b"".join(map(self.parts.__getitem__, ps))
        rest = [w for w in words if w not in split]
        for word, found in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.words[word] = _packed(found.ids)

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts, whose new words are looked up together."""
        if len(self.words) + len(self.parts) > 2 * KEPT_WORDS:
            self.words, self.parts = {}, {}
        # by part where the text is plain, else by word, else as a whole
        plain = [PARTS.findall(t.lower()) if PLAIN_TEXT.fullmatch(t) and "<|" not in t else None for t in texts]
        words = [t.split() if p is None and not ODD.search(t) else None for t, p in zip(texts, plain, strict=True)]
        self._learn_parts(set().union(*filter(None, plain)))
        self._learn(set().union(*filter(None, words)).difference(self.words))
        part, word = self.parts.__getitem__, self.words.__getitem__
        out = []
        for text, p, w in zip(texts, plain, words, strict=True):
            out.append(b"".join(map(part, p)) if p is not None else b"".join(map(word, w)) if w is not None else _packed(self.whole.encode(text, add_special_tokens=False).ids))
        return out

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]


def encoder(name: str) -> Encoder:
    """The worker's encoder, by the tokenizer file's name among the public ones, or its path."""
    if os.path.sep not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return kept(f"encoder {name}", lambda: Encoder(name))


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids as bytes.

    A null or empty text gives one piece, the end id. Repeated rows give repeated pieces.
    """

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_ROWS):
                part, rows = batch.slice(first, CHUNK_ROWS), []
                for key, ids in zip(part.column(0).to_pylist(), of.batch([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        piece = ids[k : k + 4 * capacity]
                        rows.append((key, k // 4 // capacity, k // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                yield record_batch(rows, kinds)

    found = columns(docs, key=f"{id_col}:long", text=text_col).mapInArrow(run, schema)
    return found if with_ids else found.drop("ids")


class _Sums:
    """Which one, two or three available lengths make a sum. Entries may be out of date; they are tested and renewed when looked up."""

    def __init__(self, left: np.ndarray):
        self.left, n = left, len(left)
        self.pair, self.triple = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a in np.flatnonzero(left):  # the longest comes last and stays
            others = np.flatnonzero(left[: n - a])
            self.pair[a + others] = a
        made = np.flatnonzero(self.pair)
        for a in np.flatnonzero(left):
            self.triple[a + made[made < n - a]] = a

    def _has(self, lengths: tuple[int, ...], used: dict[int, int]) -> bool:
        return all(x > 0 and self.left[x] - used.get(x, 0) >= lengths.count(x) for x in set(lengths))

    def two(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        a = int(self.pair[gap])
        if not a:
            return None
        if self._has((a, gap - a), used):
            return a, gap - a
        # renew: some other pair, the longest member first
        x = np.arange((gap + 1) // 2, gap)
        some = x[(self.left[x] > 0) & (self.left[gap - x] > 0)]
        if not len(some):
            self.pair[gap] = 0  # what is used up never comes back
            return None
        for a in map(int, some[::-1]):
            if self._has((a, gap - a), used):
                self.pair[gap] = a
                return a, gap - a
        return None

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        if self._has((gap,), used):
            return (gap,)
        if two := self.two(gap, used):
            return two
        a = int(self.triple[gap])
        if not a:
            return None
        if (two := self.two(gap - a, used)) and self._has((a, *two), used):
            return (a, *two)
        x = np.flatnonzero(self.left[:gap])
        for a in map(int, x[self.pair[gap - x] > 0][::-1]):
            if (two := self.two(gap - a, used)) and self._has((a, *two), used):
                self.triple[gap] = a
                return (a, *two)
        self.triple[gap] = 0 if not used else self.triple[gap]
        return None


def _exact_first(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns from the longest piece down, their gaps filled by exact sums, or by the longest pieces that fit; each is used as often as the counts allow."""
    sums = _Sums(left)
    out = []
    for top in range(capacity, 0, -1):
        while left[top]:
            pattern, used, gap = [top], {top: 1}, capacity - top
            while gap:
                if found := sums.exact(gap, used):
                    gap = 0
                else:
                    fit = np.flatnonzero(left[: gap + 1])
                    fit = next((int(x) for x in fit[::-1] if left[x] > used.get(int(x), 0)), 0)
                    if not fit:
                        break
                    found, gap = (fit,), gap - fit
                for x in found:
                    pattern.append(x)
                    used[x] = used.get(x, 0) + 1
            times = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= n * times
            out.append((tuple(pattern), times))
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the pieces by decreasing length: each goes to the fullest sequence that has room. Sequences of one gap are one entry."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by gap: patterns and how many sequences have them
    gaps: list[int] = []  # gaps that sequences have, sorted
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else capacity
            if at < len(gaps):
                pattern, have = open_[gap].popitem()
                if not open_[gap]:
                    gaps.pop(at)
            else:
                pattern, have = (), n // (capacity // length) or 1
            # as many pieces as each of so many sequences takes, one after the other, as best fit would
            each = min(gap // length, n)
            times = min(have, n // each)
            if times < have:
                _open(open_, gaps, gap, pattern, have - times)
            _open(open_, gaps, gap - each * length, pattern + (length,) * each, times)
            n -= each * times
    return [x for patterns in open_ for x in patterns.items()]


def _open(open_: list[dict[tuple[int, ...], int]], gaps: list[int], gap: int, pattern: tuple[int, ...], times: int) -> None:
    if not open_[gap]:
        insort(gaps, gap)
    open_[gap][pattern] = open_[gap].get(pattern, 0) + times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each, using every piece once. counts: pieces by length.

    Both patterns by exact sums and plain best fit are made, and the ones of the fewer sequences are returned.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    return min((_exact_first(left.copy(), capacity), _best_fit(left, capacity)), key=lambda found: sum(n for _, n in found))


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[np.ndarray, ...]]:
    """By length: where ranges of piece numbers begin, and the first sequence and the offset of each range."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    next_number = [0] * (capacity + 1)
    first = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows[x].append((next_number[x], first, offset))
            next_number[x] += times
            offset += x
        first += times
    return [tuple(np.array(r, np.int64).reshape(-1, 3).T) for r in rows]


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. found: a table that is read more than once, with doc_id, piece, length; lengths from 1 to capacity.

    Pieces that are alike in every column are still placed apart. The result doesn't depend on the order of rows, except among such pieces.
    """
    # hash buckets by number of pieces, so that a frequent length is numbered by many tasks
    buckets = max(1, found.count() // BUCKET_PIECES)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    by_bucket = dealt.groupBy("length", "bucket").count()
    before = by_bucket.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan(counts, capacity), capacity)
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start")) - 1
    numbered = dealt.withColumn("number", local).join(before, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before")).drop("bucket", "before")
    own = [c for c in found.columns if c not in ("sequence_id", "offset")]
    schema = arrow_schema(", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in own) + ", sequence_id long, offset long")
    shared = found.sparkSession.sparkContext.broadcast(places)  # some numbers for each pattern: bounded by the number of lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(zero_copy_only=False), batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:b]
                starts, first, offsets = where[length[at[0]]]
                k = np.searchsorted(starts, number[at], "right") - 1
                sequence[at], offset[at] = first[k] + number[at] - starts[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(sequence), pa.array(offset)], schema=schema)

    return numbered.select(*own, F.col("number").cast("long").alias("number")).mapInArrow(place, ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in own) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_pieces, length, ids (bytes), from pieces that carry their ids."""
    return (
        placed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
        .select("sequence_id", F.size("parts").alias("n_pieces"), F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), F.aggregate("parts", F.lit(b"").cast("binary"), lambda n, x: F.concat(n, x["ids"])).alias("ids"))
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their places."""
    placed = packed(written(pieces(docs), "pieces"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
