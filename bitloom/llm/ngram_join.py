"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Documents are sets of five-word shingles (a shorter one is one shingle of all its words). Documents with the same set are one class. Classes that the forest
matches (minhash_forest) are linked to a leader, not to each other, and the groups that these links connect are brought together: each class sends its set once to the place
of its group, or, if the group is larger than a tile, to a tile for each part of the group. There all pairs that sketches don't rule out are verified on whole sets; in a group of near copies the
sets are compared by what they have more and less than one of them. Classes and the links between them give the near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.block_join import ENTRIES, TOLD, first_parcels, first_places, firsts, later, needed, parcels, told_items
from bitloom.llm.components import components
from bitloom.llm.key_exchange import PAIR, alike, blocks_for, in_blocks, in_order, per_block, unpacked
from bitloom.llm.minhash_forest import CHUNK, RECORD, SPARE, differing, matched_depth, matches, most_differing, prefixes, records_of, signature
from bitloom.llm.substring_dedup import rolled
from bitloom.llm.tables import arrow_schema, columns, forget, positional, record_batch, release, scan_bytes, table, written
from bitloom.llm.word_hashes import Words

WORDS = 5
LAST = np.iinfo(np.int64).max
EDGES = "u binary, v binary, n long"
#: Where a class's set is to go: its group, the part of the group that it is in, and the number of parts.
PLACED = np.dtype([("item", "<u4"), ("part", "<u4"), ("parts", "<u4"), ("root", PAIR)])
#: A set in a tile: the group, the two parts that the tile compares, its own part, the number of parts, its size, key and sketch.
ITEM = np.dtype([("root", PAIR), ("lo", "<u4"), ("hi", "<u4"), ("part", "<u4"), ("parts", "<u4"), ("n", "<u4"), ("own", PAIR), ("bits", "<u8", (2,))])
SENT = "place int, items binary, members binary"
FOUND = "u binary, v binary, n long, whole boolean"
#: Bytes of sets in one part of a group, and in one place.
TILE_BYTES = 16 << 20


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; none if it has no words."""
    found = Words([t or b"" for t in texts], 1)
    out = []
    for k in range(len(texts)):
        hashes = found.of(k)
        n = hashes.shape[1]
        out.append(np.unique(rolled(hashes, min(words, n), 0)) if n else np.zeros(0, np.uint64))
    return out


def set_key(members: np.ndarray) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(members.tobytes()), 1 << 64)


class Classes:
    """The distinct shingle sets of a block of documents; texts without words are left out."""

    def __init__(self, rows: list[tuple[int | None, bytes | None]]):
        sets = [(LAST if key is None else key, s) for (key, _), s in zip(rows, shingle_sets([t for _, t in rows]), strict=True) if len(s)]
        keys = np.array([set_key(s) for _, s in sets], PAIR) if sets else np.zeros(0, PAIR)
        order = np.array([k for k, _ in sets], np.int64)
        by_order = np.argsort(order, kind="stable")
        places = by_order[first_places(keys[by_order])]
        self.keys, self.order = keys[places], order[places]
        self.sets = [sets[k][1] for k in places]
        self.n = np.array([len(s) for s in self.sets], np.int64)


def _rows(own: pa.Table) -> list[tuple[int | None, bytes | None]]:
    own = in_order(own)
    return list(zip(own.column("key").to_pylist(), unpacked(own.column("text")), strict=True))


def _packed(keys: np.ndarray) -> list[bytes]:
    data = np.stack([keys["a"], keys["b"]], -1).astype(">u8").tobytes()
    return [data[k : k + 16] for k in range(0, len(data), 16)]


def _opened(column: pa.ChunkedArray) -> np.ndarray:
    halves = np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2)
    out = np.zeros(len(halves), PAIR)
    out["a"], out["b"] = halves[:, 0], halves[:, 1]
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([record_batch(rows, schema)] if rows else [], schema)


def _first_entries(own: DataFrame, n: int) -> DataFrame:
    def send_keys(block: int, rows: pa.Table, _: None) -> list[tuple]:
        found = Classes(_rows(rows))
        return first_parcels(block, found.keys, found.order, np.arange(len(found.keys)), np.zeros(0), n)

    return per_block(own, None, send_keys, ENTRIES)


def candidates(own: DataFrame, n: int) -> DataFrame:
    """EDGES between classes that the forest matches, enough to connect them: u is the least of those connected in a bucket, v each of them, with its size."""
    schema = arrow_schema(EDGES)

    def send_strings(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        found = Classes(_rows(rows))
        items = np.setdiff1d(np.flatnonzero(found.n > 3), told_items(told, "later"))  # smaller sets have no similar ones but equal ones
        records = np.concatenate([np.zeros(0, RECORD), *(records_of(found.sets[k], found.keys[k]) for k in items.tolist())])
        return parcels(block, records, prefixes(records["string"], matched_depth()) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), n)

    def bucket(found: pa.Table) -> pa.Table:
        records, left, right = matches(np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for x in found.column("records")]))
        if not len(left):
            return _table([], schema)
        # of the links of all trees, as many as connect the classes: each with the least one
        by_key = np.lexsort((records["own"]["b"], records["own"]["a"]))
        number = np.empty(len(records), np.int64)
        number[by_key] = np.cumsum(np.concatenate([[False], ~alike(records["own"][by_key])]))
        label = np.arange(number[by_key[-1]] + 1)
        _joined(label, number[left], number[right])
        linked = np.unique(number[np.concatenate([left, right])])
        place = np.empty(len(label), np.int64)
        place[number] = np.arange(len(records))
        least, each = records[place[label[linked]]], records[place[linked]]
        return pa.table([pa.array(_packed(least["own"]), pa.binary()), pa.array(_packed(each["own"]), pa.binary()), pa.array(each["n"].astype(np.int64))], schema=schema)

    again = later(_first_entries(own, n))
    return per_block(own, again, send_strings, ENTRIES).groupBy("bucket").applyInArrow(bucket, EDGES)


def _told_places(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """TOLD rows of kind "set" for the blocks that hold the classes' first documents. placed: bucket, node, root, part, parts."""
    schema = arrow_schema(TOLD)

    def bucket(found: pa.Table, given: pa.Table) -> pa.Table:
        if not given.num_rows or not found.num_rows:
            return _table([], schema)
        records, block = firsts(found)
        order = np.lexsort((block, records["order"], records["key"]["b"], records["key"]["a"]))
        order = order[np.concatenate([[True], ~alike(records["key"][order])])]
        known, node = records["key"][order], _opened(given.column("node"))
        both = np.concatenate([known, node])
        rank = np.lexsort((np.repeat([0, 1], [len(known), len(node)]), both["b"], both["a"]))
        at = np.empty(len(rank), np.int64)
        at[rank] = np.maximum.accumulate(np.where(rank < len(known), rank, 0))  # places of `known` grow with their keys
        at = order[at[len(known) :]]
        out = np.zeros(len(node), PLACED)
        out["item"], out["root"] = records["item"][at], _opened(given.column("root"))
        out["part"], out["parts"] = (given.column(c).to_numpy() for c in ("part", "parts"))
        return _table([(int(b), "set", out[block[at] == b].tobytes()) for b in np.unique(block[at])], schema)

    return entries.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(bucket, TOLD)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members the sets have in common, pair by pair; `left` is sorted."""
    size = np.array([len(s) for s in sets])
    base, own = None, sets
    if len(sets) > 7:  # sets as what they have more and less than one of them, if that is less
        changed = [np.setxor1d(sets[0], s, assume_unique=True) for s in sets]
        if 2 * sum(map(len, changed)) < size.sum():
            base, own = sets[0], changed
    n = np.array([len(s) for s in own])
    starts, members = np.cumsum(n) - n, np.concatenate(own)
    hits = np.zeros(len(left), np.int64)
    edges = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        mine, count = own[left[s]], n[right[s:e]]
        ends = np.cumsum(count)
        if not len(mine) or not ends[-1]:
            continue
        other = members[np.repeat(starts[right[s:e]] - ends + count, count) + np.arange(ends[-1])]
        hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        sums = np.concatenate([[0], np.cumsum(hit)])
        hits[s:e] = sums[ends] - sums[ends - count]
    if base is None:
        return hits
    return (size[left] + size[right] - (n[left] + n[right] - 2 * hits)) // 2


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives all that the links connect, to the labels so far too, the least label."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _tile(items: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    """FOUND rows of a tile: how many links each class has, and links that connect all that are linked."""
    m, most, n = len(items), most_differing(), items["n"].astype(np.int64)
    same = items["lo"][0] == items["hi"][0]
    first = m if same else int(np.searchsorted(items["part"], items["hi"][0]))  # items come by part
    label, count, step = np.arange(m), np.zeros(m, np.int64), max(1, CHUNK // m)
    for start in range(0, first, step):
        rows = np.arange(start, min(first, start + step))
        x, y = np.repeat(rows, m), np.tile(np.arange(m), len(rows))
        some = np.flatnonzero(y > x if same else y >= first)
        x, y = x[some], y[some]
        some = np.flatnonzero((4 * np.maximum(n[x], n[y]) <= 5 * np.minimum(n[x], n[y])) & (differing(items["bits"][x], items["bits"][y]) <= most))
        x, y = x[some], y[some]
        for at in range(0, len(x), CHUNK >> 4):
            left, right = x[at : at + (CHUNK >> 4)], y[at : at + (CHUNK >> 4)]
            good = _common(sets, left, right) >= needed(n[left], n[right])
            left, right = left[good], right[good]
            count += np.bincount(left, minlength=m) + np.bincount(right, minlength=m)
            _joined(label, left, right)
    names = _packed(items["own"])
    whole = bool(items["parts"][0] == 1)
    out = [(names[k], None, int(count[k]), whole) for k in np.flatnonzero(count)]
    return out + [(names[k], names[label[k]], 0, whole) for k in np.flatnonzero(label != np.arange(m))]


def links(docs: DataFrame, block_bytes: int | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """FOUND, as a table: rows with v are links between classes of different sets, enough to connect all that are linked; rows without v count u's links. `whole` says of a link that no other
    tile can have one of its group. docs: key, text."""
    n = blocks_for(scan_bytes(docs, "text"), *([block_bytes] if block_bytes else []))
    own = in_blocks(docs, n)
    edges = written(candidates(own, n), "edges")
    roots = components(edges)
    sized = roots.join(edges.groupBy("v").agg(F.max("n").alias("n")), F.col("node") == F.col("v"))
    groups = sized.groupBy("root").agg(F.ceil(8 * F.sum("n") / tile_bytes).cast("int").alias("parts"))
    bucket = (F.conv(F.hex(F.substring("node", 1, 8)), 16, 10).cast("decimal(20,0)") % n).cast("int")
    placed = sized.join(groups, "root").select(bucket.alias("bucket"), "node", "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts", "n")
    placed = written(placed, "placed")
    forget(roots)
    forget(edges)
    places = blocks_for(placed.agg(F.sum(8 * F.col("n") * F.col("parts"))).first()[0] or 0, tile_bytes)

    def serve(block: int, rows: pa.Table, told: pa.Table) -> list[tuple]:
        asked = told_items(told, "set", PLACED)
        if not len(asked):
            return []
        found = Classes(_rows(rows))
        items, which = [], []
        for a in asked:
            out = np.zeros(a["parts"], ITEM)
            other = np.arange(a["parts"], dtype=np.uint32)
            out["root"], out["part"], out["parts"], out["own"], out["n"] = a["root"], a["part"], a["parts"], found.keys[a["item"]], found.n[a["item"]]
            out["lo"], out["hi"], out["bits"] = np.minimum(other, a["part"]), np.maximum(other, a["part"]), signature(found.sets[a["item"]])[1]
            items.append(out)
            which.append(np.full(len(out), a["item"], np.int64))
        item, which = np.concatenate(items), np.concatenate(which)
        with np.errstate(over="ignore"):
            tile = item["root"]["a"] + item["lo"] * np.uint64(0x9E3779B97F4A7C15) + item["hi"] * np.uint64(0xC2B2AE3D27D4EB4F)
        place = ((tile ^ (tile >> np.uint64(31))) % np.uint64(places)).astype(np.int64)
        out = []
        for p in np.unique(place).tolist():
            at = np.flatnonzero(place == p)
            out.append((p, item[at].tobytes(), np.concatenate([found.sets[k] for k in which[at]]).tobytes()))
        return out

    kinds = arrow_schema(FOUND)

    def verify(given: pa.Table) -> pa.Table:
        item = np.concatenate([np.frombuffer(x.as_buffer(), ITEM) for x in given.column("items")])
        members = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in given.column("members")])
        starts = np.cumsum(item["n"], dtype=np.int64) - item["n"]
        order = np.lexsort((item["own"]["b"], item["own"]["a"], item["part"], item["hi"], item["lo"], item["root"]["b"], item["root"]["a"]))
        item, starts = item[order], starts[order]
        edge = np.zeros(len(item) + 1, bool)
        edge[0] = edge[-1] = True
        for f in ("root", "lo", "hi"):
            edge[1:-1] |= item[f][1:] != item[f][:-1]
        edge = np.flatnonzero(edge)
        rows = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            rows += _tile(item[s:e], [members[a : a + k] for a, k in zip(starts[s:e], item["n"][s:e].tolist(), strict=True)])
        return _table(rows, kinds)

    told = _told_places(_first_entries(own, n), placed.drop("n"))
    found = written(per_block(own, told, serve, SENT).groupBy("place").applyInArrow(verify, FOUND), "found")
    forget(placed)
    return found


def _with_key(df: DataFrame, text: str, name: str) -> DataFrame:
    """df's columns and one of that name, the key of the shingle set of the text."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` binary"])
    schema, at = arrow_schema(ddl), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys = [set_key(s) for s in shingle_sets([(t or "").encode() for t in part.column(at).to_pylist()])]
                packed = [a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in keys]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], schema=schema)

    return df.mapInArrow(run, ddl)


def _known(own: DataFrame, sets: DataFrame, block_bytes: int | None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per class: u, class_id, text_id, n_copies, n_links, and lead, the class that stands for the group. own: key, text; sets: key, u."""
    classes = sets.groupBy("u").agg(F.min("key").alias("text_id"), F.count("*").alias("n_copies"))
    found = links(own, block_bytes, tile_bytes)
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n_links"))
    roots = found.where("v IS NOT NULL AND whole").select("u", F.col("v").alias("root"))
    roots = roots.unionByName(components(found.where("v IS NOT NULL AND NOT whole")).withColumnRenamed("node", "u"))
    known = classes.join(roots, "u", "left").join(counts, "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "u")).alias("least"))
    known = known.join(least, "root")
    return known.select("u", F.col("least.text_id").alias("class_id"), "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("u") == F.col("least.u")).alias("lead"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per row: doc_id, class_id (the least id of all documents connected by copies and links), text_id (the least id with the same shingles), n_copies (rows with the
    same shingles), n_links (different shingle sets of Jaccard similarity 0.8 or more).

    Null and empty texts, and those of white space alone, have no shingles: they are copies of each other and have no links. Null ids count as greater than all
    others; a class that has only null ids has a null class_id.
    """
    own = columns(docs, key=f"{id_col}:long", text=text_col)
    sets = written(_with_key(own, "text", "u").select("key", "u"), "sets")
    known = _known(own, sets, block_bytes, tile_bytes)
    return sets.join(known, "u").select(F.col("key").alias("doc_id"), "class_id", "text_id", "n_copies", "n_links")


def representatives(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """One row of docs for each group of near-duplicates: the one with the least doc_id. docs: doc_id, text and any others, which stay as they are."""
    docs, names = positional(docs), docs.columns
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    own = docs.select(key.cast("long").alias("key"), text.cast("string").alias("text"))
    sets = written(_with_key(own, "text", "u").select("key", "u"), "sets")
    leads = _known(own, sets, block_bytes).where("lead").select("u", "text_id")
    chosen = sets.join(leads, "u").where("key <=> text_id").select("key", "u").distinct()
    often = sets.groupBy("key").count().where("count > 1").select("key")  # ids of several rows
    once = written(chosen.join(often, chosen["key"].eqNullSafe(often["key"]), "left_anti"), "once")
    kept = docs.join(once, key.cast("long").eqNullSafe(once["key"]), "left_semi")
    rest = docs.join(often, key.cast("long").eqNullSafe(often["key"]), "left_semi").withColumns({"key": key.cast("long"), "text": text.cast("string")})
    rest = _with_key(rest, "text", "u")
    rest = rest.join(chosen, rest["key"].eqNullSafe(chosen["key"]) & (rest["u"] == chosen["u"]), "left_semi").dropDuplicates(["key", "u"])
    return kept.unionByName(rest.select(docs.columns)).toDF(*names)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
