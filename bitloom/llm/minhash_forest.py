"""MinHash LSH forest: prefix tries of signatures as sorted strings, searched from the longest prefixes to shorter ones.

Each set has a string of labels for each tree: MinHashes, cut to a few bits. Sorted strings are a trie; two sets match at the length of their common prefix. A search begins
with whole strings and shortens prefixes until a similar pair is matched in some tree with the target recall. How far that is follows from the size of
a set: it bounds from below the similarity that a different set can have with it if it reaches the threshold at all, and at a greater similarity longer prefixes are enough.

Sets that match are compared by sketches, one bit for each MinHash: a sketch of a similar set differs in few bits but for a chance of TAIL. Sketches are points of a metric space, so
sets that match needn't be compared in pairs: leaders are, and each other set lies near one.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from bitloom.llm.block_join import needed
from bitloom.llm.key_exchange import PAIR

TREES, DEPTH, LABEL = 24, 6, 9
RECALL, SIMILARITY = 0.9999, 0.8
#: A string: tree, labels, and the depth at which the search for this set's partners ends.
SPARE = 64 - 5 - DEPTH * LABEL
RECORD = np.dtype([("string", "<u8"), ("bits", "<u8", (2,)), ("n", "<u4"), ("own", PAIR)])
BITS, TAIL, NEAR = 128, 1e-6, 4
#: Members hashed together, and pairs compared together, in one array.
PART, CHUNK = 4096, 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20))
FACTORS = _RANDOM.integers(1, 1 << 63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, (TREES, DEPTH), dtype=np.uint64)


def recall(depth: int, similarity: float = SIMILARITY, trees: int = TREES) -> float:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(similarity: float = SIMILARITY, target: float = RECALL) -> int:
    """The prefix length, shortened from whole strings until the target is reached."""
    depth = DEPTH
    while depth > 1 and recall(depth, similarity) < target:
        depth -= 1
    return depth


@cache
def depth_for(n: int) -> int:
    """Where the search ends for a set of n members: at the least similarity, of those that reach the threshold, that a different set can have with it."""
    least = 1.0
    for b in range(-(-4 * n // 5), 5 * n // 4 + 1):
        o = int(needed(np.int64(n), np.int64(b)))
        if o < max(n, b) and o <= min(n, b):
            least = min(least, o / (n + b - o))
    return matched_depth(least) if n < 100 else matched_depth()


@cache
def most_differing(similarity: float = SIMILARITY, tail: float = TAIL) -> int:
    """So many bits of the sketches of sets of this similarity differ at most, but for the chance of the tail."""
    p = (1 - similarity) / 2
    left = 1.0
    for k in range(BITS):
        left -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if left < tail:
            return k
    return BITS


def labels(members: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """MinHashes by tree and level."""
    out = np.full((TREES, depth), np.iinfo(np.uint64).max, np.uint64)
    factors, shifts = FACTORS[:, :depth, None], SHIFTS[:, :depth, None]
    with np.errstate(over="ignore"):
        spread = (members ^ (members >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        for k in range(0, len(spread), PART):
            np.minimum(out, (factors * spread[k : k + PART] + shifts).min(2), out=out)
    return out


def signature(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's strings, one for each tree, without the end of the search; and its sketch."""
    with np.errstate(over="ignore"):
        hashed = labels(members)
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    strings = np.arange(TREES, dtype=np.uint64)
    for k in range(DEPTH):
        strings = (strings << np.uint64(LABEL)) | (hashed[:, k] >> np.uint64(64 - LABEL))
    bits = np.packbits((hashed.ravel()[:BITS] >> np.uint64(40)).astype(np.uint8) & 1).view("<u8")
    return strings << np.uint64(SPARE), bits


def prefixes(strings: np.ndarray, depth: int) -> np.ndarray:
    return strings >> np.uint64(SPARE + (DEPTH - depth) * LABEL)


def records_of(members: np.ndarray, own: np.void) -> np.ndarray:
    out = np.zeros(TREES, RECORD)
    strings, out["bits"] = signature(members)
    out["string"] = strings | np.uint64(depth_for(min(len(members), 100)))
    out["n"], out["own"] = len(members), own
    return out


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64).sum(-1)


def _connected(records: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between records of equal run that connect all whose sketches are those of similar sets: of each record to a leader near it, and of leaders."""
    n = len(records)
    leader, rest = np.arange(n), np.arange(n)
    while len(rest):
        first = np.concatenate([[True], run[rest][1:] != run[rest][:-1]])
        led = rest[first][np.cumsum(first) - 1]
        near = differing(records["bits"][rest], records["bits"][led]) <= NEAR
        leader[rest[near]] = led[near]
        rest = rest[~near]
    left, right = [leader], [np.arange(n)]
    leaders = np.unique(leader)
    own = run[leaders]
    ends = np.searchsorted(own, own, "right")
    count = ends - np.arange(len(own)) - 1
    sums = np.cumsum(count)
    start, most = 0, most_differing() + 2 * NEAR
    while start < len(own):
        done = sums[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sums, done + CHUNK, "right")))
        x = np.repeat(np.arange(start, end), count[start:end])
        y = x + 1 + np.arange(len(x)) - np.repeat(sums[start:end] - count[start:end] - done, count[start:end])
        good = differing(records["bits"][leaders[x]], records["bits"][leaders[y]]) <= most
        left.append(leaders[x[good]])
        right.append(leaders[y[good]])
        start = end
    x, y = np.concatenate(left), np.concatenate(right)
    return x[x != y], y[x != y]


def matches(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted, and links between them (places) that connect all that match. The search goes from whole strings to shorter prefixes, as long as sets call for it."""
    records = records[np.lexsort((records["own"]["b"], records["own"]["a"], records["string"] >> np.uint64(SPARE)))]
    ends = (records["string"] & np.uint64((1 << SPARE) - 1)).astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth in range(DEPTH, matched_depth() - 1, -1):
        some = np.flatnonzero(ends <= depth)
        prefix = prefixes(records["string"][some], depth)
        alike = prefix[1:] == prefix[:-1]
        some = some[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])] if len(some) else some
        if not len(some):
            continue
        prefix = prefixes(records["string"][some], depth)
        # of equal prefixes, the least key leads, in whatever tree
        order = np.lexsort((records["own"]["b"][some], records["own"]["a"][some], prefix))
        some, prefix = some[order], prefix[order]
        x, y = _connected(records[some], np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]])))
        left.append(some[x])
        right.append(some[y])
    return records, np.concatenate(left), np.concatenate(right)
