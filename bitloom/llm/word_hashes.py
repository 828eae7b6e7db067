"""Hashes of all words of many texts at once, from their bytes, without an object for any word.

A word is a run of bytes other than ASCII white space. Its 32-bit units and its length, each times a random 64-bit number, are added up modulo 2^64, of which the
upper half counts; 64 bits of a hash are two such sums with numbers of their own. This family is strongly universal: two different words have equal hashes for one
in 2^64 choices of the numbers (2^128 for both halves), whatever their structure, as long as they weren't made with knowledge of the numbers. Words of
more bytes than there are numbers for go through XXH3 with a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# ASCII white space as the contracts have it.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word that there are numbers for, and the seed of these.
LONGEST, SEED = 32, 0xB17
#: Bytes hashed together; a longer word is hashed alone.
STRETCH = 1 << 15
#: by sum, two sums to a half: for the start, the length, and each unit
NUMBERS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (4, 2 + LONGEST // 4), dtype=np.uint64)
#: by bytes left of a word, the bits of them
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
UPPER = np.uint64(0xFFFFFFFF00000000)


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
        return x ^ (x >> np.uint64(29))


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The texts, joined by line breaks, in stretches that end at white space, each with its place."""
    whole = b"\n".join(texts)
    at = 0
    while at < len(whole):
        end = min(len(whole), at + STRETCH)
        while end < len(whole) and not BLANK[whole[end]]:
            end += 1
        yield at, whole[at:end]
        at = end


def _hashed(part: bytes, first: np.ndarray, length: np.ndarray, halves: int) -> np.ndarray:
    """Hashes of the words of a stretch that begin at `first`."""
    eights = np.ndarray(len(part), "<u8", part + bytes(8), strides=(1,))  # eight bytes from every place
    numbers = NUMBERS[: 2 * halves]
    with np.errstate(over="ignore"):
        sums = [n[0] + length.astype(np.uint64) * n[1] for n in numbers]
        longest = min(int(length.max(initial=0)), LONGEST)
        for k in range(0, longest, 8):
            some = slice(None) if k == 0 else np.flatnonzero(length > k)
            units = eights[first[some] + k] & MASKS[np.minimum(length[some] - k, 8)]
            low, high = units & MASKS[4], units >> np.uint64(32)
            for total, n in zip(sums, numbers, strict=True):
                total[some] += low * n[2 + k // 4] + high * n[3 + k // 4]
    out = np.stack([(sums[h] & UPPER) | (sums[h + 1] >> np.uint64(32)) for h in range(0, len(sums), 2)])
    for k in np.flatnonzero(length > LONGEST).tolist():
        whole = xxhash.xxh3_128_intdigest(part[first[k] : first[k] + length[k]], SEED)
        out[:, k] = [whole >> 64, whole & 0xFFFFFFFFFFFFFFFF][:halves]
    return out


class Words:
    """The words of texts, in order. With spans, `begin` and `size` say where each stands in the texts joined by line breaks."""

    def __init__(self, texts: list[bytes], halves: int = 2, spans: bool = False):
        starts, lengths, lines, hashes, before = [], [], [], [], 0
        for at, part in _stretches(texts):
            data = np.frombuffer(part, np.uint8)
            blank = BLANK[data]
            turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
            turns = np.concatenate([[] if blank[0] else [0], turns, [] if blank[-1] else [len(data)]]).astype(np.int64)
            first, last = turns[::2], turns[1::2]
            breaks = np.flatnonzero(data == 10)
            starts.append(first + at)
            lengths.append(last - first)
            lines.append(np.searchsorted(breaks, first) + before)
            before += len(breaks)
            hashes.append(_hashed(part, first, last - first, halves))
        put = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        #: rows of 64-bit hashes
        self.hashes = np.concatenate(hashes, axis=1) if hashes else np.zeros((halves, 0), np.uint64)
        if spans:
            self.begin, self.size = put(starts), put(lengths)
        #: number of each word's line among the lines of all texts
        self.line = put(lines)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        #: by text: its first word; one more entry at the end
        self.first = np.searchsorted(put(starts), np.concatenate([[0], np.cumsum(sizes)]))

    def of(self, text: int) -> np.ndarray:
        return self.hashes[:, self.first[text] : self.first[text + 1]]
