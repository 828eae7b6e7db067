import random

import numpy as np
import xxhash

from bitloom.llm import word_hashes as w


def plain(word, half):
    if len(word) > w.LONGEST:
        return xxhash.xxh3_128_intdigest(word, w.SEED) >> (0 if half else 64) & 0xFFFFFFFFFFFFFFFF
    units = [int.from_bytes(word[k : k + 4], "little") for k in range(0, len(word), 4)]
    upper = [(int(n[0]) + len(word) * int(n[1]) + sum(u * int(m) for u, m in zip(units, n[2:], strict=False))) % (1 << 64) >> 32 for n in w.NUMBERS[2 * half : 2 * half + 2]]
    return upper[0] << 32 | upper[1]


def test_hashes_are_sums_of_products_wherever_words_stand(monkeypatch):
    monkeypatch.setattr(w, "STRETCH", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bé", " ", "\n", "\t", "\x0b", "z" * 70, "0123456789abc", "\0", " ", "\x1c"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(30)] + [b"", b"  "]
    found = w.Words(texts)
    at = 0
    for k, text in enumerate(texts):
        words = text.split()
        assert found.of(k).T.tolist() == [[plain(x, 0), plain(x, 1)] for x in words]
        lines = [j for j, line in enumerate(text.split(b"\n")) for _ in line.split()]
        assert (found.line[found.first[k] : found.first[k + 1]] - at).tolist() == lines
        at += text.count(b"\n") + 1


def test_no_texts():
    assert w.Words([]).hashes.shape == (2, 0) and w.Words([b""], 1).of(0).shape == (1, 0)


def alternating(n, swap):
    """The Thue-Morse word and its complement, which polynomials modulo a power of two can't tell apart."""
    return "".join("ab"[bin(k).count("1") + swap & 1] for k in range(n))


def test_words_of_a_pattern_differ():
    words = [alternating(n, s).encode() for n in (8, 16, 32, 64, 1024, 1 << 16) for s in (0, 1)]
    words += [b"a" * n for n in range(1, 70)] + [b"a" * n + b"\0" for n in range(1, 70)]
    found = w.Words([b" ".join(words)]).hashes
    assert len(np.unique(found[0])) == len(np.unique(found[1])) == len(words)


def test_hashes_of_many_words_differ():
    words = [str(k).encode() for k in range(200_000)]
    assert len(np.unique(w.Words([b" ".join(words)], 1).hashes[0])) == len(words)
