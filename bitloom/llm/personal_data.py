"""Personal data by a semi-Markov conditional random field.

A text is cut to regions around @ signs and digits; elsewhere nothing can be an entity and the model's choice is fixed. In a
region, candidate segments run from token to token, with a bounded number of tokens for each entity. Features belong to whole segments:
shape, number of digits, checks such as Luhn's, what stands before and after, the word before. Dynamic programming over segment
ends, with the type of the segment before, chooses boundaries and types together (Viterbi); the same recursion in sums gives the likelihood.

The model is fitted by gradient steps on invented sentences, made by rule from a seed, in which entities, written in
common and less common ways, and look-alikes that are none are known. Spans that the base patterns find always stay; the model adds spans.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.tables import columns, map_rows, table

# The base patterns and the order of kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OTHER = 4
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\s+")
#: What an entity may hold; a region is a stretch of it that has an @, the word "at" in brackets or before a "dot", or digits.
NUMBERS = re.compile(r"[0-9][0-9\x20().+\-\[\]/]*")
AT = re.compile(r"[\[({]\s?at\s?[\])}]|(?<=\s)at(?=\s[\w-]+\sdot\s)", re.I)
#: What stands after the "at" of an address that is written out.
HOST = re.compile(r"\s?[\w.-]*(?:\s?(?:[\[({]\s?dot\s?[\])}]|(?<=\s)dot(?=\s))\s?[\w-]+)*", re.I)
MAX_TOKENS = {0: 24, 1: 13, 2: 9, 3: 13}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the pattern for addresses, found from the @ signs: no run of characters is gone through twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) of base matches, by kind and start."""
    found = []
    found += [(0, a, b) for a, b in emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m.group().split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() - m.group().count(" ") - m.group().count("-") <= 19 and luhn(digits_of(m.group())):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


EMAIL_SHAPE = re.compile(r"[\w.%+-]+\s?(?:@|[\[({]\s?at\s?[\])}]|(?<=\s)at(?=\s))\s?[\w-]+(?:\s?(?:\.|[\[({]\s?dot\s?[\])}]|(?<=\s)dot(?=\s))\s?[\w-]+)+", re.I)
IP_SHAPE = re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}")
PHONE_SHAPES = (
    ("intl", re.compile(r"\+[0-9][0-9\x20().-]*[0-9]")),
    ("zeros", re.compile(r"00[1-9][0-9]{0,2}[\x20.-][0-9\x20().-]*[0-9]")),
    ("us", re.compile(r"\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}")),
    ("groups", re.compile(r"0[0-9]{1,4}(?:[\x20./-][0-9]{2,4}){2,5}")),
)
CARD_SHAPE = re.compile(r"[0-9]{4}(?:[\x20.-][0-9]{4}){3}|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}|[0-9]{13,19}")
# Words that announce an entity.
CUES = {
    0: frozenset("mail email e contact write to address".split()),
    1: frozenset("ip host server address addr from".split()),
    2: frozenset("card visa mastercard credit cc amex payment".split()),
    3: frozenset("phone tel call fax mobile cell telephone number whatsapp".split()),
}
TOPS = frozenset("com org net edu gov io info biz de fr es it uk nl eu us ca".split())
DENY = frozenset("id no version v order invoice isbn ref build serial page item part".split())


def features(kind: int, text: str, start: int, end: int, before: str) -> list[str]:
    """Names of the features of a segment of an entity kind. before: the word before it, in lower case."""
    body, name = text[start:end], KINDS[kind]
    digits = digits_of(body)
    near = text[start - 1 : start] if start else " "
    after = text[end : end + 1] or " "
    follow = text[end + 1 : end + 2]
    glued = near.isalnum() or near in "_@" or after.isalnum() or after in "_@" or (after in ".-:" and follow.isalnum() and kind != 0) or (near in ".-/:+" and start > 1 and text[start - 2].isalnum())
    out = [name, f"{name}:glued{int(glued)}"]
    if before in CUES[kind]:
        out.append(f"{name}:cue")
    if before in DENY:
        out.append(f"{name}:deny")
    if kind == 0:
        whole = bool(EMAIL_SHAPE.fullmatch(body))
        tail = re.search(r"[A-Za-z]{2,24}$", body)
        out += [f"email:shape{int(whole)}", f"email:top{int(bool(tail))}", f"email:at{int('@' in body)}", f"email:known{int(body.rpartition(' ')[2].rpartition('.')[2].lower() in TOPS)}"]
    elif kind == 1:
        shape = bool(IP_SHAPE.fullmatch(body))
        parts = re.findall("[0-9]+", body)
        out += [f"ip:shape{int(shape)}", f"ip:range{int(len(parts) == 4 and all(int(p) <= 255 for p in parts))}", f"ip:zero{int(any(len(p) > 1 and p[0] == '0' for p in parts))}"]
    elif kind == 2:
        out += [f"card:shape{int(bool(CARD_SHAPE.fullmatch(body)))}", f"card:luhn{int(13 <= len(digits) <= 19 and luhn(digits))}", f"card:head{int(digits[:1] in set('3456'))}"]
    else:
        shape = next((n for n, p in PHONE_SHAPES if p.fullmatch(body)), "none")
        out += [f"phone:{shape}", f"phone:size{int(9 <= len(digits) <= 15)}", f"phone:even{int(body.count('(') == body.count(')'))}"]
    return out


class Region:
    """A stretch of text as a lattice: tokens, and the segments that could be entities with their features."""

    def __init__(self, text: str, start: int, end: int):
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
        self.n, self.tokens = len(tokens), tokens
        address = text.find("@", start, end) >= 0 or AT.search(text, start, end) is not None
        before = re.search(r"([^\W\d_]+)\W*$", text[max(0, start - 30) : start])
        word = before[1].lower() if before else ""
        #: by the token it ends before: (first token, kind, features)
        self.ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(self.n + 1)]
        for i, (a, _) in enumerate(tokens):
            head = text[a]
            if head.isspace():
                continue
            for j in range(i + 1, min(self.n, i + max(MAX_TOKENS.values())) + 1):
                b = tokens[j - 1][1]
                last = text[b - 1]
                if not last.isalnum() or last.isspace():
                    continue
                for kind in range(0 if address else 1, 4):
                    if j - i <= MAX_TOKENS[kind] and _possible(kind, text, a, b):
                        self.ending[j].append((i, kind, features(kind, text, a, b, word)))
            if head.isalpha() or head == "_":
                word = text[a : tokens[i][1]].lower()


LEFT_OF_IP = str.maketrans("", "", "0123456789.[]()")


def _possible(kind: int, text: str, a: int, b: int) -> bool:
    """Whether a segment may be of the kind at all: the model's support. It is wider than the base patterns."""
    body = text[a:b]
    if kind == 0:
        return "@" in body or AT.search(text, a, b) is not None
    if not ("0" <= body[-1] <= "9"):
        return False
    n = sum("0" <= c <= "9" for c in body)
    if kind == 1:
        return 4 <= n <= 12 and body.count(".") >= 3 and body.translate(LEFT_OF_IP) == ""
    if kind == 2:
        return 12 <= n <= 19 and "(" not in body and "+" not in body
    return 7 <= n <= 15 and (not body.isdigit() or body[0] in "0+")


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


class Model:
    """Weights of features and of neighbouring types."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def arcs(self, region: Region, j: int) -> Iterator[tuple[int, int, list[str]]]:
        """Segments that end before token j: one token of no kind, or a candidate."""
        yield j - 1, OTHER, []
        yield from region.ending[j]

    def best(self, region: Region) -> list[tuple[int, int, int]]:
        """The likeliest entities: (kind, start, end)."""
        top = [{OTHER: (0.0, None)}]
        for j in range(1, region.n + 1):
            here: dict[int, tuple[float, tuple | None]] = {}
            for i, kind, names in self.arcs(region, j):
                own = self.score(names)
                for last, (value, _) in top[i].items():
                    v = value + own + self.weights.get(f"{last}>{kind}", 0.0)
                    if kind not in here or v > here[kind][0]:
                        here[kind] = (v, (i, last))
            top.append(here)
        out, j = [], region.n
        kind = max(top[j], key=lambda k: top[j][k][0])
        while j:
            i, last = top[j][kind][1]
            if kind != OTHER:
                out.append((kind, region.tokens[i][0], region.tokens[j - 1][1]))
            j, kind = i, last
        return out[::-1]

    def gradient(self, region: Region, gold: dict[tuple[int, int], int]) -> tuple[float, dict[str, float]]:
        """Log-likelihood of the gold segmentation {(first token, end token): kind}, and its gradient."""
        ahead: list[dict[int, float]] = [{OTHER: 0.0}]
        lattice = []
        for j in range(1, region.n + 1):
            sums: dict[int, list[float]] = {}
            for i, kind, names in self.arcs(region, j):
                own = self.score(names)
                for last, value in ahead[i].items():
                    pair = f"{last}>{kind}"
                    lattice.append((i, j, last, kind, own + self.weights.get(pair, 0.0), [*names, pair]))
                    sums.setdefault(kind, []).append(value + lattice[-1][4])
            ahead.append({k: _logsum(v) for k, v in sums.items()})
        behind: list[dict[int, float]] = [{} for _ in range(region.n + 1)]
        behind[region.n] = dict.fromkeys(ahead[region.n], 0.0)
        back: dict[tuple[int, int], list[float]] = {}
        for i, j, last, kind, own, _ in sorted(lattice, key=lambda x: -x[0]):
            if kind not in behind[j]:
                behind[j][kind] = _logsum(back[j, kind])
            back.setdefault((i, last), []).append(own + behind[j][kind])
        whole = _logsum(list(ahead[region.n].values()))
        slope: dict[str, float] = {}
        for i, j, last, kind, own, names in lattice:
            p = math.exp(ahead[i][last] + own + behind[j][kind] - whole)
            for n in names:
                slope[n] = slope.get(n, 0.0) - p
        value, j, last = -whole, 0, OTHER
        ends = {i: (e, k) for (i, e), k in gold.items()}
        while j < region.n:
            e, kind = ends.get(j, (j + 1, OTHER))
            names = next(n for i, k, n in self.arcs(region, e) if i == j and k == kind) + [f"{last}>{kind}"]
            value += sum(self.weights.get(n, 0.0) for n in names)
            for n in names:
                slope[n] = slope.get(n, 0.0) + 1
            j, last = e, kind
        return value, slope


def regions(text: str) -> Iterator[Region]:
    """Stretches that could hold entities, widened by what touches them. No part of the text is gone through more than twice."""
    found, free = [m.span() for m in NUMBERS.finditer(text)], 0
    k = text.find("@")
    while k >= 0:
        start, end = k, k + 1
        while start > free and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] != "@":
            end += 1
        found.append((start, end))
        free = end
        k = text.find("@", end)
    free = 0
    for m in AT.finditer(text):
        start = m.start()
        start -= start > free and text[start - 1].isspace()
        while start > free and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        free = HOST.match(text, m.end()).end()
        found.append((start, free))
    at, merged = 0, []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    for a, b in merged:
        for _ in range(2):
            a -= a > at and text[a - 1] in "+("
        if text.find("@", a, b) < 0 and not AT.search(text, a, b) and sum("0" <= c <= "9" for c in text[a:b]) < 4:
            continue
        at = b
        yield Region(text, a, b)


def _invented(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence with known entities and look-alikes."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + number(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", " ", "-"])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        area, mid, last = str(rng.randint(200, 999)), number(3), number(4)
        return rng.choice([f"+1 ({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+{rng.randint(20, 99)} {number(3)} {number(3)} {number(3)}", f"0{rng.randint(10, 999)} {number(3)} {number(2)} {number(2)}", f"00{rng.randint(20, 99)} {number(3)} {number(6)}"])

    def email() -> str:
        name, host, top = rng.choice([word(), f"{word()}.{number(2)}", f"{word()}_{word()}"]), word(), rng.choice(["com", "org", "net", "co.uk", "de"])
        return rng.choice([f"{name}@{host}.{top}", f"{name}@{word()}.{host}.{top}", f"{name} [at] {host} [dot] {top.split('.')[-1]}", f"{name}(at){host}.{top}", f"{name} at {host} dot {top.split('.')[-1]}"])

    def ip() -> str:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts)])

    def bad_card() -> str:
        body = number(16)
        return body if not luhn(body) else bad_card()

    decoys = [lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: number(rng.randint(4, 12)), bad_card, lambda: f"{number(3)}.{rng.randint(256, 999)}.{number(2)}.{number(1)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}.{number(1)}", lambda: f"order {number(3)}-{number(3)}-{number(4)}", lambda: f"{number(2)}.{number(2)}.{number(2)}.{number(2)}.{number(2)}", lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{number(4)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(12)}", lambda: f"{number(4)} {number(4)}", lambda: f"{word()}{number(6)}{word()}", lambda: f"{number(3)},{number(3)},{number(3)}", lambda: f"{number(3)} {number(3)} {number(3)}"]
    text, found = word(), []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([0, 1, 2, 3, OTHER, OTHER])
        cue = rng.choice(sorted(CUES.get(kind, DENY))) if rng.random() < 0.3 else word()
        text += f" {word()} {cue}{rng.choice([' ', ' ', ': '])}"
        body = [email, ip, card, phone][kind]() if kind != OTHER else rng.choice(decoys)()
        if kind != OTHER:
            found.append((kind, len(text), len(text) + len(body)))
        text += body + rng.choice([" ", ", ", ". ", "### "]) + word()
    return text, found


def fit(sentences: int = 600, rounds: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adaptive gradient steps on the likelihood of invented sentences."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, found = _invented(rng)
        for region in regions(text):
            first, last = {a: k for k, (a, _) in enumerate(region.tokens)}, {b: k + 1 for k, (_, b) in enumerate(region.tokens)}
            gold = {(first[a], last[b]): kind for kind, a, b in found if a in first and b in last and any(i == first[a] and k == kind for i, k, _ in region.ending[last[b]])}
            data.append((region, gold))
    model, size = Model({}), {}
    for _ in range(rounds):
        rng.shuffle(data)
        for region, gold in data:
            if not any(region.ending):
                continue
            _, slope = model.gradient(region, gold)
            for name, g in slope.items():
                g -= decay * model.weights.get(name, 0.0)
                size[name] = size.get(name, 1e-3) + g * g
                model.weights[name] = model.weights.get(name, 0.0) + rate * g / math.sqrt(size[name])
    return model


@cache
def fitted() -> Model:
    return fit()


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and the model's that lie in none of them and hold none; (rank of kind, start, end), sorted."""
    base = base_spans(text)
    every = set(base)
    for region in regions(text):
        if any(region.ending):
            for kind, a, b in model.best(region):
                if not any(x < b and a < y for _, x, y in base):
                    every.add((kind, a, b))
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and all spans as arrays of (kind, start, end), in code points.

    A null text counts as empty and has no spans; repeated rows give repeated rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model or fitted()).weights)  # as many numbers as there are feature names above

    def make():
        own = Model(shared.value)

        def each(key: int | None, text: str | None) -> Iterator[tuple]:
            base, every = find(text or "", own)
            yield key, *([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in (base, every))

        return each

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_rows(columns(docs, key=f"{id_col}:long", text=text_col), make, f"doc_id long, base {span}, spans {span}")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(base, x -> x.kind = '{k}')) as long) AS n_{k}" for k in KINDS],
        f"sha2({text.format('base')}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
    )
