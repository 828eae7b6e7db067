"""Secret scans that follow encodings: a worklist of layers, each rescanned, with spans mapped to the source text.

The text itself is the first layer. In every layer, runs of percent-encoding, of Unicode escapes and of base64 are
decoded; bytes that hold compressed streams, from base64, from escapes or from other streams, are inflated; base64 wrapped in lines is decoded joined, too. What comes out is a new layer unless the same
characters were seen before in this text (cycle detection), so the worklist reaches a fixpoint. Each character of a layer keeps
the source span that it came from: single characters through percent and Unicode decoding, groups of four digits through base64, the
whole run through compression.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.tables import columns, map_rows, table

# The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so shorter ones can be left out at once

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)")
#: Bytes written as escapes, one after the other.
BYTES, UNITS = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}"), re.compile(r"(?:\\u00[0-9A-Fa-f]{2}){8,}")
BASE64, PART = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
#: Base64 wrapped in lines, and its lines.
WRAPPED, LINE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}"), re.compile(r"[A-Za-z0-9+/_-]+=*")
#: Characters that each stand beside a null, as ASCII does in UTF-16 of either byte order.
WIDE = re.compile(r"(?<!\0)(?:[^\0]\0){4,}|(?<=\0)(?:[^\0]\0){3,}[^\0]")
#: A stream of more bytes is scanned in windows of so many that overlap by a quarter. It bounds memory against streams made to swell. The row says so in
#: n_unopened: what is encoded again in a run longer than the overlap is not decoded whole.
MAX_LAYER_BYTES = 64 << 20


@dataclass
class Layer:
    """Decoded text; starts and ends give the source span of each character (None: the source itself). If it comes from bytes that hold compressed streams, these, with the source span of each."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    data: bytes = b""
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base matches in one layer."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _characters(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Text of UTF-8 bytes, with a source span for each character, from those of the bytes; each byte that isn't UTF-8 is one U+FFFD."""
    try:
        text = data.decode()
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        codes = np.frombuffer(data.decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
        odd = (codes >= 0xD800) & (codes < 0xE000)
        size = np.where(odd, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        lead = np.cumsum(size) - size
        text = np.where(odd, 0xFFFD, codes).astype("<u4").tobytes().decode("utf-32-le")
    return text, start[lead], np.maximum.reduceat(end, lead) if len(lead) else end[:0]


class Zstandard:
    """A decompressor of one frame, with the interface of bz2's; input is fed in so small steps that output stays bounded."""

    def __init__(self):
        self.frame, self.data, self.unused_data = zstandard.ZstdDecompressor().decompressobj(), b"", b""

    eof = property(lambda self: self.frame.eof)
    needs_input = property(lambda self: not self.data)

    def decompress(self, data: bytes, _: int) -> bytes:
        data = self.data + data if self.data else data
        at, out = 0, b""
        while at < len(data) and not out and not self.eof:
            out, at = self.frame.decompress(data[at : at + 128]), at + 128
        if self.eof:
            self.data, self.unused_data = b"", self.frame.unused_data + data[at:]
        else:
            self.data = data[at:]
        return out


def _decompressor(data: bytes):
    """What opens the compressed stream that the bytes begin with; None if they begin with none."""
    if data[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return Zstandard()
    return None


#: How streams begin, but for zlib's, which is too short a sign within other bytes.
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
#: Bytes of output asked for at once.
STEP = 1 << 20


def _inflated(data: bytes) -> Iterator[bytes]:
    """The output of the compressed streams that the bytes begin with, one after the other, then what follows them. After what can be read of it, a cut
    stream raises EOFError, a broken one ValueError."""
    while opened := _decompressor(data):
        try:
            while not opened.eof:
                out = opened.decompress(data, STEP)
                data = getattr(opened, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not opened.eof and not data and getattr(opened, "needs_input", True):
                    raise EOFError
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError) as e:
            raise ValueError from e
        data = opened.unused_data.lstrip(b"\0")
    if data:
        yield b"\n" + data


@dataclass
class Streams:
    """Compressed streams of a layer: the spans of whole ones in it, and of cut ones with a mark; marks of all that the text has are in `unopened`."""

    unopened: set[tuple]
    whole: list[tuple[int, int]] = field(default_factory=list)
    cut: list[tuple[int, int, tuple]] = field(default_factory=list)
    #: where streams begin that were read already
    begun: set[int] = field(default_factory=set)

    def settle(self) -> None:
        """A cut one inside a whole one, as the first line of a wrapped one, doesn't count."""
        whole = sorted(self.whole)
        reach = [0, *accumulate((end for _, end in whole), max)]
        self.unopened |= {mark for start, end, mark in self.cut if reach[bisect_right(whole, (start, float("inf")))] < end}


def _spans(layer: Layer, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    if layer.starts is None:
        at = np.arange(start, end)
        return at, at + 1
    return layer.starts[start:end], layer.ends[start:end]


def _holding(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
    """The last fields of a layer of these bytes: none, unless they hold streams."""
    return (data, low, high) if _decompressor(data) or STREAM.search(data) else ()


def _opened_streams(data: bytes, low: np.ndarray, high: np.ndarray, unopened: set[tuple]) -> Iterator[Layer]:
    """What the compressed streams in some bytes hold, wherever they begin. All spans are those of the whole bytes from there on."""
    at = {m.start() for m in STREAM.finditer(data)} | ({0} if _decompressor(data) else set())
    done = 0
    for k in sorted(at):
        if k >= done:  # else inside of one that was read
            rest, own = data[k:], (int(low[k:].min()), int(high[k:].max()))
            whole = yield from _windows(rest, *own, unopened, (own[0], rest[:12]), weak=rest[:1] == b"x")
            done = len(data) if whole else k + 1


def _windows(data: bytes, low: int, high: int, unopened: set[tuple], mark: tuple, weak: bool) -> Iterator[Layer]:
    """Layers of what compressed streams hold, at most MAX_LAYER_BYTES each; returns whether they were whole."""

    def window(content: bytes) -> Layer:
        text = content.decode(errors="replace")
        spans = lambda n: (np.broadcast_to(np.int64(low), n), np.broadcast_to(np.int64(high), n))
        return Layer(text, *spans(len(text)), *_holding(content, *spans(len(content))))

    held, whole = bytearray(), True
    try:
        for piece in _inflated(data):
            held += piece
            while len(held) > MAX_LAYER_BYTES:
                unopened.add(mark)
                yield window(bytes(held[:MAX_LAYER_BYTES]))
                del held[: MAX_LAYER_BYTES - MAX_LAYER_BYTES // 4]
    except (EOFError, ValueError):
        whole = False
        if not weak:
            unopened.add(mark)
    if held:
        yield window(bytes(held))
    return whole


def _from_runs(layer: Layer, pattern: re.Pattern, digits: int, unopened: set[tuple]) -> Iterator[Layer]:
    """What streams hold that are written as runs of escaped bytes, each of so many characters, hexadecimal digits last."""
    starts, ends = None, None
    for m in pattern.finditer(layer.text):
        run = m.group()
        data = bytes.fromhex("".join(run[k + digits - 2 : k + digits] for k in range(0, len(run), digits)))
        if _decompressor(data) or STREAM.search(data):
            if starts is None:
                starts, ends = _spans(layer, 0, len(layer.text))
            yield from _opened_streams(data, starts[m.start() : m.end() : digits], ends[m.start() + digits - 1 : m.end() : digits], unopened)


def _from_percent(layer: Layer) -> Layer | None:
    """The whole layer with its runs of percent-encoding replaced: secrets may be encoded in part."""
    text, low, high, at = [], [], [], 0
    starts, ends = _spans(layer, 0, len(layer.text))
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m.group().replace("%", ""))
        made = _characters(data, starts[m.start() : m.end() : 3], ends[m.start() + 2 : m.end() : 3])
        text += [layer.text[at : m.start()], made[0]]
        low += [starts[at : m.start()], made[1]]
        high += [ends[at : m.start()], made[2]]
        at = m.end()
    if not text:
        return None
    text.append(layer.text[at:])
    return Layer("".join(text), np.concatenate([*low, starts[at:]]), np.concatenate([*high, ends[at:]]))


def _from_escapes(layer: Layer) -> Layer | None:
    """The whole layer with its escapes replaced: secrets may be escaped in part."""
    text, low, high, at = [], [], [], 0
    starts, ends = _spans(layer, 0, len(layer.text))
    for m in ESCAPE.finditer(layer.text):
        digits = m.group().strip("\\uUx{}&#;")
        code = int(digits, 10 if m.group().startswith("&#") and "x" not in m.group() else 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        text += [layer.text[at : m.start()], chr(code)]
        low += [starts[at : m.start()], starts[m.start() : m.start() + 1]]
        high += [ends[at : m.start()], ends[m.end() - 1 : m.end()]]
        at = m.end()
    if not text:
        return None
    text.append(layer.text[at:])
    return Layer("".join(text), np.concatenate([*low, starts[at:]]), np.concatenate([*high, ends[at:]]))


def _from_wide(layer: Layer) -> Layer | None:
    """The whole layer with its UTF-16 runs narrowed."""
    kept = np.ones(len(layer.text), bool)
    for m in WIDE.finditer(layer.text):
        kept[m.start() + 1 : m.end() : 2] = False
    if kept.all():
        return None
    starts, ends = _spans(layer, 0, len(layer.text))
    text = np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), "<u4")[kept].tobytes().decode("utf-32-le", "surrogatepass")
    return Layer(text, starts[kept], ends[kept])


def _from_base64(layer: Layer, m: re.Match, streams: Streams) -> Iterator[Layer]:
    """What a run decodes to, and, unless that's plain text or whole streams, what its parts between / - and _ decode to, as in paths and names."""
    plain = False
    for new in _decoded_base64(layer, [m.span()], streams):
        yield new
        plain = bool(new.data) or "\ufffd" not in new.text and sum(c.isprintable() or c in "\t\n\r" for c in new.text) >= 0.95 * len(new.text)
    if plain or streams.whole and streams.whole[-1] == m.span():
        return
    for p in PART.finditer(m.group()):
        if p.end() - p.start() < m.end() - m.start():
            yield from _decoded_base64(layer, [(p.start() + m.start(), p.end() + m.start())], streams, True)


def _from_wrapped(layer: Layer, m: re.Match, streams: Streams) -> Iterator[Layer]:
    """What the joined lines decode to: all, and those of one length with and without the line before and the line after, which may be other text."""
    lines = [p.span() for p in LINE.finditer(layer.text, *m.span())]
    size = [b - a for a, b in lines]
    ranges, first = {(0, len(lines))}, 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or size[k] != size[first]:
            ranges |= {(i, j) for i in (max(0, first - 1), first) for j in (k, min(k + 1, len(lines)))}
            first = k
    for i in sorted({i for i, _ in ranges}):
        runs = [lines[i:j] for j in sorted(j for k, j in ranges if k == i) if j - i > 1 and sum(size[i:j]) >= 16]
        if runs and _decompressor(_bytes(layer, runs[0])):  # the fewest lines that have the stream's end, else all
            if _ends(_bytes(layer, lines[i : i + 1])):
                continue
            runs = [next((r for r in runs if _ends(_bytes(layer, r))), runs[-1])]
        for r in runs:
            yield from _decoded_base64(layer, r, streams)


def _bytes(layer: Layer, runs: list[tuple[int, int]]) -> bytes:
    """What the runs of digits stand for together."""
    digits = "".join(layer.text[a:b] for a, b in runs).rstrip("=").replace("-", "+").replace("_", "/")
    digits = digits[: len(digits) - (len(digits) % 4 == 1)]
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4))
    except (binascii.Error, ValueError):
        return b""


def _ends(data: bytes) -> bool:
    """Whether compressed streams are whole."""
    try:
        for _ in _inflated(data):
            pass
    except (EOFError, ValueError):
        return False
    return True


def _decoded_base64(layer: Layer, runs: list[tuple[int, int]], streams: Streams, part: bool = False) -> Iterator[Layer]:
    """What the runs of digits decode to together, inflated if it is compressed; as it is, too, if that fails."""
    data = _bytes(layer, runs)
    if not data:
        return
    starts, ends = (np.concatenate(x) for x in zip(*(_spans(layer, a, b) for a, b in runs), strict=True))
    if _decompressor(data):
        start, end, mark = runs[0][0], runs[-1][1], (int(starts.min()), data[:12])
        if start in streams.begun:
            return
        streams.begun.add(start)
        marks: set[tuple] = set()
        whole = yield from _windows(data, int(starts.min()), int(ends.max()), marks, mark, weak=False)
        if whole:
            streams.whole.append((start, end))
            streams.unopened |= marks
            return
        # two bytes are a weak sign of zlib: other data may have them
        if data[0] != 0x78 or not part and _begins(data):
            streams.cut.append((start, end, mark))
    group = np.arange(len(data)) // 3 * 4
    low, high = starts[group], ends[np.minimum(group + 3, len(starts) - 1)]
    yield Layer(*_characters(data, low, high), *(_holding(data, low, high) if STREAM.search(data, 1) else ()))


def _begins(data: bytes) -> bool:
    """Whether anything can be read of a stream that isn't whole, or nothing speaks against one that is cut."""
    try:
        for _ in _inflated(data):
            return True
    except EOFError:
        return True
    except ValueError:
        return False
    return False


def _decoded(layer: Layer, unopened: set[tuple]) -> Iterator[Layer | None]:
    """The layers made from a layer."""
    streams = Streams(unopened)
    if layer.data:
        yield from _opened_streams(layer.data, layer.low, layer.high, unopened)
    if "%" in layer.text:
        yield _from_percent(layer)
        yield from _from_runs(layer, PERCENT, 3, unopened)
    if "\\" in layer.text or "&#" in layer.text:
        yield _from_escapes(layer)
        yield from _from_runs(layer, BYTES, 4, unopened)
        yield from _from_runs(layer, UNITS, 6, unopened)
    if "\0" in layer.text:
        yield _from_wide(layer)
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            yield from _from_wrapped(layer, m, streams)
    for m in BASE64.finditer(layer.text):
        yield from _from_base64(layer, m, streams)
    streams.settle()


def layers(text: str) -> Iterator[Layer | None]:
    """All layers, the text first; None for each compressed stream that isn't opened whole. Layers are made as they are asked for, so few are held at once."""
    seen = {hashlib.sha256(text.encode(errors="surrogatepass")).digest()}
    unopened: set[tuple] = set()
    root = Layer(text, None, None)
    yield root
    todo = [_decoded(root, unopened)]
    while todo:
        new = next(todo[-1], todo)
        if new is todo:
            todo.pop()
        elif new is not None:
            digest = hashlib.sha256(new.text.encode(errors="surrogatepass") + bytes(new.starts[:1].astype(np.int64)) + bytes(new.ends[-1:].astype(np.int64))).digest()
            if digest not in seen:
                seen.add(digest)
                yield new
                todo.append(_decoded(new, unopened))
    for _ in unopened:
        yield None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans of the text; all spans, decoded ones included, without repeats; compressed streams not opened whole. Spans are (start, rank of kind, end), sorted."""
    base, every, unopened = [], set(), 0
    for depth, layer in enumerate(layers(text)):
        if layer is None:
            unopened += 1
            continue
        here = base_spans(layer.text)
        if not depth:
            base = sorted(here)
        for start, kind, end in here:
            low, high = layer.source(start, end)
            every.add((low, kind, high))
    return base, sorted(every), unopened


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and all spans as arrays of (kind, start, end), n_unopened.

    A null text counts as empty and has no spans; repeated rows give repeated rows; other columns are left out.
    """

    def make():
        def each(key: int | None, text: str | None) -> Iterator[tuple]:
            base, every, unopened = scan(text or "")
            yield key, *([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in (base, every)), unopened

        return each

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_rows(columns(docs, key=f"{id_col}:long", text=text_col), make, f"doc_id long, base {span}, spans {span}, n_unopened int")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(base, x -> x.kind = '{k}')) as long) AS n_{k}" for k in KINDS],
        f"sha2({text.format('base')}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
        "n_unopened",
    )
