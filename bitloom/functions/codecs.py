"""Exact byte codecs of pages of words, and the container that holds them. All layouts are this library's own, little-endian.

A page is a run of 64 to 4096 words, a multiple of 64. Decoding checks all that it reads and raises CodecError.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import zstandard

from bitloom.operators.groups import GROUP, LITERAL, RESTART_GROUPS, Quantised, encode, intervals
from bitloom.functions.words import keys_of_words, words_of_keys

VERSION = 1
PAGE = struct.Struct("<4sHHIIIHHIHH")  # magic, version, header bytes, tensor, page, values, groups, restarts, total bytes, payload words, none
PAGE_MAGIC, BOX_MAGIC = b"BLwp", b"BLbx"
SIDE = struct.Struct("<4sBBHIHBB")  # magic, version, kind, values, payload bytes, a, b, none
PALETTE_MAGIC, FIELD_MAGIC, XOR_MAGIC = b"BLpl", b"BLfz", b"BLxz"
LEVEL = 3


class CodecError(ValueError):
    """Bytes that are no page or container of the kind read."""


def _need(fine: bool, why: str) -> None:
    if not fine:
        raise CodecError(why)


def _page_words(words: np.ndarray) -> np.ndarray:
    words = np.asarray(words)
    _need(words.ndim == 1 and GROUP <= len(words) <= 4096 and len(words) % GROUP == 0 and (words >= 0).all() and (words <= 0xFFFF).all(), "a page has 64 to 4096 words, a multiple of 64")
    return words.astype("<u2")


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values in so many bits each, the first in the lowest bits, padded to whole 32-bit words."""
    total = int(widths.sum())
    at = np.repeat(np.cumsum(widths) - widths, widths)
    place = np.arange(total) - at
    bits = (np.repeat(values.astype(np.uint64), widths) >> place.astype(np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([bits, np.zeros(-total % 32, np.uint64)]).astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, widths: np.ndarray) -> np.ndarray:
    """The values again; CodecError if padding bits are set."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(np.uint64)
    total = int(widths.sum())
    _need(len(bits) >= total and not bits[total:].any(), "wrong payload padding")
    ends = np.cumsum(widths)
    place = np.arange(total) - np.repeat(ends - widths, widths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bits[:total] << place.astype(np.uint64))])
    return (sums[ends] - sums[ends - widths]).astype(np.int64)


def page_bytes(values: int, restart_bits: list[int]) -> int:
    """The size of a refinement page."""
    groups = values // GROUP
    _need(values % GROUP == 0 and GROUP <= values <= 4096 and len(restart_bits) == -(-groups // RESTART_GROUPS), "restarts and values disagree")
    return PAGE.size + -(-(-(-groups // 4)) // 4) * 4 + 4 * (len(restart_bits) + 1) + sum(-(-b // 32) * 4 for b in restart_bits) + 4


def _widths(side: Quantised, mode: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower key, width and safety of each value under its group's mode; 0, 16 and safe for literal ones."""
    both = [intervals(side.q, side.scale[:, None], side.bias[:, None], m) for m in (0, 1)]
    pick = lambda k, literal: np.where(mode[:, None] == LITERAL, literal, np.where(mode[:, None] == 0, both[0][k], both[1][k]))
    return pick(0, 0), pick(2, 16), pick(3, True).astype(bool)


def encode_page(words: np.ndarray, side: Quantised, tensor: int, page: int) -> bytes:
    """What the quantised form leaves open, so that words are exact: per group the cheapest of two intervals and the plain words."""
    words = _page_words(words).astype(np.int32)
    rows = words.reshape(-1, GROUP)
    found = encode(rows, side)
    lower, width, _ = _widths(side, found.mode)
    rank = np.where(found.mode[:, None] == LITERAL, rows, keys_of_words(rows) - lower)
    parts = [pack_bits(rank[k : k + RESTART_GROUPS].ravel(), width[k : k + RESTART_GROUPS].ravel()) for k in range(0, len(rows), RESTART_GROUPS)]
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<u4")
    modes = np.concatenate([found.mode, np.zeros(-len(rows) % 16, np.int64)]).reshape(-1, 4)
    mode_map = (modes << (2 * np.arange(4))).sum(1).astype(np.uint8).tobytes()
    body = mode_map + offsets.tobytes() + b"".join(parts)
    total = PAGE.size + len(body) + 4
    head = PAGE.pack(PAGE_MAGIC, VERSION, PAGE.size, tensor, page, len(words), len(rows), len(parts), total, int(offsets[-1]), 0)
    return head + body + b"\0" * 4


def decode_page(blob: bytes, side: Quantised, tensor: int, page: int) -> np.ndarray:
    """The words again, with every field checked against the others and against the quantised form."""
    _need(len(blob) >= PAGE.size, "truncated header")
    magic, version, head, own_tensor, own_page, values, groups, restarts, total, payload, none = PAGE.unpack_from(blob)
    _need((magic, version, head, none) == (PAGE_MAGIC, VERSION, PAGE.size, 0), "no page of this version")
    _need((own_tensor, own_page) == (tensor, page), "another tensor's or page's bytes")
    _need(values == groups * GROUP and groups == len(side.q) and restarts == -(-groups // RESTART_GROUPS) and groups > 0, "counts disagree")
    at = PAGE.size
    map_bytes = -(-(-(-groups // 4)) // 4) * 4
    _need(total == len(blob) == at + map_bytes + 4 * (restarts + 1) + 4 * payload + 4, "wrong extent")
    _need(blob[-4:] == b"\0" * 4, "guard is not zero")
    pairs = (np.frombuffer(blob, np.uint8, map_bytes, at)[:, None] >> (2 * np.arange(4))) & 3
    mode = pairs.ravel()[:groups].astype(np.int64)
    _need(not pairs.ravel()[groups:].any() and (mode <= LITERAL).all(), "wrong mode map")
    offsets = np.frombuffer(blob, "<u4", restarts + 1, at + map_bytes).astype(np.int64)
    _need(offsets[0] == 0 and offsets[-1] == payload and (np.diff(offsets) >= 0).all(), "wrong offsets")
    lower, width, safe = _widths(side, mode)
    _need(bool(safe.all()), "unsafe side information")
    start, out = at + map_bytes + 4 * (restarts + 1), []
    for k in range(restarts):
        rows = slice(k * RESTART_GROUPS, (k + 1) * RESTART_GROUPS)
        own = width[rows].ravel()
        _need(offsets[k + 1] - offsets[k] == -(-int(own.sum()) // 32), "offsets and widths disagree")
        out.append(unpack_bits(blob[start + 4 * offsets[k] : start + 4 * offsets[k + 1]], own))
    rank = np.concatenate(out).reshape(-1, GROUP)
    both = [intervals(side.q, side.scale[:, None], side.bias[:, None], m) for m in (0, 1)]
    upper = np.where(mode[:, None] == 0, both[0][1], both[1][1])
    literal = mode[:, None] == LITERAL
    _need(bool((literal | (rank + lower <= upper)).all()), "rank out of range")
    return np.where(literal, rank, words_of_keys(np.where(literal, 0, rank + lower))).ravel().astype(np.int32)


def _side_pack(magic: bytes, kind: int, values: int, payload: bytes, a: int = 0, b: int = 0) -> bytes:
    return SIDE.pack(magic, VERSION, kind, values, len(payload), a, b, 0) + payload + b"\0" * 4


def _side_open(blob: bytes, wanted: bytes) -> tuple[int, int, bytes, int, int]:
    _need(len(blob) >= SIDE.size + 4, "truncated")
    magic, version, kind, values, size, a, b, none = SIDE.unpack_from(blob)
    _need((magic, version, none) == (wanted, VERSION, 0), "no page of this version")
    _need(len(blob) == SIDE.size + size + 4 and blob[-4:] == b"\0" * 4, "wrong extent")
    _need(GROUP <= values <= 4096 and values % GROUP == 0, "wrong number of values")
    return kind, values, blob[SIDE.size : -4], a, b


def palette_encode(words: np.ndarray) -> bytes:
    """Sorted exponents, the sign and fraction byte of each value, and indices of fixed width; plain words where that is no smaller."""
    words = _page_words(words).astype(np.int32)
    exponents = (words >> 7) & 0xFF
    palette, index = np.unique(exponents, return_inverse=True)
    width = int(len(palette) - 1).bit_length()
    indices = pack_bits(index, np.full(len(words), width))[: -(-len(words) * width // 8)]
    body = palette.astype(np.uint8).tobytes() + (((words >> 8) & 0x80) | (words & 0x7F)).astype(np.uint8).tobytes() + indices
    body += bytes(-len(body) % 4)
    if len(body) >= 2 * len(words):
        return _side_pack(PALETTE_MAGIC, 1, len(words), words.astype("<u2").tobytes())
    return _side_pack(PALETTE_MAGIC, 0, len(words), body, len(palette), width)


def palette_decode(blob: bytes) -> np.ndarray:
    kind, values, body, n, width = _side_open(blob, PALETTE_MAGIC)
    if kind == 1:
        _need(len(body) == 2 * values and n == width == 0, "wrong plain page")
        return np.frombuffer(body, "<u2").astype(np.int32)
    _need(kind == 0 and 1 <= n <= 256 and width == (n - 1).bit_length(), "wrong palette")
    used = n + values + -(-values * width // 8)
    _need(len(body) == -(-used // 4) * 4 and not any(body[used:]), "wrong extent")
    palette = np.frombuffer(body, np.uint8, n).astype(np.int32)
    _need(bool((np.diff(palette) > 0).all()), "palette is not sorted")
    packed = body[n + values : used]
    index = unpack_bits(packed + bytes(-len(packed) % 4), np.full(values, width)) if width else np.zeros(values, np.int64)
    _need(bool((index < n).all()), "index out of range")
    rest = np.frombuffer(body, np.uint8, values, n).astype(np.int32)
    return ((rest & 0x80) << 8) | (palette[index] << 7) | (rest & 0x7F)


def _inflated(data: bytes, size: int) -> bytes:
    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    except zstandard.ZstdError as error:
        raise CodecError(str(error)) from error
    _need(len(out) == size, "wrong inflated size")
    return out


def fields_encode(words: np.ndarray, level: int = LEVEL) -> bytes:
    """Two compressed frames: exponents, and signs with fractions."""
    words = _page_words(words).astype(np.int32)
    pack = zstandard.ZstdCompressor(level=level)
    first = pack.compress(((words >> 7) & 0xFF).astype(np.uint8).tobytes())
    return _side_pack(FIELD_MAGIC, 0, len(words), first + pack.compress((((words >> 8) & 0x80) | (words & 0x7F)).astype(np.uint8).tobytes()), len(first))


def fields_decode(blob: bytes) -> np.ndarray:
    kind, values, body, first, b = _side_open(blob, FIELD_MAGIC)
    _need(kind == 0 and b == 0 and first <= len(body), "wrong frames")
    e, sf = (np.frombuffer(_inflated(x, values), np.uint8).astype(np.int32) for x in (body[:first], body[first:]))
    return ((sf & 0x80) << 8) | (e << 7) | (sf & 0x7F)


def xor_encode(words: np.ndarray, predictor: np.ndarray, level: int = LEVEL) -> bytes:
    """The compressed difference to a prediction, bound to it by digest."""
    words, predictor = _page_words(words), _page_words(predictor)
    _need(len(words) == len(predictor), "prediction of another length")
    return _side_pack(XOR_MAGIC, 0, len(words), hashlib.sha256(predictor.tobytes()).digest() + zstandard.ZstdCompressor(level=level).compress((words ^ predictor).tobytes()))


def xor_decode(blob: bytes, predictor: np.ndarray) -> np.ndarray:
    kind, values, body, a, b = _side_open(blob, XOR_MAGIC)
    predictor = _page_words(predictor)
    _need((kind, a, b) == (0, 0, 0) and values == len(predictor) and body[:32] == hashlib.sha256(predictor.tobytes()).digest(), "another prediction")
    return (np.frombuffer(_inflated(body[32:], 2 * values), "<u2") ^ predictor).astype(np.int32)


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


BOX = struct.Struct("<4sHHII")  # magic, version, none, manifest bytes, checksum of the manifest


def pack_container(manifest: dict, pages: list[bytes]) -> bytes:
    """Pages behind a canonical manifest, to which the ends of pages are added under page_offsets."""
    _need(not {"page_offsets"} & manifest.keys(), "page_offsets is reserved")
    _need(all(len(p) >= PAGE.size and len(p) % 4 == 0 for p in pages), "no page's length")
    offsets = [0]
    for p in pages:
        offsets.append(offsets[-1] + len(p))
    text = canonical(manifest | {"page_offsets": offsets})
    return BOX.pack(BOX_MAGIC, VERSION, 0, len(text), zlib.crc32(text)) + text + bytes(-(BOX.size + len(text)) % 8) + b"".join(pages)


def unpack_container(blob: bytes) -> tuple[dict, list[bytes]]:
    _need(len(blob) >= BOX.size, "truncated")
    magic, version, none, size, crc = BOX.unpack_from(blob)
    _need((magic, version, none) == (BOX_MAGIC, VERSION, 0) and len(blob) >= BOX.size + size, "no container of this version")
    text = blob[BOX.size : BOX.size + size]
    _need(zlib.crc32(text) == crc, "damaged manifest")
    start = -(-(BOX.size + size) // 8) * 8
    _need(not any(blob[BOX.size + size : start]), "wrong padding")
    try:
        manifest = json.loads(text)
    except ValueError as error:
        raise CodecError("manifest is no JSON") from error
    _need(canonical(manifest) == text, "manifest is not canonical")
    offsets = manifest.get("page_offsets")
    _need(isinstance(offsets, list) and offsets[:1] == [0] and start + offsets[-1] == len(blob) and all(a < b and b % 4 == 0 for a, b in zip(offsets, offsets[1:])), "wrong offsets")
    pages = [blob[start + a : start + b] for a, b in zip(offsets, offsets[1:])]
    _need(all(p[:4] == PAGE_MAGIC and PAGE.unpack_from(p)[8] == len(p) for p in pages if len(p) >= PAGE.size) and all(len(p) >= PAGE.size for p in pages), "wrong page")
    return manifest, pages
