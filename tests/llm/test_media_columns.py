import hashlib
import struct
import zlib

import numpy as np
import pytest

from bitloom.llm import media_columns as m


def filtered(image, kind):
    """Plain writer of one filter kind, to test the reader."""
    out = []
    for y, row in enumerate(image.astype(int)):
        line = [kind]
        for x, v in enumerate(row):
            a = row[x - 1] if x else 0
            b = int(image[y - 1][x]) if y else 0
            c = int(image[y - 1][x - 1]) if x and y else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c][kind]
            line.append((v - guess) % 256)
        out.append(bytes(line))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return m.SIGNATURE + m._chunk(b"IHDR", head) + m._chunk(b"IDAT", zlib.compress(b"".join(out))) + m._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    image = np.random.default_rng(kind).integers(0, 256, (7, 64)).astype(np.uint8)
    assert (m.decode_png(filtered(image, kind)) == image).all()


@pytest.mark.parametrize("allowed", [(0, 1, 2), (0, 1, 2, 3, 4), (4,), (3, 4)])
def test_mixed_filters_are_undone(allowed, monkeypatch):
    monkeypatch.setattr(m, "SLOPE", 5)
    monkeypatch.setattr(m, "ROWS", 9)
    rng = np.random.default_rng(7)
    rows = np.cumsum(rng.integers(-9, 10, (60, 64)), axis=1) + np.cumsum(rng.integers(-90, 90, (60, 1)), axis=0)
    rows[10:20] = rng.integers(0, 5, (10, 64))
    payload = rows.astype(np.uint8).tobytes()
    data = m.encode_png(payload, allowed=allowed)
    assert m.decode_png(data).tobytes() == payload
    kinds = set(zlib.decompress(data[41 : data.index(b"IEND") - 8])[::65])
    assert kinds <= set(allowed) and len(kinds) > (len(allowed) > 1)


def test_texts_are_filtered_and_read_back():
    for text in (b"", b"a", b"some text of more than one row, " * 40, bytes(range(256)) * 9000):
        payload = m.padded(text)
        data = m.encode_png(payload)
        assert m.decode_png(data).tobytes() == payload


def test_damage_is_found():
    data = bytearray(m.encode_png(m.padded(b"some text" * 50)))
    data[60] ^= 1
    with pytest.raises(m.BadImage):
        m.decode_png(bytes(data))
    with pytest.raises(m.BadImage):
        m.decode_png(m.encode_png(m.padded(b"x"))[:-3])


def test_cosine_hash_is_the_transform_by_definition():
    image = np.random.default_rng(3).integers(0, 256, (32, 32)).astype(np.uint8)
    low = [sum(image[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    bits = "".join("1" if c > np.median(low[1:]) else "0" for c in low)
    assert m.cosine_hash(image) == f"{int(bits, 2):016x}"


def test_query(spark):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = m.op10_media_columns(spark, base).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        stored = m.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), m.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)))


def test_rows(spark):
    texts = [None, "", "a" * 64, "é" * 5000, "a" * 64]
    docs = spark.createDataFrame([(i if i < 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = m.features(m.media(docs)).collect()
    assert len(rows) == 5
    for r in rows:
        data = (texts[r.doc_id if r.doc_id is not None else 4] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    by = {r.doc_id: r for r in rows}
    assert by[None].media_sha256 == by[2].media_sha256 and by[None].feature == by[2].feature
    assert m.features(m.media(docs.limit(0))).count() == 0
