import numpy as np
import pytest

from bitloom.functions import codecs as c
from bitloom.operators import groups as g

EVERY = np.arange(65536).reshape(16, 4096)


def flat(groups, code=8, scale=0x3F80, bias=0):
    return g.Quantised(np.full(groups, scale), np.full(groups, bias), np.full((groups, 64), code))


def test_all_words_through_all_codecs():
    for k, words in enumerate(EVERY):
        side = g.quantise(words.reshape(-1, 64))
        assert (c.decode_page(c.encode_page(words, side, 3, k), side, 3, k) == words).all()
        assert (c.palette_decode(c.palette_encode(words)) == words).all()
        assert (c.fields_decode(c.fields_encode(words)) == words).all()
        guess = words[::-1].copy()
        assert (c.xor_decode(c.xor_encode(words, guess), guess) == words).all()


def test_three_modes_and_sizes():
    words = np.repeat([0x4100, 0x4110, 0x42C8], 64)
    blob = c.encode_page(words, flat(3), 0, 0)
    assert blob[c.PAGE.size] == 0x24
    assert (c.decode_page(blob, flat(3), 0, 0) == words).all()
    assert c.page_bytes(192, [2048, 1024]) == 436 and c.page_bytes(64, [0]) == 48 and c.page_bytes(64, [1024]) == 176
    with pytest.raises(c.CodecError):
        c.page_bytes(65, [0])


def test_palette_sizes():
    assert len(c.palette_encode(np.full(64, 0x3F80))) == 16 + 68 + 4
    mixed = np.arange(4096) * 17 % 65536
    assert len(c.palette_encode(mixed)) <= 16 + 8192 + 4


def test_random_pages():
    rng = np.random.default_rng(1)
    for n in (64, 128, 192, 4096):
        words = c._page_words(rng.integers(0x3C00, 0x4200, n)).astype(int)
        side = g.quantise(words.reshape(-1, 64))
        blob = c.encode_page(words, side, 1, 2)
        assert (c.decode_page(blob, side, 1, 2) == words).all()


def test_damage_is_refused():
    words = np.repeat([0x4100, 0x4110, 0x42C8], 64)
    blob = c.encode_page(words, flat(3), 5, 6)
    for bad in (blob[:-1], blob[:10], b"XXXX" + blob[4:], blob[:-1] + b"\1", blob[: c.PAGE.size] + b"\xff" + blob[c.PAGE.size + 1 :]):
        with pytest.raises(c.CodecError):
            c.decode_page(bad, flat(3), 5, 6)
    for tensor, page in ((4, 6), (5, 7)):
        with pytest.raises(c.CodecError):
            c.decode_page(blob, flat(3), tensor, page)
    with pytest.raises(c.CodecError):
        c.decode_page(blob, flat(2), 5, 6)
    with pytest.raises(c.CodecError):
        c.xor_decode(c.xor_encode(words, words ^ 0x100), np.zeros(192, int))
    with pytest.raises(c.CodecError):
        c.encode_page(np.zeros(65, int), flat(1), 0, 0)
    for enc, dec in ((c.palette_encode, c.palette_decode), (c.fields_encode, c.fields_decode)):
        with pytest.raises(c.CodecError):
            dec(enc(words)[:-5] + b"\0" * 4)


def test_container():
    pages = [c.encode_page(np.full(64, 0x4100), flat(1), 0, k) for k in range(2)]
    blob = c.pack_container({"b": 1, "a": "x"}, pages)
    manifest, back = c.unpack_container(blob)
    assert back == pages and manifest["page_offsets"] == [0, len(pages[0]), len(pages[0]) + len(pages[1])]
    for bad in (blob[:-1], b"X" + blob[1:], blob[:20] + b" " + blob[21:]):
        with pytest.raises(c.CodecError):
            c.unpack_container(bad)
    with pytest.raises(c.CodecError):
        c.pack_container({"page_offsets": []}, pages)
