import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import words as w
from bitloom.operators import groups as g

EVERY = np.arange(65536)


def test_order_is_a_permutation_that_sorts_numbers():
    keys = w.keys_of_words(EVERY)
    assert sorted(keys) == EVERY.tolist() and (w.words_of_keys(keys) == EVERY).all()
    values = w.floats_of_words(EVERY)
    fine = np.isfinite(values)
    assert (np.diff(values[fine][np.argsort(keys[fine])]) >= 0).all()


def test_rounding_is_half_to_even():
    x = np.array([0.0, -0.0, 1.00390625, 1.01171875, -1.00390625], np.float32)
    assert w.words_of_floats(x).tolist() == [0x0000, 0x8000, 0x3F80, 0x3F82, 0xBF80]
    fine = np.isfinite(w.floats_of_words(EVERY))
    assert (w.words_of_floats(w.floats_of_words(EVERY[fine])) == EVERY[fine]).all()


def test_columns_equal_kernels(spark):
    c = F.col("w")
    df = spark.range(65536).select(F.col("id").cast("int").alias("w"))
    rows = df.select("w", w.order_key(c), w.from_order_key(w.order_key(c)), w.is_supported(c), w.rejoined(w.sign_fraction(c), w.exponent(c)), w.bit_length(c)).collect()
    for r in rows:
        assert r[2] == r[0] == r[4] and r[5] == r[0].bit_length()
    assert [r[1] for r in sorted(rows)] == w.keys_of_words(EVERY).tolist()
    assert [r[3] for r in sorted(rows)] == w.supported(EVERY).tolist()


def test_quantiser_fixture():
    up = w.words_of_floats(np.tile(np.arange(16, dtype=np.float32), 4)).reshape(1, 64)
    down = w.words_of_floats(np.tile(np.arange(15, -1, -1, dtype=np.float32), 4)).reshape(1, 64)
    found = g.quantise(up)
    assert (found.scale[0], found.bias[0]) == (0xBF80, 0x4170)
    assert int(g.pack_codes(found.q)[0, 0]) == 0x89ABCDEF and int(g.pack_codes(g.quantise(down).q)[0, 0]) == 0x76543210
    assert (g.unpack_codes(g.pack_codes(found.q)) == found.q).all()


def one(q, scale, bias, mode):
    """The interval of one value by single steps in numpy scalars."""
    f = lambda x: w.floats_of_words(np.array([x]))[0]
    fine = lambda x: bool(w.supported(np.array([x]))[0])
    if not (fine(scale) and fine(bias)) or f(scale) == 0:
        return None
    with np.errstate(all="ignore"):
        product = np.float32(np.float32(q) * f(scale))
        centre = np.float32(product + f(bias))
        radius = np.float32(np.float32(1 - mode * -1 if mode else 0.5) * abs(f(scale))) if mode == 0 else np.float32(abs(f(scale)))
        ends = np.float32(centre - radius), np.float32(centre + radius)
    if not all(np.isfinite(x) and (x == 0 or abs(x) >= w.TINY) for x in (product, centre, radius, *ends)) or ends[0] > ends[1]:
        return None
    low, high = (int(w.words_of_floats(np.array([x]))[0]) for x in ends)
    lower, upper = max(0, int(w.keys_of_words(low)) - 1), min(65535, int(w.keys_of_words(high)) + 1)
    if lower > upper or not all(fine(x) for x in (low, high, int(w.words_of_keys(lower)), int(w.words_of_keys(upper)))):
        return None
    return lower, upper, (upper - lower).bit_length()


def test_intervals_by_single_steps():
    for scale in (0, 0x0001, 0x0080, 0x3C00, 0x3F80, 0x7F7F, 0x7F80, 0x8000, 0xBF80, 0xFF80, 0x7FC0):
        for bias in (0, 0x3F80, 0xBF80, 0x7F7F):
            for mode in (0, 1):
                lower, upper, width, safe = g.intervals(np.arange(16), np.array(scale), np.array(bias), mode)
                for q in range(16):
                    want = one(q, scale, bias, mode)
                    assert bool(safe[q]) == (want is not None)
                    if want:
                        assert (lower[q], upper[q], width[q]) == want


def test_modes():
    words = np.array([[0x4100] * 64, [0x4110] * 64, [0x42C8] * 64])
    side = g.Quantised(np.full(3, 0x3F80), np.zeros(3, int), np.full((3, 64), 8))
    assert g.encode(words, side).mode.tolist() == [g.TIGHT, g.WIDE, g.LITERAL]


def test_groups_must_be_whole(spark):
    with pytest.raises(Exception, match="must hold 64"):
        g.encoded_groups(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")).collect()
    assert g.encoded_groups(spark.createDataFrame([], "id long, embedding array<float>")).count() == 0
