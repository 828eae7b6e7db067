"""16-bit floating-point words: column expressions, and the same as numpy kernels on bit patterns.

A word is the upper half of a 32-bit float, held as an INT from 0 to 65535. Nothing here rounds in between: conversion is exact
upwards and half-to-even downwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a word.
SIGN, EXPONENT, FRACTION = 0x8000, 0x7F80, 0x007F
TINY = float(np.finfo(np.float32).tiny)


# Column expressions.


def order_key(w: Column) -> Column:
    """A key that sorts words as numbers do, with -0 just under +0."""
    return F.when(w.bitwiseAND(SIGN) != 0, F.lit(0xFFFF) - w).otherwise(w.bitwiseXOR(SIGN))


def from_order_key(k: Column) -> Column:
    return F.when(k.bitwiseAND(SIGN) != 0, k.bitwiseXOR(SIGN)).otherwise(F.lit(0xFFFF) - k)


def is_finite(w: Column) -> Column:
    return w.bitwiseAND(EXPONENT) != EXPONENT


def is_subnormal(w: Column) -> Column:
    return (w.bitwiseAND(EXPONENT) == 0) & (w.bitwiseAND(FRACTION) != 0)


def is_supported(w: Column) -> Column:
    return is_finite(w) & ~is_subnormal(w)


def is_supported_float(x: Column) -> Column:
    """Neither NaN nor infinite nor below the normal range, zero apart."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float")) & ((x == 0) | (F.abs(x) >= F.lit(TINY).cast("float")))


def sign_fraction(w: Column) -> Column:
    return F.shiftright(w.bitwiseAND(SIGN), 8).bitwiseOR(w.bitwiseAND(FRACTION))


def exponent(w: Column) -> Column:
    return F.shiftright(w, 7).bitwiseAND(0xFF)


def rejoined(sf: Column, e: Column) -> Column:
    return F.shiftleft(sf.bitwiseAND(0x80), 8).bitwiseOR(F.shiftleft(e, 7)).bitwiseOR(sf.bitwiseAND(FRACTION))


def bit_length(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def round_up(n: Column, unit: int) -> Column:
    return F.ceil(n / unit).cast("long") * unit


def word_array(values: Column) -> Column:
    """Words of an array of floats."""
    return F.arrow_udf(lambda x: _each(x, lambda v: words_of_floats(v.astype(np.float32)).astype(np.int32)), "array<int>")(values)


def float_array(words: Column) -> Column:
    """Floats of an array of words."""
    return F.arrow_udf(lambda x: _each(x, lambda v: floats_of_words(v).astype(np.float32)), "array<float>")(words)


def _each(rows: pa.ListArray, change: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """The kernel over the members of all rows at once; null rows stay null."""
    members = pa.array(change(rows.flatten().to_numpy(zero_copy_only=False)))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), members, mask=rows.is_null() if rows.null_count else None)


# Numpy kernels.


def words_of_floats(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    return ((bits + 0x7FFF + ((bits >> np.uint64(16)) & np.uint64(1))) >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)


def floats_of_words(w: np.ndarray) -> np.ndarray:
    return (np.asarray(w).astype(np.uint32) << np.uint32(16)).view(np.float32)


def keys_of_words(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w).astype(np.int32)
    return np.where(w & SIGN, 0xFFFF - w, w + SIGN)


def words_of_keys(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k).astype(np.int32)
    return np.where(k & SIGN, k - SIGN, 0xFFFF - k)


def supported(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w).astype(np.int32)
    return ((w & EXPONENT) != EXPONENT) & (((w & EXPONENT) != 0) | ((w & FRACTION) == 0))


def supported_float(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x) & ((x == 0) | (np.abs(x) >= np.float32(TINY)))


def bit_lengths(n: np.ndarray) -> np.ndarray:
    """Of integers under 2^53."""
    return np.frexp(np.asarray(n, np.float64))[1]
