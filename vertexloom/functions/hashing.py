"""A 32-bit mixer and HyperLogLog registers, as Spark expressions and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the mixer's multipliers, the estimator's constants for 16, 32 and 64 registers
MULTIPLIERS = (0x7FEB352D, 0x846CA68B)
ALPHAS = {16: 0.673, 32: 0.697, 64: 0.709}
MASK = 0xFFFFFFFF


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, for x below 2**32: the factor goes in halves, so that no product leaves 64 bits."""
    high, low = factor >> 16, factor & 0xFFFF
    return (F.shiftleft((x * high).bitwiseAND(0xFFFF), 16) + x * low).bitwiseAND(MASK)


def _folded(x: Column, shift: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, shift))


def mix32(x: Column) -> Column:
    """The mixer: folds by 16, 15 and 16 bits around the two multiplications. x: a long from 0 to 2**32 - 1."""
    x = _times(_folded(x.cast("long"), 16), MULTIPLIERS[0])
    return _folded(_times(_folded(x, 15), MULTIPLIERS[1]), 16)


def mix32_array(x: np.ndarray) -> np.ndarray:
    """The same over an array of unsigned 32-bit integers."""
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MULTIPLIERS[1])
    return x ^ (x >> np.uint32(16))


def register_of(h: Column, p: int) -> Column:
    """The register of a hash: its low p bits."""
    return h.bitwiseAND((1 << p) - 1)


def rank_of(h: Column, p: int) -> Column:
    """The rank of a hash: leading zeros of the other 32 - p bits, plus one; 33 - p if they are all zero."""
    w = F.shiftright(h, p)
    return F.when(w == 0, 33 - p).otherwise(33 - p - F.length(F.bin(w))).cast("int")


def rank_array(h: np.ndarray, p: int) -> np.ndarray:
    w = (h >> np.uint32(p)).astype(np.int64)
    length = np.zeros(len(w), np.int64)
    positive = w > 0
    length[positive] = np.floor(np.log2(w[positive])).astype(np.int64) + 1
    return np.where(positive, 33 - p - length, 33 - p).astype(np.uint8)


def registers(values: np.ndarray, p: int) -> np.ndarray:
    """HyperLogLog registers over whole numbers."""
    h = mix32_array(values)
    out = np.zeros(1 << p, np.uint8)
    np.maximum.at(out, (h & np.uint32((1 << p) - 1)).astype(np.int64), rank_array(h, p))
    return out


def estimate(found: np.ndarray) -> np.ndarray:
    """Distinct values from registers (last axis): the raw estimate, or linear counting while it is small."""
    m = found.shape[-1]
    alpha = ALPHAS.get(m, 0.7213 / (1 + 1.079 / m))
    raw = alpha * m * m / np.exp2(-found.astype(np.float64)).sum(-1)
    zeros = (found == 0).sum(-1)
    linear = m * np.log(m / np.maximum(zeros, 1))
    return np.where((raw <= 2.5 * m) & (zeros > 0), linear, raw)
