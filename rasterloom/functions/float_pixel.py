"""Floats as integers with a chosen exponent bias and mantissa length, over whole arrays."""

from __future__ import annotations

import numpy as np


def to_integers(values: np.ndarray, bias: int, bits: int) -> np.ndarray:
    """Sign-magnitude integers of single-precision floats: exponent above ``bits`` of mantissa, rounded."""
    raw = np.asarray(values, dtype=np.float32).view(np.int32).astype(np.int64)
    exponent, mantissa = (raw >> 23) & 0xFF, raw & 0x7FFFFF
    mantissa = np.where(exponent == 0, mantissa, mantissa | 0x800000)
    moved = np.where(exponent == 0, 1, exponent) - 127 + bias
    mantissa = np.where(moved < 1, mantissa >> np.minimum(np.maximum(1 - moved, 0), 31), mantissa)
    moved = np.where(moved <= 1, np.where(mantissa & 0x800000, 1, 0), moved)
    half = 1 << (22 - bits) if bits < 23 else 0
    out = (moved << bits) + (((mantissa & 0x7FFFFF) + half) >> (23 - bits))
    return np.where(np.asarray(values) == 0, 0, np.where(raw < 0, -out, out))


def to_floats(integers: np.ndarray, bias: int, bits: int) -> np.ndarray:
    v = np.asarray(integers, dtype=np.int64)
    one = 1 << bits
    magnitude = np.abs(v)
    exponent, mantissa = magnitude >> bits, magnitude & (one - 1)
    scale = np.where(exponent == 0, 1, exponent) - bias
    whole = np.where(exponent == 0, mantissa, mantissa + one).astype(np.float64)
    return (np.where(v < 0, -1.0, 1.0) * whole * 2.0 ** (scale - bits)).astype(np.float32)
