"""Quantisers as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The luminance and chrominance steps at quality 50, and the zigzag place of each coefficient.
LUMA_STEPS = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_STEPS = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
# Dead-zone factors of the three channels and the numerator for larger quanta.
DEAD_ZONE = [1.0 - 0.05465007330715401, 1.0 - 0.07005449891748593, 1.0 - 0.049935103337343655]
DEAD_ZONE_NUMERATOR = 0.145
# Distance and global scale points of the lossy encoder.
DISTANCE_POINTS = [(0.3, 9080), (0.5, 5743), (0.75, 2925), (1.0, 2025), (1.5, 1371), (2.0, 1019), (3.0, 797), (4.0, 649), (6.0, 535)]
SCALE_RANGE = (256, 73728)


def quality_scale(quality: Column) -> Column:
    """Percentage by which the steps of quality 50 are scaled."""
    return F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)


def scaled_step(step: Column, quality: Column) -> Column:
    return F.least(F.greatest(F.floor((step * quality_scale(quality) + 50) / 100), F.lit(1)), F.lit(255))


def qp_step(index: Column, scaled: bool, shift: int = 1) -> dict[str, Column]:
    """Step, mantissa and rounding offset of a quantisation index; 0 is lossless."""
    low = index % 16
    octave = F.floor(index / 16) - 1
    if scaled:
        mantissa = F.when(index < 16, index).otherwise(16 + low)
        exponent = F.when(index < 16, F.lit(shift)).otherwise(octave + shift)
    else:
        mantissa = F.when(index < 32, F.floor((index + 3) / 4)).when(index < 48, F.floor((17 + low) / 2)).otherwise(16 + low)
        exponent = F.when(index < 32, F.lit(0)).when(index < 48, octave - 1).otherwise(octave - 2)
    step = (mantissa * F.pow(F.lit(2.0), exponent)).cast("long")
    lossless = index == 0
    return {
        "step": F.when(lossless, F.lit(1)).otherwise(step),
        "mantissa": F.when(lossless, F.lit(0)).otherwise(mantissa),
        "offset": F.when(lossless, F.lit(0)).otherwise(F.floor((step * 3 + 1) / 8)),
    }


def shift_quantize(v: Column, offset: Column, bits: int) -> Column:
    """Sign-magnitude quantiser by a power of two."""
    q = F.shiftright(F.abs(v) + offset, bits)
    return F.when(v < 0, -q).otherwise(q)


def quantize_even(coefficient: Column, weight: Column, scale: Column) -> Column:
    """Nearest quantum, halves to even."""
    return F.rint(coefficient / (weight * scale))


def dequantize_biased(q: Column, weight: Column, scale: Column, channel: int) -> Column:
    """Coefficient of a quantum, pulled toward zero as most real ones are."""
    value = F.when(F.abs(q) <= 1, q * DEAD_ZONE[channel]).otherwise(q - DEAD_ZONE_NUMERATOR / q)
    return value * weight * scale


def global_scale(distance: Column) -> Column:
    """Encoder scale for a distance: straight lines between the points in logarithms, the end ones carried on."""
    out = None
    for (d0, g0), (d1, g1) in zip(DISTANCE_POINTS, DISTANCE_POINTS[1:], strict=False):
        slope = (math.log(g1) - math.log(g0)) / (math.log(d1) - math.log(d0))
        line = F.exp(F.lit(math.log(g0)) + (F.log(distance) - math.log(d0)) * slope)
        out = line if out is None else F.when(distance > d0, line).otherwise(out)
    low, high = SCALE_RANGE
    return F.when(distance <= 0, F.lit(high)).otherwise(F.least(F.greatest(F.rint(out), F.lit(low)), F.lit(high)))


def reciprocal_quantize(v: Column, offset: Column, step: int) -> Column:
    """Sign-magnitude quantiser: the high half of a product with a 32-bit reciprocal, shifted."""
    bits = max(0, (step - 1).bit_length() - 1)
    mantissa = -(-(1 << (32 + bits)) // step)  # rounded up, so that exact multiples of the step keep their quantum
    q = F.shiftright((F.abs(v) + offset) * mantissa, 32 + bits)
    return F.when(v < 0, -q).otherwise(q)
