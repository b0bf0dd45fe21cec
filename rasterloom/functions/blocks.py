"""Block transforms, lifting steps and layouts of the transform formats as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import let


def dct_basis(n: int) -> list[float]:
    """Row ``k`` has the weights of output ``k``: the mean first, the others scaled by the root of two."""
    return [(math.sqrt(2) if k else 1.0) / n * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for k in range(n) for i in range(n)]


def forward_dct(samples: Column, n: int) -> Column:
    """Coefficients of an ``n`` by ``n`` block held as one array, rows first, then columns."""
    basis = F.array(*map(F.lit, dct_basis(n)))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    span = F.sequence(F.lit(0), F.lit(n - 1))
    every = F.sequence(F.lit(0), F.lit(n * n - 1))
    row = lambda i: (F.floor(i / n)).cast("int")
    across = lambda s, w: F.transform(every, lambda i: total(F.transform(span, lambda j: F.get(s, row(i) * n + j) * F.get(w, (i % n) * n + j))))
    down = lambda s, w: F.transform(every, lambda i: total(F.transform(span, lambda j: F.get(s, j * n + i % n) * F.get(w, row(i) * n + j))))
    return let(basis, lambda w: let(across(samples, w), lambda s: down(s, w)))


def core_2x2(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """Reversible two-by-two butterfly; applied twice it gives its inputs back."""
    a1, b1 = a + d, b - c
    t = F.shiftright(a1 - b1, 1)
    c1, d1 = t - d, t - c
    return [a1 - d1, b1 + c1, c1, d1]


def overlap_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Boundary pre-filter of two samples as lifting steps."""
    b = b - F.shiftright(a + 2, 2)
    a = a - F.shiftright(b + 1, 1)
    for bits in (5, 9, 13):
        a = a - F.shiftright(b, bits)
    return a, b - F.shiftright(a + 2, 2)


def overlap_pair_inverse(a: Column, b: Column) -> tuple[Column, Column]:
    b = b + F.shiftright(a + 2, 2)
    for bits in (13, 9, 5):
        a = a + F.shiftright(b, bits)
    a = a + F.shiftright(b + 1, 1)
    return a, b + F.shiftright(a + 2, 2)


def signed16(x: Column) -> Column:
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def wavelet_pair(a: Column, b: Column, narrow: bool) -> tuple[Column, Column]:
    """Mean and difference of 16-bit values, the narrow kind on signed values."""
    if narrow:
        a, b = signed16(a), signed16(b)
        return F.pmod(F.shiftright(a + b, 1), F.lit(65536)), F.pmod(a - b, F.lit(65536))
    a = F.pmod(a + 32768, F.lit(65536))
    m = F.shiftright(a + b, 1)
    return F.when(a < b, F.pmod(m + 32768, F.lit(65536))).otherwise(m), F.pmod(a - b, F.lit(65536))


def half_to_integer(bits: Column) -> Column:
    """Sign-magnitude half bits (0 to 65535) as an integer of that sign."""
    magnitude = bits % 32768
    return F.when(bits >= 32768, -magnitude).otherwise(magnitude)


def integer_to_half(p: Column) -> Column:
    magnitude = F.abs(p) % 32768
    return F.when(p < 0, F.when(magnitude > 0, 65536 - 32768 + magnitude).otherwise(0)).otherwise(magnitude)


def correlation(factor: Column, base: float, colour_factor: int) -> Column:
    """Share of the luma in a chroma channel."""
    return base + factor / float(colour_factor)


def synthetic_colour(index: Column, channel: int, depth: int) -> Column:
    """Channel of a palette index beyond the palette: 64 steps of four levels, then levels of fifths."""
    half, scale = 1 << max(depth - 3, 0), (1 << depth) - 1
    levels = F.floor(F.shiftright(index, 2 * channel) % 4 * scale / 4) + half
    fifths = F.floor(F.floor((index - 64) / 5**channel) % 5 * scale / 4)
    return F.when(index < 64, levels).otherwise(fifths).cast("long")
