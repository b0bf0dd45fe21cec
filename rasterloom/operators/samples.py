"""Operators on whole rows of samples held as arrays: resampling and reduced blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def doubled(samples: Column) -> Column:
    """Twice as many samples: three quarters of the nearest and one of the next, rounded; the ends stay."""
    n = F.size(samples)

    def pair(i: Column) -> Column:
        near = F.get(samples, i)
        left = F.coalesce(F.get(samples, i - 1), near)
        right = F.coalesce(F.get(samples, i + 1), near)
        blend = lambda far: F.shiftright(3 * near + far + 2, 2)
        first = F.when(i == 0, near).otherwise(blend(left))
        last = F.when(i == n - 1, near).otherwise(blend(right))
        return F.array(first, last)

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), pair))


def halved(samples: Column) -> Column:
    """Half as many samples by the taps 1, 4, 6, 4, 1 over 16. The start is mirrored; at the end the second tap falls on the centre."""
    n = F.size(samples)

    def tap(k: Column) -> Column:
        c = 2 * k
        at = lambda i: F.get(samples, i)
        left, far_left = F.when(c >= 1, c - 1).otherwise(1), F.when(c >= 2, c - 2).otherwise(2)
        far_right = F.when(c + 2 <= n - 1, c + 2).otherwise(c)
        return F.shiftright(4 * (at(left) + at(c) + at(c + 1)) + 2 * at(c) + at(far_left) + at(far_right) + 8, 4)

    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), tap)


def reduced_block(coefficients: Column, size: int) -> list[Column]:
    """``size`` by ``size`` samples of an 8 by 8 block from its lowest coefficients, level-shifted and clamped."""
    at = lambda u, v: F.get(coefficients, F.lit(8 * u + v)).cast("double")
    if size == 1:
        return [_byte(at(0, 0) * 0.125)]
    basis = [[(math.sqrt(0.5) if u == 0 else 1.0) / 2 * math.cos((2 * p + 1) * u * math.pi / (2 * size)) for p in range(size)] for u in range(size)]
    out = []
    for p in range(size):
        for q in range(size):
            total = F.lit(0.0)
            for u in range(size):
                for v in range(size):
                    total = total + basis[u][p] * basis[v][q] * at(u, v)
            out.append(_byte(total))
    return out


def _byte(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x + 128.5), F.lit(0)), F.lit(255))
