"""Integer helpers of the formats as native columns; all arithmetic is on longs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x: Column | int) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def wrap32(x: Column) -> Column:
    """Wraps a long to the range of a signed 32-bit integer."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32)


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    as_column = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.least(F.greatest(x, as_column(low)), as_column(high))


def truncated_div(a: Column, b: int) -> Column:
    """Integer quotient toward zero."""
    quotient = F.floor(F.abs(a) / F.lit(b)).cast("long")
    return F.when(a < 0, -quotient).otherwise(quotient)


def pack_signed(v: Column) -> Column:
    """Zigzag code: 0, -1, 1, -2 to 0, 1, 2, 3."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unpack_signed(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def gradient(n: Column, w: Column, nw: Column) -> Column:
    """n + w - nw, clamped between n and w."""
    return clamp(n + w - nw, F.least(n, w), F.greatest(n, w))


def bit_length(x: Column) -> Column:
    """Bits that hold values 0 to x; none for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def hybrid_token(value: Column, split_exponent: int, msb: int, lsb: int) -> dict[str, Column]:
    """Token, rest bits and their number of a hybrid integer; small values are their own token."""
    split = 1 << split_exponent
    top = F.length(F.bin(value)) - 1
    low = value.bitwiseAND(F.lit((1 << lsb) - 1))
    high = F.floor(value / F.pow(F.lit(2.0), top - msb)).cast("long").bitwiseAND(F.lit((1 << msb) - 1))
    token = split + (top - split_exponent) * (1 << (msb + lsb)) + high * (1 << lsb) + low
    n = top - msb - lsb
    rest = F.pmod(F.shiftright(value, lsb), F.pow(F.lit(2.0), n).cast("long"))
    literal = value < split
    return {
        "token": F.when(literal, value).otherwise(token),
        "rest": F.when(literal, F.lit(0)).otherwise(rest),
        "rest_bits": F.when(literal, F.lit(0)).otherwise(n),
    }


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, above and upper left the nearest to a + b - c; ties go left, then above."""
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
