"""Colour transforms and sample expansion as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .integers import clamp, wrap32

# The opsin matrices and bias of the XYB colour space.
OPSIN = [[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 0.55180986650955362]]
OPSIN_INVERSE = [[11.031566901960783, -9.866943921568629, -0.16462299647058826], [-3.254147380392157, 4.418770392156863, -0.16462299647058826], [-3.6588512862745097, 2.7129230470588235, 1.9459282392156863]]
OPSIN_BIAS = -0.0037930732552754493
# For each channel order of the reversible transform, which decoded channel is shown first, second, third.
CHANNEL_ORDERS = [(0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1), (1, 0, 2), (2, 1, 0)]


def lifted_forward(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Reversible lifting of RGB; the second channel becomes the luma."""
    b1 = b - r
    r1 = r + F.shiftright(b1 + 1, 1) - g
    return {"u": r1, "y": g + F.shiftright(r1, 1), "v": b1}


def lifted_inverse(u: Column, y: Column, v: Column) -> dict[str, Column]:
    g = y - F.shiftright(u, 1)
    r = u - F.shiftright(v + 1, 1) + g
    return {"r": r, "g": g, "b": v + r}


def cmyk_forward(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    y1 = y - c
    c1 = c + F.shiftright(y1 + 1, 1) - m
    m1 = m + F.shiftright(c1, 1) - k
    return {"c": c1, "m": m1, "y": y1, "k": k + F.shiftright(m1 + 1, 1)}


def cmyk_inverse(c: Column, m: Column, y: Column, k: Column) -> dict[str, Column]:
    k0 = k - F.shiftright(m + 1, 1)
    m0 = m - F.shiftright(c, 1) + k0
    c0 = c - F.shiftright(y + 1, 1) + m0
    return {"c": c0, "m": m0, "y": y + c0, "k": k0}


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """BT.601 in 20-bit fixed point. The blue part of green loses its low 16 bits before the sum."""
    base = y * (1 << 20) + (1 << 19)
    u, v = cb - 128, cr - 128
    # The 12-bit coefficients, moved up by 8 bits.
    red, green_v, green_u, blue = (int(c * 4096 + 0.5) << 8 for c in (1.402, 0.71414, 0.34414, 1.772))
    masked = (u * -green_u).bitwiseAND(F.lit(-65536))
    return {n: clamp(F.shiftright(x, 20), 0, 255) for n, x in (("r", base + v * red), ("g", base - v * green_v + masked), ("b", base + u * blue))}


def byte_product(x: Column, y: Column) -> Column:
    """x * y / 255, rounded, without a division."""
    t = x * y + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def in_decoded_order(order: Column, channels: list[Column]) -> list[Column]:
    """Channels as the reversible transform takes them, for each of its six orders."""
    return [_choose(order, [channels[o.index(k)] for o in CHANNEL_ORDERS]) for k in range(3)]


def in_shown_order(order: Column, decoded: list[Column]) -> list[Column]:
    return [_choose(order, [decoded[o[k]] for o in CHANNEL_ORDERS]) for k in range(3)]


def reversible_residuals(form: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """Residuals of one of seven reversible transforms."""
    chroma = wrap32(d - f)
    middle = wrap32(f + F.shiftright(chroma, 1))
    green = wrap32(e - middle)
    second = F.when(form.isin(2, 3), e - d).when(form.isin(4, 5), e - F.shiftright(wrap32(d + f), 1)).otherwise(e)
    third = F.when(form.isin(1, 3, 5), f - d).otherwise(f)
    lifted = [middle + F.shiftright(green, 1), chroma, green]
    return [wrap32(F.when(form == 6, x).otherwise(y)) for x, y in zip(lifted, (d, second, third), strict=True)]


def reversible_decoded(form: Column, a: Column, b: Column, c: Column) -> list[Column]:
    middle = wrap32(a - F.shiftright(c, 1))
    blue = wrap32(middle - F.shiftright(b, 1))
    third = wrap32(F.when(form.isin(1, 3, 5), c + a).otherwise(c))
    second = F.when(form.isin(2, 3), b + a).when(form.isin(4, 5), b + F.shiftright(wrap32(a + third), 1)).otherwise(b)
    return [wrap32(F.when(form == 6, x).otherwise(y)) for x, y in ((blue + b, a), (c + middle, second), (blue, third))]


def _choose(index: Column, options: list[Column]) -> Column:
    out = options[0]
    for i, o in enumerate(options[1:], 1):
        out = F.when(index == i, o).otherwise(out)
    return out


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def linear_to_xyb(r: Column, g: Column, b: Column) -> dict[str, Column]:
    root = lambda x: F.cbrt(x - OPSIN_BIAS) + F.cbrt(F.lit(OPSIN_BIAS))
    lms = [root(m[0] * r + m[1] * g + m[2] * b) for m in OPSIN]
    return {"x": (lms[0] - lms[1]) * 0.5, "y": (lms[0] + lms[1]) * 0.5, "b": lms[2]}


def xyb_to_linear(x: Column, y: Column, b: Column) -> dict[str, Column]:
    cube = lambda v: v * v * v + OPSIN_BIAS
    bias = F.cbrt(F.lit(OPSIN_BIAS))
    lms = [cube(y + x - bias), cube(y - x - bias), cube(b - bias)]
    return {n: m[0] * lms[0] + m[1] * lms[1] + m[2] * lms[2] for n, m in zip("rgb", OPSIN_INVERSE, strict=True)}


def expand_rgba8(samples: list[Column], bits: int) -> dict[str, Column]:
    """Display pixels of 1 to 4 integer samples; 16-bit samples keep their high byte."""
    high = [F.shiftright(s, 8) if bits == 16 else s for s in samples]
    color = high[:3] if len(high) > 2 else [high[0]] * 3
    alpha = high[-1] if len(high) in (2, 4) else F.lit(255)
    return dict(zip("rgba", [*color, alpha], strict=True))


def expand_float(samples: list[Column], bits: int) -> dict[str, Column]:
    """The same in 0 to 1 single precision; opaque without an alpha sample."""
    unit = [(s / float((1 << bits) - 1)).cast("float") for s in samples]
    color = unit[:3] if len(unit) > 2 else [unit[0]] * 3
    alpha = unit[-1] if len(unit) in (2, 4) else F.lit(1.0).cast("float")
    return dict(zip("rgba", [*color, alpha], strict=True))
