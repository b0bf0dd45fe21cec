"""JPEG XR's overlap between blocks: lifting steps on whole arrays of squares and pairs that straddle block edges.

A plane is filtered in squares of four by four samples, two from each block that
meets there; along the plane's edges only lines of four are left, at its corners
two by two samples. The same squares over the lowest coefficients of blocks make
the second level. Every step is undone exactly by its mirrored one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .macroblocks import two_by_two


def _turn(a, b):
    b = b - (a + 1 >> 1)
    return a + (b + 1 >> 1), b


def _turn_back(a, b):
    a = a - (b + 1 >> 1)
    return a, b + (a + 1 >> 1)


def _spread(a, b, c, d):
    """Of a mirrored quadruple: sums, differences and their halves."""
    a, b = a + d, b - c
    d = (a - b >> 1) - d
    c = c + (b >> 1)
    return a - (3 * c + 4 >> 3), b + d, d, c


def _spread_back(a, b, c, d):
    b = b - c
    a = a + (3 * d + 4 >> 3)
    d = d - (b >> 1)
    c = (a - b >> 1) - c
    return a - c, b + d, d, c


def _scale(a, d):
    d = d - (a >> 7)
    d = d + (a >> 10)
    d = d - (3 * a >> 4)
    a = a - (3 * d >> 3)
    d = (a >> 1) - d
    return a - d, d


def _scale_back(a, d):
    a = a + d
    d = (a >> 1) - d
    a = a + (3 * d >> 3)
    d = d + (3 * a >> 4)
    d = d + (a >> 7)
    return a, d - (a >> 10)


def _edge_scale(a, d):
    d = -d
    a = a - d
    d = d + (a >> 1)
    return _scale(a - (3 * d + 4 >> 3), d)


def _edge_scale_back(a, d):
    a, d = _scale_back(a, d)
    a = a + (3 * d + 4 >> 3)
    d = d - (a >> 1)
    return a + d, -d


def _framed(a, b, c, d, inner: Callable):
    d, c = d + a, c - b
    s, t = d >> 1, c >> 1
    a, b = inner(a - s, b + t)
    b, a = b - t, a + s
    return a, b, c + b, d - a


def _lean(a, b):
    a = a + (3 * b + 4 >> 3)
    b = b - (3 * a + 2 >> 2)
    return a + (3 * b + 6 >> 3), b


def _lean_back(a, b):
    a = a - (3 * b + 6 >> 3)
    b = b + (3 * a + 2 >> 2)
    return a - (3 * b + 4 >> 3), b


def line(a, b, c, d, back: bool = False):
    """Four samples in a line across an edge."""
    a, b = a + d, b + c
    d, c = d - (a + 1 >> 1), c - (b + 1 >> 1)
    if back:
        a, d = _edge_scale_back(a, d)
        b, c = _edge_scale_back(b, c)
        c, d = _turn_back(c, d)
    else:
        c, d = _turn(c, d)
        a, d = _edge_scale(a, d)
        b, c = _edge_scale(b, c)
    d, c = d + (a + 1 >> 1), c + (b + 1 >> 1)
    return a - d, b - c, c, d


def square(w: np.ndarray, back: bool = False) -> np.ndarray:
    """Squares of four by four samples (the last two axes) across four blocks."""
    quads = [(w[..., r, c], w[..., r, 3 - c], w[..., 3 - r, c], w[..., 3 - r, 3 - c]) for r, c in ((1, 1), (1, 0), (0, 1), (0, 0))]
    if back:
        quads = [two_by_two(*q) for q in quads]
    else:
        quads = [_spread(*q) for q in quads]
        quads = [(a, b, c, d) for (a, d), (_, b, c, _) in zip((_scale(q[0], q[3]) for q in quads), quads, strict=True)]
    first, right, below, far = (list(v) for v in zip(*quads, strict=True))
    turn = _turn_back if back else _turn
    for side, pairs in ((below, ((2, 3), (0, 1))), (right, ((1, 3), (0, 2)))):
        for i, j in pairs:
            side[i], side[j] = turn(side[i], side[j])
    far = list(_framed(*far, _lean_back if back else _lean))
    if back:
        for i in range(4):
            first[i], far[i] = _scale_back(first[i], far[i])
    out = np.empty_like(w)
    for i, (r, c) in enumerate(((1, 1), (1, 0), (0, 1), (0, 0))):
        q = (first[i], right[i], below[i], far[i])
        out[..., r, c], out[..., r, 3 - c], out[..., 3 - r, c], out[..., 3 - r, 3 - c] = _spread_back(*q) if back else two_by_two(*q)
    return out


def _pair(a, b, back: bool):
    if back:
        b = b + (a + 2 >> 2)
        for up, n in ((1, 1), (0, 5), (0, 9), (0, 13)):
            a = a + (b + up >> n)
        return a, b + (a + 2 >> 2)
    b = b - (a + 2 >> 2)
    for up, n in ((1, 1), (0, 5), (0, 9), (0, 13)):
        a = a - (b + up >> n)
    return a, b - (a + 2 >> 2)


def pairs_filtered(plane: np.ndarray, back: bool = False) -> np.ndarray:
    """The second level of halved chroma: squares of two by two, pairs along the edges, corners that follow their neighbour in the row."""
    out = plane.copy()
    a, b, c, d = (plane[r::2, k::2][: plane.shape[0] // 2 - 1, : plane.shape[1] // 2 - 1] for r in (1, 2) for k in (1, 2))
    a, b = a + d, b + c
    d, c = d - (a + 1 >> 1), c - (b + 1 >> 1)
    a, b = _pair(a, b, back)
    d, c = d + (a + 1 >> 1), c + (b + 1 >> 1)
    for (r, k), v in zip(((1, 1), (1, 2), (2, 1), (2, 2)), (a - d, b - c, c, d), strict=True):
        out[r:-1:2, k:-1:2][: v.shape[0], : v.shape[1]] = v
    for edge in (0, -1):
        for line_in, line_out in ((plane[edge], out[edge]), (plane[:, edge], out[:, edge])):
            line_out[1:-1:2], line_out[2:-1:2] = _pair(line_in[1:-1:2], line_in[2:-1:2], back)
    for r in (0, -1):
        for k, beside in ((0, 1), (-1, -2)):
            out[r, k] += out[r, beside] - plane[r, beside] if plane.shape[1] > 2 else 0
    return out


def filtered(plane: np.ndarray, back: bool = False) -> np.ndarray:
    """A plane of whole blocks before the transform, or after its inverse."""
    h, w = plane.shape
    out = plane.copy()
    down, across = h // 4 - 1, w // 4 - 1
    inner = plane[2:-2, 2:-2].reshape(down, 4, across, 4).transpose(0, 2, 1, 3)
    out[2:-2, 2:-2] = square(inner, back).transpose(0, 2, 1, 3).reshape(h - 4, w - 4)
    for edge in (0, 1, -2, -1):
        for lines in (out[edge, 2:-2].reshape(across, 4), out[2:-2, edge].reshape(down, 4)):
            lines[...] = np.stack(line(*np.moveaxis(lines.copy(), -1, 0), back), axis=-1)
    for r in (slice(0, 2), slice(-2, None)):
        for c in (slice(0, 2), slice(-2, None)):
            out[r, c] = np.stack(line(*out[r, c].ravel(), back)).reshape(2, 2)
    return out
