"""JPEG XR's reversible transforms on many macroblocks at once.

A macroblock is the last axis of an array: 256 coefficients, 16 blocks of 16.
Every step is a lifting step on whole arrays, so its inverse restores all bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

Four = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

# Places of a block that each two-by-two step takes, and where the rotations work.
BLOCK_STEPS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)]
BLOCK_CORNER, BLOCK_EVEN_ODD, BLOCK_ODD_ODD = (0, 1, 2, 3), [(5, 4, 7, 6), (10, 8, 11, 9)], (15, 14, 13, 12)
# The same for the sixteen lowest coefficients, one of each block.
LOW_STEPS = [(0, 192, 48, 240), (64, 128, 112, 176), (16, 208, 32, 224), (80, 144, 96, 160)]
LOW_CORNER, LOW_EVEN_ODD, LOW_ODD_ODD = (0, 64, 16, 80), [(128, 192, 144, 208), (32, 48, 96, 112)], (160, 224, 176, 240)


def two_by_two(a, b, c, d, up: int = 0) -> Four:
    """Sums and differences of four values; its own inverse."""
    a, b = a + d, b - c
    t = a - b + up >> 1
    c, d = t - d, t - c
    return a - d, b + c, c, d


def _turned(a, b):
    b = b - (3 * a + 4 >> 3)
    return a + (3 * b + 4 >> 3), b


def _turned_back(a, b):
    a = a - (3 * b + 4 >> 3)
    return a, b + (3 * a + 4 >> 3)


def rotated(a, b, c, d) -> Four:
    """One direction odd."""
    b, a = b - c, a + d
    c, d = c + (b + 1 >> 1), (a + 1 >> 1) - d
    (a, b), (c, d) = _turned(a, b), _turned(c, d)
    d, c = d + (b >> 1), c - (a + 1 >> 1)
    return a + c, b - d, c, d


def rotated_back(a, b, c, d) -> Four:
    b, a = b + d, a - c
    d, c = d - (b >> 1), c + (a + 1 >> 1)
    (a, b), (c, d) = _turned_back(a, b), _turned_back(c, d)
    c, d = c - (b + 1 >> 1), (a + 1 >> 1) - d
    return a - d, b + c, c, d


def _odd_frame(a, b, c, d, inner: Callable) -> Four:
    """Both directions odd: a rotation of the half sums between two mirrored frames."""
    d, c = d + a, c - b
    half_d, half_c = d >> 1, c >> 1
    a, b = inner(a - half_d, b + half_c)
    b, a = b - half_c, a + half_d
    return a, b, c + b, d - a


def _inner(a, b):
    a = a + (3 * b + 4 >> 3)
    b = b - (3 * a + 3 >> 2)
    return a + (3 * b + 3 >> 3), b


def _inner_back(a, b):
    a = a - (3 * b + 3 >> 3)
    b = b + (3 * a + 3 >> 2)
    return a - (3 * b + 4 >> 3), b


def rotated_twice(a, b, c, d) -> Four:
    return _odd_frame(a, -b, -c, d, _inner)


def rotated_twice_back(a, b, c, d) -> Four:
    a, b, c, d = _odd_frame(a, b, c, d, _inner_back)
    return a, -b, -c, d


def _at(p: np.ndarray, places: Iterable[tuple[int, int, int, int]], step: Callable[..., Four]) -> None:
    for four in places:
        p[..., list(four)] = np.stack(step(*(p[..., k] for k in four)), axis=-1)


def _up(a, b, c, d) -> Four:
    return two_by_two(a, b, c, d, 1)


def block_forward(p: np.ndarray) -> np.ndarray:
    """The core transform of blocks of 16."""
    p = p.copy()
    _at(p, BLOCK_STEPS, two_by_two)
    _at(p, [BLOCK_CORNER], _up)
    _at(p, [BLOCK_ODD_ODD], rotated_twice)
    _at(p, BLOCK_EVEN_ODD, rotated)
    return p


def block_inverse(p: np.ndarray) -> np.ndarray:
    p = p.copy()
    _at(p, [BLOCK_CORNER], _up)
    _at(p, BLOCK_EVEN_ODD, rotated_back)
    _at(p, [BLOCK_ODD_ODD], rotated_twice_back)
    _at(p, BLOCK_STEPS, two_by_two)
    return p


def low_forward(p: np.ndarray) -> np.ndarray:
    """The same transform of the sixteen lowest coefficients of macroblocks."""
    p = p.copy()
    _at(p, LOW_STEPS, two_by_two)
    _at(p, [LOW_CORNER], _up)
    _at(p, [LOW_ODD_ODD], rotated_twice)
    _at(p, LOW_EVEN_ODD, rotated)
    return p


def low_inverse(p: np.ndarray) -> np.ndarray:
    p = p.copy()
    _at(p, LOW_EVEN_ODD, rotated_back)
    _at(p, [LOW_ODD_ODD], rotated_twice_back)
    _at(p, [LOW_CORNER], _up)
    _at(p, LOW_STEPS, two_by_two)
    return p


def forward(p: np.ndarray) -> np.ndarray:
    """Both stages of whole macroblocks, without overlap."""
    blocks = block_forward(p.reshape(*p.shape[:-1], 16, 16)).reshape(p.shape)
    return low_forward(blocks)


def inverse(p: np.ndarray) -> np.ndarray:
    blocks = low_inverse(p).reshape(*p.shape[:-1], 16, 16)
    return block_inverse(blocks).reshape(p.shape)


def chroma_low_forward(p: np.ndarray, rows: int) -> np.ndarray:
    """The second stage of halved chroma: four blocks (``rows`` 2) or eight (``rows`` 4). Halves its inputs first, as the format does."""
    p = p.copy()
    halves = lambda a, b, c, d: two_by_two(a >> 1, b >> 1, c >> 1, d >> 1)
    if rows == 2:
        _at(p, [(0, 32, 16, 48)], halves)
        return p
    _at(p, [(0, 64, 16, 80), (32, 96, 48, 112)], halves)
    p[..., 32] -= p[..., 0]
    p[..., 0] += p[..., 32] + 1 >> 1
    return p


def chroma_low_inverse(p: np.ndarray, rows: int) -> np.ndarray:
    p = p.copy()
    doubled = lambda a, b, c, d: tuple(2 * v for v in two_by_two(a, b, c, d))
    if rows == 2:
        _at(p, [(0, 32, 16, 48)], doubled)
        return p
    p[..., 0] -= p[..., 32] + 1 >> 1
    p[..., 32] += p[..., 0]
    _at(p, [(0, 64, 16, 80), (32, 96, 48, 112)], doubled)
    return p


def scaled(p: np.ndarray, down: bool) -> np.ndarray:
    """Chroma's lowest coefficients halved, or doubled again."""
    p = p.copy()
    p[..., ::16] = p[..., ::16] >> 1 if down else 2 * p[..., ::16]
    return p


def dequantized(p: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    return p * step


def macroblocks(image: np.ndarray) -> np.ndarray:
    """Macroblocks of a plane, its edges repeated to whole ones; blocks and their samples in rows."""
    h, w = image.shape
    v = np.pad(image.astype(np.int64), ((0, -h % 16), (0, -w % 16)), mode="edge")
    parts = v.reshape(v.shape[0] // 16, 4, 4, v.shape[1] // 16, 4, 4)
    return parts.transpose(0, 3, 1, 4, 2, 5).reshape(v.shape[0] // 16, v.shape[1] // 16, 256)


def plane(blocks: np.ndarray, height: int, width: int) -> np.ndarray:
    """The plane that macroblocks make."""
    rows, columns = blocks.shape[:2]
    v = blocks.reshape(rows, columns, 4, 4, 4, 4).transpose(0, 2, 4, 1, 3, 5).reshape(16 * rows, 16 * columns)
    return v[:height, :width]


def ones(pattern: np.ndarray) -> np.ndarray:
    """How many of a macroblock's sixteen blocks a coded-block pattern names."""
    return np.bitwise_count(pattern.astype(np.int64) & 0xFFFF)
