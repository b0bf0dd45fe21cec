"""JPEG XL's lossy mode: XYB colour, transformed blocks of eight by eight, their contexts and quantisers; reading and writing.

Read: frames of one pass whose blocks are all eight by eight, with the default
matrices and order of coefficients and without smoothing filters; any number of
groups, block multipliers, shares of the luma and context maps. Other block
shapes, filters, patches, splines and noise are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..functions.color import OPSIN, OPSIN_BIAS, OPSIN_INVERSE
from ..functions.quantize import DEAD_ZONE, DEAD_ZONE_NUMERATOR, DISTANCE_POINTS, SCALE_RANGE
from . import jxl_modular
from .jxl import CODESTREAM, LowBits, LowBitsWriter, codestream
from .jxl_entropy import Code, Plan, read_clusters, write_stream
from .jxl_modular import GRADIENT, SECTION, Frame, Info, Tree, _refuse, gradient_residuals, read_channels, read_frame, read_info, read_weights, unpacked
from .raster import BadImage, Raster

BLOCK, GROUP, LOW_GROUP, TILE = 8, 32, 256, 8  # edges of groups and colour tiles in blocks
# The first band and the steps between bands of X, Y and B; what the lowest coefficients are quantised by.
BANDS = [[3150.0, 0.0, -0.4, -0.4, -0.4, -2.0], [560.0, 0.0, -0.3, -0.3, -0.3, -0.3], [512.0, -2.0, -1.0, 0.0, -1.0, -2.0]]
LOW_STEPS = [1 / 32, 1 / 4, 1 / 2]
#: Y comes first in the stream, then X, then B.
STREAM = [1, 0, 2]
# The context group of each kind of block, Y's first; groups, and kinds of a channel.
GROUPS_OF_BLOCKS = [0, 1, 2, 2, 3, 3, 4, 5, 6, 6, 6, 6, 6, 7, 8, 9, 9, 10, 11, 12, 13, 14, 14, 14, 14, 14, 7, 8, 9, 9, 10, 11, 12, 13, 14, 14, 14, 14, 14]
KINDS = 13
# Contexts by the place in the scan and by how many coefficients are left, as runs of (context, places).
PLACE_RUNS = [(k, 1) for k in range(15)] + [(k, 2) for k in range(15, 23)] + [(k, 4) for k in range(23, 31)]
LEFT_RUNS = [(0, 1), (31, 1), (62, 2), (93, 4), (123, 4), (152, 8), (180, 12), (206, 31)]
COUNT_CONTEXTS, PLACE_CONTEXTS = 37, 458
GLOBAL_SCALES = ((1, 11), (2049, 11), (4097, 12), (8193, 16))
LOW_SCALES = ((16, 0), (1, 5), (1, 8), (1, 16))
ORDERS = ((0x5F, 0), (0x13, 0), (0, 0), (0, 13))


def _unrolled(runs: list[tuple[int, int]]) -> list[int]:
    return [v for v, n in runs for _ in range(n)]


def _scan() -> list[int]:
    """Rows first, the place of each coefficient of the diagonals; columns lead in the file."""
    cells = sorted(((x + y, x if (x + y) % 2 == 0 else y, x, y) for x in range(8) for y in range(8)))
    return [8 * x + y for _, _, x, y in cells]


SCAN = _scan()
BY_PLACE, BY_LEFT = _unrolled(PLACE_RUNS), _unrolled(LEFT_RUNS)


def basis(n: int) -> np.ndarray:
    """Row ``k`` gives output ``k`` of ``n`` samples, the mean first; ``n`` times its transpose is the inverse."""
    k, i = np.mgrid[0:n, 0:n]
    return np.cos((2 * i + 1) * k * math.pi / (2 * n)) * np.where(k > 0, math.sqrt(2), 1.0) / n


FORWARD, INVERSE = basis(8), 8 * basis(8).T


def _shrink(n: int) -> np.ndarray:
    """What the lowest ``n`` of ``8 n`` frequencies are worth among ``n`` samples, each the mean of eight."""
    k = np.arange(n) * math.pi / (16 * n)
    return np.sinc(8 * k / math.pi) / np.sinc(k / math.pi)


def large_forward(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a block of any whole eighths, and the mean samples that its lowest ones stand for."""
    (h, w), (rows, columns) = samples.shape, (samples.shape[0] // 8, samples.shape[1] // 8)
    out = basis(h) @ samples @ basis(w).T
    scale = np.outer(_shrink(rows), _shrink(columns))
    return out, rows * columns * basis(rows).T @ (out[:rows, :columns] * scale) @ basis(columns)


def large_inverse(coefficients: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Samples of a block; its lowest coefficients come from the means."""
    (h, w), (rows, columns) = coefficients.shape, means.shape
    v = coefficients.copy()
    v[:rows, :columns] = basis(rows) @ means @ basis(columns).T / np.outer(_shrink(rows), _shrink(columns))
    return h * w * basis(h).T @ v @ basis(w)


def weights() -> np.ndarray:
    """Step of each coefficient of X, Y and B: the inverse of bands along the distance to the mean, geometric between them."""
    y, x = np.mgrid[0:8, 0:8] / 7
    out = []
    for first, *steps in BANDS:
        bands = [first]
        for s in steps:
            bands.append(bands[-1] * (1 + s if s > 0 else 1 / (1 - s)))
        at = np.hypot(x, y) * len(steps) / (math.sqrt(2) + 1e-6)
        low = at.astype(int)
        b = np.array(bands)
        out.append(1 / (b[low] * (b[low + 1] / b[low]) ** (at - low)))
    return np.array(out)


def global_scale_of(distance: float) -> int:
    """The global scale for a visual distance, geometric between the points."""
    if distance <= 0:
        return SCALE_RANGE[1]
    x, y = (np.log([p[k] for p in DISTANCE_POINTS]) for k in (0, 1))
    i = min(max(int(np.searchsorted(x, math.log(distance))), 1), len(x) - 1)
    slope = (y[i] - y[i - 1]) / (x[i] - x[i - 1])
    return min(max(round(math.exp(y[i - 1] + slope * (math.log(distance) - x[i - 1]))), SCALE_RANGE[0]), SCALE_RANGE[1])


# --- colours and blocks ---


def to_xyb(rgb: np.ndarray) -> np.ndarray:
    """Channels first, sRGB from 0 to 1."""
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    mixed = np.cbrt(np.tensordot(np.array(OPSIN), linear, 1) - OPSIN_BIAS) + np.cbrt(OPSIN_BIAS)
    return np.stack([(mixed[0] - mixed[1]) / 2, (mixed[0] + mixed[1]) / 2, mixed[2]])


def from_xyb(v: np.ndarray) -> np.ndarray:
    mixed = (np.stack([v[1] + v[0], v[1] - v[0], v[2]]) - np.cbrt(OPSIN_BIAS)) ** 3 + OPSIN_BIAS
    linear = np.tensordot(np.array(OPSIN_INVERSE), mixed, 1)
    return np.where(linear <= 0.0031308, linear * 12.92, 1.055 * np.maximum(linear, 0.0031308) ** (1 / 2.4) - 0.055)


def blocks_of(planes: np.ndarray) -> np.ndarray:
    """Channels, rows and columns of blocks, their eight by eight coefficients."""
    c, h, w = planes.shape
    v = planes.reshape(c, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4)
    return FORWARD @ v @ FORWARD.T


def planes_of(blocks: np.ndarray) -> np.ndarray:
    c, rows, columns = blocks.shape[:3]
    return (INVERSE @ blocks @ INVERSE.T).transpose(0, 1, 3, 2, 4).reshape(c, 8 * rows, 8 * columns)


@dataclass
class Quantizer:
    """Scales of a frame, and how chroma leans on the luma."""

    scale: int = 4096
    low: int = 32
    precision: int = 0
    factor: int = 84
    base: tuple[float, float] = (0.0, 1.0)
    low_shares: tuple[int, int] = (128, 128)
    color_scales: tuple[float, float] = (1.0, 1.0)

    def low_step(self, c: int) -> float:
        return LOW_STEPS[c] * (1 << 9 - self.precision) / (self.scale * self.low)

    def steps(self, multipliers: np.ndarray, c: int) -> np.ndarray:
        extra = (self.color_scales[0], 1.0, self.color_scales[1])[c]
        return (65536 / (self.scale * multipliers) * extra)[..., None, None] * weights()[c]

    def low_share(self, k: int) -> float:
        return self.base[k] + (self.low_shares[k] - 128) / self.factor

    def share(self, k: int, tiles: np.ndarray) -> np.ndarray:
        return self.base[k] + tiles / self.factor


def coarse(v: np.ndarray, c: int) -> np.ndarray:
    """What quantised values stand for: nearer to zero than they say."""
    near = np.abs(v) < 2
    return np.where(near, v * DEAD_ZONE[c], v - DEAD_ZONE_NUMERATOR / np.where(near, 1, v))


def _tiled(tiles: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, TILE, 0), TILE, 1)[:rows, :columns]


def quantize(blocks: np.ndarray, q: Quantizer, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and other coefficients; X and B less their share of the luma as it will be read."""
    lows, highs = np.zeros(blocks.shape[:3], np.int64), np.zeros(blocks.shape, np.int64)
    luma = np.zeros(blocks.shape[1:])
    for c in STREAM:
        v = blocks[c].copy()
        if c != 1:
            k = c // 2
            v[..., 0, 0] -= q.low_share(k) * luma[..., 0, 0]
            shared = q.share(k, 0) * luma
            shared[..., 0, 0] = 0
            v -= shared
        lows[c] = np.rint(v[..., 0, 0] / q.low_step(c))
        steps = q.steps(multipliers, c)
        highs[c] = np.rint(v / steps)
        highs[c][..., 0, 0] = 0
        if c == 1:
            luma = coarse(highs[c], c) * steps
            luma[..., 0, 0] = lows[c] * q.low_step(c)
    return lows, highs


def dequantize(lows: np.ndarray, highs: np.ndarray, q: Quantizer, multipliers: np.ndarray, shares: np.ndarray) -> np.ndarray:
    out = np.stack([coarse(highs[c], c) * q.steps(multipliers, c) for c in range(3)])
    for c in range(3):
        out[c][..., 0, 0] = lows[c] * q.low_step(c)
    for k, c in ((0, 0), (1, 2)):
        part = q.share(k, shares[k])[..., None, None] * out[1]
        part[..., 0, 0] = q.low_share(k) * out[1][..., 0, 0]
        out[c] += part
    return out


# --- coefficients as values ---


def values_of(highs: np.ndarray) -> np.ndarray:
    """Of the blocks of a group (channels, rows, columns): how many coefficients aren't zero, then those up to the last of them."""
    v = highs.transpose(1, 2, 0, 3, 4)[:, :, STREAM].reshape(-1, 64)[:, SCAN[1:]]
    there = v != 0
    counts = there.sum(1)
    ends = np.where(counts > 0, 63 - there[:, ::-1].argmax(1), 0)
    packed = np.where(v >= 0, 2 * v, -2 * v - 1)
    kept = np.concatenate([np.ones((len(v), 1), bool), np.arange(63) < ends[:, None]], axis=1)
    return np.concatenate([counts[:, None], packed], axis=1)[kept]


@dataclass
class Contexts:
    """Which group of contexts a block has, by kind, multiplier and lowest coefficients."""

    groups: list[int] = field(default_factory=lambda: GROUPS_OF_BLOCKS)
    n: int = 15
    high: list[int] = field(default_factory=list)
    low: list[list[int]] = field(default_factory=lambda: [[], [], []])

    @staticmethod
    def read(bits: LowBits) -> Contexts:
        if bits.take(1):
            return Contexts()
        low = []
        for _ in range(3):
            low.append([unpacked(bits.choice((0, 4), (16, 8), (272, 16), (65808, 32))) for _ in range(bits.take(4))])
        high = [1 + bits.choice((0, 2), (4, 3), (12, 5), (44, 8)) for _ in range(bits.take(4))]
        size = math.prod(len(t) + 1 for t in (*low, high))
        if size > 64:
            raise BadImage("too many groups of contexts")
        groups = read_clusters(bits, 3 * KINDS * size)
        if max(groups) > 15:
            raise BadImage("too many groups of contexts")
        return Contexts(groups, max(groups) + 1, high, low)

    def of(self, multipliers: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """For each channel of the stream, row and column."""
        above = lambda v, limits: sum(((v > t).astype(np.int64) for t in limits), np.zeros(v.shape, np.int64))
        at = np.zeros(multipliers.shape, np.int64)
        for c in (0, 2, 1):
            at = at * (len(self.low[c]) + 1) + above(lows[c], self.low[c])
        size = math.prod(len(t) + 1 for t in self.low)
        table = np.array(self.groups)
        return np.stack([table[(KINDS * k * (len(self.high) + 1) + above(multipliers, self.high)) * size + at] for k in range(3)])


def read_values(bits: LowBits, code: Code, first: int, contexts: Contexts, groups: np.ndarray) -> np.ndarray:
    """The coefficients of a group's blocks (channels, rows, columns)."""
    _, rows, columns = groups.shape
    out = np.zeros((3, rows, columns, 64), np.int64)
    code.begin(bits)
    counts = [[[0] * columns for _ in range(rows)] for _ in range(3)]
    for y in range(rows):
        for x in range(columns):
            for k, c in enumerate(STREAM):
                row, above, group = counts[k][y], counts[k][y - 1] if y else None, int(groups[k, y, x])
                guess = (row[x - 1] if x else 32) if not y else above[x] if not x else above[x] + row[x - 1] + 1 >> 1
                guess = guess if guess < 8 else 4 + guess // 2
                left = row[x] = code.next(bits, first + group + guess * contexts.n)
                base = first + COUNT_CONTEXTS * contexts.n + PLACE_CONTEXTS * group
                before = int(left <= 4)
                for place in range(63):
                    if left > 63 - place:
                        raise BadImage("too many coefficients in a block")
                    if not left:
                        break
                    v = code.next(bits, base + 2 * (BY_LEFT[left - 1] + BY_PLACE[place]) + before)
                    before = int(v > 0)
                    if v:
                        out[c, y, x, SCAN[place + 1]] = unpacked(v)
                        left -= 1
    code.finish()
    return out.reshape(3, rows, columns, 8, 8)


def _header(bits: LowBits):
    """A channel group's own header, which may only point to the shared tree."""
    _refuse(not bits.take(1), "a tree of a group's own")
    own = read_weights(bits)
    _refuse(bits.choice((0, 0), (1, 0), (2, 4), (18, 8)), "a transform of lowest coefficients")
    return own


def _areas(rows: int, columns: int, side: int) -> list[tuple[slice, slice]]:
    return [(slice(y, min(y + side, rows)), slice(x, min(x + side, columns))) for y in range(0, rows, side) for x in range(0, columns, side)]


# --- whole files ---


def raster(data: bytes) -> Raster:
    """A picture of either mode."""
    stream = codestream(data)[2:]
    bits = LowBits(stream)
    about = read_info(bits)
    frame = read_frame(bits, about)
    return jxl_modular.raster(data) if frame.modular else read(about, frame, stream, bits)


def read(about: Info, frame: Frame, stream: bytes, bits: LowBits) -> Raster:
    """The picture of a frame of the lossy mode, from its first section on."""
    _refuse(not about.xyb or frame.ycbcr, "lossy colour that is not XYB")
    _refuse(frame.passes > 1, "a frame of several passes")
    _refuse(frame.flags, "a patch, spline, noise or frame of lowest coefficients")
    _refuse(frame.smoothed, "a smoothing filter")
    _refuse(about.extra or about.exponent or about.bits > 8, "lossy samples of this kind")
    _refuse((frame.width, frame.height) != (about.width, about.height), "an upsampled frame")
    rows, columns = -(-frame.height // 8), -(-frame.width // 8)
    if rows * columns > 1 << 20:
        raise BadImage("an image that is too large")
    low_areas, areas = _areas(rows, columns, LOW_GROUP), _areas(rows, columns, GROUP)
    sections = iter([bits] * (2 + len(low_areas) + len(areas)))
    if len(frame.sizes) > 1:
        at, parts = bits.at // 8, []
        for n in frame.sizes:
            parts.append(LowBits(stream[at : at + n]))
            at += n
        if at > len(stream):
            raise BadImage("the file ends within its sections")
        sections = iter(parts)

    part = next(sections)
    _refuse(not part.take(1), "a custom quantiser of lowest coefficients")
    q = Quantizer(part.choice(*GLOBAL_SCALES), part.choice(*LOW_SCALES), color_scales=tuple(0.8 ** (v - 2) for v in frame.color_scales))
    contexts = Contexts.read(part)
    if not part.take(1):
        q.factor = part.choice((84, 0), (256, 0), (2, 8), (258, 16))
        q.base = tuple(float(np.uint16(part.take(16)).view(np.float16)) for _ in range(2))
        q.low_shares = part.take(8), part.take(8)
    _refuse(not part.take(1), "a frame without a shared tree")
    tree = Tree.read(part, min(1 << 22, 1024 + frame.width * frame.height * 3 // 16))
    lows, multipliers, shares = np.zeros((3, rows, columns), np.int64), np.ones((rows, columns), np.int64), np.zeros((2, rows, columns), np.int64)
    for k, (ys, xs) in enumerate(low_areas):
        part = next(sections)
        h, w = ys.stop - ys.start, xs.stop - xs.start
        q.precision = part.take(2)
        found = read_channels(part, tree, [(h, w)] * 3, _header(part), 1 + k)
        for c, v in zip(STREAM, found, strict=True):
            lows[c, ys, xs] = v
        n = 1 + part.take((h * w - 1).bit_length())
        own = _header(part)
        tiles = -(-h // TILE), -(-w // TILE)
        x_share, b_share, kinds, _ = read_channels(part, tree, [tiles, tiles, (2, n), (h, w)], own, 1 + 2 * len(low_areas) + k)
        _refuse(kinds[0].any() or n != h * w, "a block that is not eight by eight")
        multipliers[ys, xs] = kinds[1].reshape(h, w) + 1
        for out, v in zip(shares, (x_share, b_share), strict=True):
            out[ys, xs] = _tiled(v, h, w)
    if (multipliers < 1).any():
        raise BadImage("a multiplier below one")
    part = next(sections)
    _refuse(not part.take(1), "a custom matrix")
    presets = 1 + part.take((len(areas) - 1).bit_length())
    _refuse(part.choice(*ORDERS), "a custom order of coefficients")
    span = (COUNT_CONTEXTS + PLACE_CONTEXTS) * contexts.n
    code = Code.read(part, span * presets)
    groups = contexts.of(multipliers, lows)
    highs = np.zeros((3, rows, columns, 8, 8), np.int64)
    for ys, xs in areas:
        part = next(sections)
        preset = part.take((presets - 1).bit_length())
        if preset >= presets:
            raise BadImage("a preset that is missing")
        highs[:, ys, xs] = read_values(part, code, span * preset, contexts, groups[:, ys, xs])
    if part.at > 8 * len(part.data):
        raise BadImage("the file ends within its coefficients")
    rgb = from_xyb(planes_of(dequantize(lows, highs, q, multipliers, shares)))[:, : frame.height, : frame.width]
    return Raster(np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8).transpose(1, 2, 0))


def write(rgb: np.ndarray, distance: float | None = None, q: Quantizer | None = None, multiplier: int = 32) -> bytes:
    """A file of ``(height, width, 3)`` bytes by a visual distance or a quantiser; sides are padded to whole blocks by their edges."""
    if rgb.dtype != np.uint8 or rgb.ndim != 3 or rgb.shape[2] != 3 or not rgb.size or max(rgb.shape) > 16384:
        raise BadImage("only RGB bytes are written lossily")
    q = q or Quantizer(global_scale_of(1.0 if distance is None else distance))
    height, width = rgb.shape[:2]
    padded = np.pad(rgb, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    blocks = blocks_of(to_xyb(padded.transpose(2, 0, 1) / 255))
    rows, columns = blocks.shape[1:3]
    multipliers = np.full((rows, columns), multiplier, np.int64)
    lows, highs = quantize(blocks, q, multipliers)
    low_areas, areas = _areas(rows, columns, LOW_GROUP), _areas(rows, columns, GROUP)
    low_streams, kind_streams = [], []
    for ys, xs in low_areas:
        h, w = ys.stop - ys.start, xs.stop - xs.start
        tile = np.zeros((-(-h // TILE), -(-w // TILE)), np.int64)
        kinds = np.stack([np.zeros(h * w, np.int64), multipliers[ys, xs].ravel() - 1])
        low_streams.append(_residuals([lows[c, ys, xs] for c in STREAM]))
        kind_streams.append(_residuals([tile, tile, kinds, np.zeros((h, w), np.int64)]))
    streams = [values_of(highs[:, ys, xs]) for ys, xs in areas]
    low_plan, plan = Plan(low_streams + kind_streams), Plan(streams)

    parts = [LowBitsWriter()]
    parts[0].put(1, 1)
    parts[0].choose(q.scale, *GLOBAL_SCALES)
    parts[0].choose(q.low, *LOW_SCALES)
    parts[0].put(0b111, 3)  # the default contexts and shares, a shared tree
    write_stream(parts[0], 6, np.array([0, GRADIENT, 0, 0, 0]))
    low_plan.describe(parts[0], 1)
    single = len(areas) == 1
    following = lambda: parts[0] if single else parts.append(LowBitsWriter()) or parts[-1]
    for (ys, xs), low, kind in zip(low_areas, low_streams, kind_streams, strict=True):
        out = following()
        n = (ys.stop - ys.start) * (xs.stop - xs.start)
        out.put(q.precision, 2)
        out.put(0b0011, 4)  # the shared tree, default weights, no transform
        low_plan.write(out, low)
        out.put(n - 1, (n - 1).bit_length())
        out.put(0b0011, 4)
        low_plan.write(out, kind)
    out = following()
    out.put(1, 1)
    out.put(0, (len(areas) - 1).bit_length())
    out.put(2, 2)  # the natural order
    plan.describe(out, (COUNT_CONTEXTS + PLACE_CONTEXTS) * 15)
    for values in streams:
        plan.write(following(), values)
    bodies = [p.bytes() for p in parts]

    out = LowBitsWriter()
    out.put(int.from_bytes(CODESTREAM, "little"), 16)
    out.put(0, 1)
    out.choose(height - 1, (0, 9), (0, 13), (0, 18), (0, 30))
    out.put(0, 3)
    out.choose(width - 1, (0, 9), (0, 13), (0, 18), (0, 30))
    out.put(0b11, 2)  # the default metadata, which means XYB, and its matrix
    out.align()
    out.put(0, 1 + 2 + 1 + 2 + 2)  # a plain lossy frame, no flags, no upsampling
    out.put(2, 3)
    out.put(2, 3)
    out.put(0, 2 + 1 + 2)  # one pass, no crop, replacing
    out.put(1, 1)
    out.put(0, 2 + 1 + 1 + 2 + 2 + 2 + 1)  # no name, no filters, no extensions, sections in order
    out.align()
    for body in bodies:
        out.choose(len(body), *SECTION)
    out.align()
    return out.bytes() + b"".join(bodies)


def _residuals(channels: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([gradient_residuals(c).ravel() for c in channels])
