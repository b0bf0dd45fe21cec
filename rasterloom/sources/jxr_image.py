"""JPEG XR images: planes to macroblocks and back, tiles, orders of bands and pixel formats."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions import float_pixel
from ..operators import macroblocks, overlap
from . import jxr
from .jxr import HighBits, HighBitsWriter
from .jxr_coefficients import BLOCKS, NEIGHBOURS, Macroblocks, Reader, Writer
from .raster import LINEAR, BadImage, Color, Raster

# The place of each sample of a block, rows first, and of the sixteen lowest coefficients of a macroblock.
PLACES = [0, 1, 5, 4, 2, 3, 7, 6, 10, 11, 15, 14, 8, 9, 13, 12]
LOWEST = [0, 128, 64, 208, 32, 240, 48, 224, 16, 192, 80, 144, 112, 176, 96, 160]
# The coefficients of a block that a neighbour in the same macroblock foretells.
FROM_ABOVE, FROM_LEFT = [2, 9, 10], [1, 5, 6]
LEFT, ABOVE, BOTH, NEITHER = range(4)
# By the number of chroma's blocks, the lowest coefficients that tell where edges run, luma's weight against chroma's, and what is foretold from the left and from above.
LEANING = {16: ([1], [4]), 4: ([1], [2]), 8: ([1, 5], [2, 6])}
LUMA_WEIGHT = {16: 2, 4: 8, 8: 4}
SIDES = {16: ([(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 0), (4, 4), (8, 8), (12, 12)]), 4: ([(0, 0), (1, 1)], [(0, 0), (2, 2)]), 8: ([(0, 0), (1, 1), (4, 4), (5, 5)], [(0, 0), (4, 4), (2, 6)])}
# Rows and columns of chroma's blocks by the internal colours.
SHAPES = {jxr.YUV420: (2, 2), jxr.YUV422: (4, 2), jxr.YUV444: (4, 4), jxr.GREY: (4, 4)}
#: Bits that samples gain before the colour transform where the arithmetic is scaled.
SCALE = 3
# Output depths, their middle and range.
UINT8, UINT16, INT16, HALF, INT32, FLOAT32 = 1, 2, 3, 4, 6, 7
MIDDLE = {UINT8: 128, UINT16: 32768}
RANGE = {UINT8: (0, 255), UINT16: (0, 65535), INT16: (-32768, 32767), INT32: (-(2**31), 2**31 - 1)}
DTYPES = {UINT8: np.uint8, UINT16: np.uint16, INT16: np.int16, HALF: np.float16, INT32: np.int32, FLOAT32: np.float32}
# Last byte of the pixel format by channels and depth, and formats with blue first.
PIXELS = {(1, UINT8): 0x08, (3, UINT8): 0x0D, (4, UINT8): 0x0F, (1, UINT16): 0x0B, (3, UINT16): 0x15, (1, INT16): 0x13, (3, INT16): 0x12, (1, INT32): 0x3F, (3, INT32): 0x18, (1, HALF): 0x3E, (3, HALF): 0x3B, (1, FLOAT32): 0x11}
#: Output colour formats, profile and level of what is written.
GREY_OUT, RGB_OUT, PROFILE, LEVEL = 0, 7, 111, 255
MANTISSA, BIAS = 13, 4


@dataclass
class Options:
    """How a plane is coded: quantisers of the three bands, levels of overlap, order of bands, tiles (columns and rows in macroblocks) what is left out, and whether chroma is halved."""

    steps: tuple[int, int, int] = (0, 0, 0)
    overlap: int = 0
    by_frequency: bool = False
    tile_widths: list[int] = field(default_factory=list)
    tile_heights: list[int] = field(default_factory=list)
    flexible: bool = True
    dropped: int = 0
    color: int = jxr.YUV444


def step(index: int, scaled: bool, shift: int = 1) -> int:
    """Step of a quantiser's number; 0 is lossless."""
    if not index:
        return 1
    octave, low = index // 16, index % 16
    if scaled:
        return (low if not octave else 16 + low << octave - 1) << shift
    return index + 3 >> 2 if octave < 2 else 17 + low >> 1 if octave < 3 else 16 + low << octave - 3


def quantized(v: np.ndarray, by: int, offset: int) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + offset) // by)


# --- samples and macroblocks ---


def laid(plane: np.ndarray, shape: tuple[int, int] = (4, 4)) -> np.ndarray:
    """Macroblocks (``shape`` of blocks) of a plane of whole ones in the order that the transforms take: blocks in columns."""
    (h, w), (down, across) = plane.shape, shape
    rows, columns = h // (4 * down), w // (4 * across)
    v = plane.reshape(rows, down, 4, columns, across, 4).transpose(0, 3, 4, 1, 2, 5).reshape(rows, columns, across, down, 16)
    out = np.empty_like(v)
    out[..., PLACES] = v
    return out.reshape(rows, columns, 16 * down * across)


def spread(p: np.ndarray, shape: tuple[int, int] = (4, 4)) -> np.ndarray:
    (rows, columns), (down, across) = p.shape[:2], shape
    v = p.reshape(rows, columns, across, down, 16)[..., PLACES].reshape(rows, columns, across, down, 4, 4)
    return v.transpose(0, 3, 4, 1, 2, 5).reshape(4 * down * rows, 4 * across * columns)


def _second_overlap(p: np.ndarray, shape: tuple[int, int], back: bool) -> np.ndarray:
    """The overlap of the lowest coefficients of blocks, which make a plane of their own."""
    (rows, columns), (down, across) = p.shape[:2], shape
    low = p[..., ::16].reshape(rows, columns, across, down).transpose(0, 3, 1, 2).reshape(down * rows, across * columns)
    low = (overlap.filtered if across == 4 else overlap.pairs_filtered)(low, back).reshape(rows, down, columns, across).transpose(0, 2, 3, 1)
    p = p.copy()
    p[..., ::16] = low.reshape(rows, columns, down * across)
    return p


def transformed(plane: np.ndarray, levels: int, halve: bool, shape: tuple[int, int] = (4, 4)) -> np.ndarray:
    p = laid(overlap.filtered(plane) if levels else plane, shape)
    p = macroblocks.block_forward(p.reshape(*p.shape[:2], -1, 16)).reshape(p.shape)
    if levels > 1:
        p = _second_overlap(p, shape, False)
    if shape != (4, 4):
        return macroblocks.chroma_low_forward(p, shape[0])
    return macroblocks.low_forward(macroblocks.scaled(p, True) if halve else p)


def restored(p: np.ndarray, levels: int, double: bool, shape: tuple[int, int] = (4, 4)) -> np.ndarray:
    if shape != (4, 4):
        p = macroblocks.chroma_low_inverse(p, shape[0])
    else:
        p = macroblocks.low_inverse(p)
        p = macroblocks.scaled(p, False) if double else p
    if levels > 1:
        p = _second_overlap(p, shape, True)
    p = macroblocks.block_inverse(p.reshape(*p.shape[:2], -1, 16)).reshape(p.shape)
    plane = spread(p, shape)
    return overlap.filtered(plane, True) if levels else plane


# --- prediction ---


def _halved(lines: np.ndarray) -> np.ndarray:
    """Each second sample of the last axis, smoothed over five."""
    v = np.concatenate([lines[..., 2:0:-1], lines, lines[..., -2:-1]], axis=-1)
    n = lines.shape[-1]
    a, b, c, d, e = (v[..., k : k + n : 2] for k in range(5))
    return 4 * (b + c + d) + 2 * c + a + e + 8 >> 4


def _doubled(lines: np.ndarray) -> np.ndarray:
    """Twice as many samples on the last axis: each, then the mean with the next; the last one twice."""
    after = np.concatenate([lines[..., 1:], lines[..., -1:]], axis=-1)
    return np.stack([lines, lines + after + 1 >> 1], axis=-1).reshape(*lines.shape[:-1], -1)


def subsampled(plane: np.ndarray, down: bool) -> np.ndarray:
    """A chroma plane of half the columns, and of half the rows if ``down``."""
    v = _halved(plane)
    return _halved(v.T).T if down else v


def upsampled(plane: np.ndarray, down: bool) -> np.ndarray:
    return _doubled(_doubled(plane.T).T if down else plane)


def _foretold(high: np.ndarray, direction: np.ndarray, back: bool, shape: tuple[int, int]) -> np.ndarray:
    """Coefficients less those of the block above or to the left, where the macroblock leans that way, or with them again."""
    v = high.reshape(*high.shape[:2], shape[1], shape[0], 16).copy()  # columns of blocks, then rows
    for way, axis, places in ((ABOVE, 2, FROM_ABOVE), (LEFT, 1, FROM_LEFT)):
        rows, columns = np.nonzero(direction == way)
        part = v[rows, columns]
        for k in places:
            line = part[..., k]
            part[..., k] = np.cumsum(line, axis=axis) if back else np.diff(line, axis=axis, prepend=0)
        v[rows, columns] = part
    return v.reshape(high.shape)


def _sides(across: int, down: int) -> int:
    return ABOVE if 4 * across < down else LEFT if 4 * down < across else BOTH


def lean(low: list[list[int]]) -> int:
    """Where the lowest coefficients of a macroblock say that its edges run."""
    y = [abs(v) for v in low[0]]
    across, down = y[1] + y[2] + y[3], y[4] + y[8] + y[12]
    for plane in low[1:]:
        across, down = across + sum(abs(plane[k]) for k in LEANING[len(plane)][0]), down + sum(abs(plane[k]) for k in LEANING[len(plane)][1])
    return _sides(across, down)


def _source(x: int, y: int, left, above, corner) -> int:
    """Which neighbour the lowest coefficient comes from."""
    if not x or not y:
        return NEITHER if x == y else ABOVE if y else LEFT
    weights = (LUMA_WEIGHT[len(left[1])], 1, 1) if len(left) == 3 else (1,)
    gap = lambda side: sum(w * abs(a[0] - b[0]) for w, a, b in zip(weights, corner, side, strict=True))
    return _sides(gap(left), gap(above))


def _guess(source: int, left, above, c: int) -> list[tuple[int, int]]:
    """Places of a plane's lowest coefficients and what is foretold for them."""
    if source == NEITHER:
        return []
    if source == BOTH:
        return [(0, left[c][0] + above[c][0] + (len(left[c]) < 16) >> 1)]
    side = above if source == ABOVE else left
    return [(k, side[c][of]) for k, of in SIDES[len(side[c])][source]]


def _empty(rows: int, columns: int, blocks: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.zeros((rows, columns, n), np.int64) for n in blocks], [np.zeros((rows, columns, n, 16), np.int64) for n in blocks]


def _order(shape: tuple[int, int]) -> list[int]:
    """Blocks in the stream's order by their place in columns."""
    return BLOCKS if shape == (4, 4) else [k * shape[0] + r for r in range(shape[0]) for k in range(2)]


def _lowest(shape: tuple[int, int]) -> list[int]:
    return LOWEST if shape == (4, 4) else [16 * k for k in _order(shape)]


def tile(ports, rows: int, columns: int, planes: int, chroma: int, flexible: bool, dropped: int, given=None):
    """The macroblocks of a tile through its ports (lowest, lowpass, highpass, plain bits): lowest coefficients and the rest, undone prediction. ``given`` is the same when writing."""
    coder = Macroblocks(planes, flexible, dropped, chroma)
    lows, highs = _empty(rows, columns, coder.blocks)
    above_row, above_patterns = [], []
    for y in range(rows):
        row, patterns = [], []
        for x in range(columns):
            left, above = row[x - 1] if x else None, above_row[x] if y else None
            source = _source(x, y, left, above, above_row[x - 1] if x and y else None)
            guesses = [_guess(source, left, above, c) for c in range(planes)]
            sent = None
            if given:
                sent = [v[y, x].tolist() for v in given[0]]
                for block, guess in zip(sent, guesses, strict=True):
                    if len(block) == 8 and source == ABOVE:
                        block[6] -= block[2]
                    for k, v in guess:
                        block[k] -= v
            forget, settle = x % 16 == 0, x % 16 == 0 or x + 1 == columns
            first = coder.dc(ports[0], [b[0] for b in sent] if given else [0] * planes)
            low = coder.lowpass(ports[1], sent, forget, settle)
            for block, guess, v in zip(low, guesses, first, strict=True):
                block[0] = v
                for k, more in guess:
                    block[k] += more
                if len(block) == 8 and source == ABOVE:
                    block[6] += block[2]
            row.append(low)
            seeds = [patterns[x - 1][c] >> NEIGHBOURS[n][0] & 1 if x else above_patterns[x][c] >> NEIGHBOURS[n][1] & 1 if y else 1 for c, n in enumerate(coder.blocks)]
            found, high = coder.highpass(ports[2], ports[3], [v[y, x].tolist() for v in given[1]] if given else None, int(lean(low) == ABOVE), seeds, forget, settle)
            patterns.append(found)
            if not given:
                for c in range(planes):
                    lows[c][y, x], highs[c][y, x] = low[c], high[c]
        above_row, above_patterns = row, patterns
    return lows, highs


def _leans(lows: list[np.ndarray]) -> np.ndarray:
    y = np.abs(lows[0])
    across, down = y[..., 1:4].sum(2), y[..., 4:13:4].sum(2)
    for v in lows[1:]:
        level, steep = LEANING[v.shape[2]]
        across, down = across + np.abs(v[..., level]).sum(2), down + np.abs(v[..., steep]).sum(2)
    return np.where(4 * across < down, ABOVE, np.where(4 * down < across, LEFT, BOTH))


# --- codestreams ---


def _steps(indices, scaled: bool, planes: int) -> list[list[int]]:
    """Steps of the lowest, lowpass and highpass band of each plane; chroma's are half as large in the first two where scaled."""
    return [[step(band[c], scaled, 1 if not c or b == 2 else 0) for c in range(planes)] for b, band in enumerate(indices)]


def _areas(widths: list[int], heights: list[int], columns: int, rows: int):
    """Top, left, rows and columns of each tile."""
    xs, ys = [sum(widths[:i]) for i in range(len(widths) + 1)] + [columns], [sum(heights[:i]) for i in range(len(heights) + 1)] + [rows]
    if xs != sorted(set(xs)) or ys != sorted(set(ys)):
        raise BadImage("tiles beyond the image")
    return [(t, x, b - t, r - x) for t, b in zip(ys, ys[1:], strict=False) for x, r in zip(xs, xs[1:], strict=False)]


def write_planes(planes: list[np.ndarray], size: tuple[int, int], depth: int, o: Options) -> bytes:
    """A codestream of centred planes (already scaled where that is due) of whole macroblocks."""
    n, (height, width) = len(planes), size
    scaled = is_scaled(o, depth)
    color = jxr.GREY if n == 1 else o.color
    shapes = [(4, 4)] + [SHAPES[color]] * (n - 1)
    dc, lp, hp = _steps([[i] * n for i in o.steps], scaled, n)
    lows, highs = [], []
    for c, (p, shape) in enumerate(zip(planes, shapes, strict=True)):
        v = transformed(p, o.overlap, scaled and c > 0, shape)
        low = v[..., _lowest(shape)]
        low[..., :1], low[..., 1:] = quantized(low[..., :1], dc[c], dc[c] >> 1), quantized(low[..., 1:], lp[c], 3 * lp[c] + 1 >> 3 if lp[c] > 1 else 0)
        high = quantized(v, hp[c], 3 * hp[c] + 1 >> 3 if hp[c] > 1 else 0).reshape(*v.shape[:2], -1, 16)
        high[..., 0] = 0
        lows.append(low)
        highs.append(high)
    leans = _leans(lows)
    highs = [_foretold(v, leans, False, shape)[:, :, _order(shape)] for v, shape in zip(highs, shapes, strict=True)]
    rows, columns = lows[0].shape[:2]
    areas = _areas(o.tile_widths, o.tile_heights, columns, rows)
    bands = 1 if not o.by_frequency else 4 if o.flexible else 3
    packets = []
    for number, (t, x, down, across) in enumerate(areas):
        outs = [HighBitsWriter() for _ in range(bands)]
        for band, out in enumerate(outs):
            out.put(1, 24)
            out.put(number, 5)
            out.put(band + 1 if o.by_frequency else 0, 3)
            if o.dropped and band in (0, 3) and band == bands - 1:
                out.put(o.dropped, 4)
        ports = [Writer(out) for out in outs]
        ports = ports * 4 if bands == 1 else ports + [ports[-1]] * (4 - bands)
        area = np.s_[t : t + down, x : x + across]
        tile(ports, down, across, n, lows[-1].shape[2], o.flexible, o.dropped, ([v[area] for v in lows], [v[area] for v in highs]))
        for out in outs:
            out.align()
            packets.append(out.bytes())
    out = HighBitsWriter()
    tiled = len(areas) > 1
    header = jxr.ImageHeader(width, height, GREY_OUT if n == 1 else RGB_OUT, depth, o.overlap, False, o.by_frequency, 0, tiled or o.by_frequency, True, o.dropped > 0, tiled=tiled, tile_widths=o.tile_widths, tile_heights=o.tile_heights)
    header.write(out)
    more = {"mantissa": MANTISSA, "bias": BIAS} if depth == FLOAT32 else {}
    jxr.PlaneHeader(color, scaled, jxr.ALL_BANDS if o.flexible else jxr.NO_FLEXBITS, n, steps=[[i] * n for i in o.steps], **more).write(out, depth)
    if header.index:
        out.put(1, 16)
        at = 0
        for k, p in enumerate(packets):
            if o.by_frequency and len(p) <= 4:
                out.put(0xFF, 8)
                packets[k] = b""
            else:
                jxr.write_long(out, at)
                at += len(p)
    jxr.write_long(out, 4)
    jxr.write_profiles(out, [(PROFILE, LEVEL)])
    return out.bytes() + b"".join(packets)


def is_scaled(o: Options, depth: int) -> bool:
    return (max(o.steps) > 1 or not o.flexible or o.color != jxr.YUV444) and depth not in (INT32, FLOAT32)


def read_planes(data: bytes):
    """Header, plane header and centred planes of a codestream."""
    bits = HighBits(data)
    h = jxr.ImageHeader.read(bits)
    p = jxr.PlaneHeader.read(bits, h.depth)
    if p.color not in SHAPES or p.bands > jxr.NO_FLEXBITS:
        raise BadImage("colours or bands that are not decoded")
    if h.hard_tiles and len(h.tile_widths) + len(h.tile_heights):
        raise BadImage("tiles that don't overlap")
    if h.overlap > 2:
        raise BadImage("an overlap that is reserved")
    indices = p.steps
    if None in indices:
        raise BadImage("quantisers of tiles")
    rows, columns = (h.height + 15) // 16, (h.width + 15) // 16
    if rows * columns * p.planes > 1 << 20:
        raise BadImage("an image that is too large")
    areas = _areas(h.tile_widths, h.tile_heights, columns, rows)
    bands = 1 if not h.by_frequency else 4 if p.bands == jxr.ALL_BANDS else 3
    offsets: list[int | None] = [0]
    if h.index:
        if bits.take(16) != 1:
            raise BadImage("no index of tiles")
        offsets = []
        for _ in range(len(areas) * bands):
            if bits.peek8() == 0xFF:
                bits.take(8)
                offsets.append(None)
            else:
                offsets.append(jxr.read_long(bits))
    elif len(areas) * bands > 1:
        raise BadImage("no index of tiles")
    rest = jxr.read_long(bits)
    base = bits.at // 8 + rest
    shapes = [(4, 4)] + [SHAPES[p.color]] * (p.planes - 1)
    lows, highs = _empty(rows, columns, [a * b for a, b in shapes])
    for number, (t, x, down, across) in enumerate(areas):
        readers, dropped = [], 0
        for band in range(bands):
            at = offsets[number * bands + band]
            if at is None:
                readers.append(HighBits(bytes(1)))
                continue
            if base + at > len(data):
                raise BadImage("a packet beyond the end")
            reader = HighBits(data[base + at :])
            if reader.take(24) != 1:
                raise BadImage("no packet")
            reader.take(8)
            if h.trimmed and band in (0, 3) and band == bands - 1:
                dropped = reader.take(4)
            readers.append(reader)
        ports = [Reader(r) for r in readers]
        ports = ports * 4 if bands == 1 else ports + [ports[-1]] * (4 - bands)
        area = np.s_[t : t + down, x : x + across]
        parts = tile(ports, down, across, p.planes, lows[-1].shape[2], p.bands == jxr.ALL_BANDS, dropped)
        for whole, part in ((lows, parts[0]), (highs, parts[1])):
            for c in range(p.planes):
                whole[c][area] = part[c]
    leans, out = _leans(lows), []
    dc, lp, hp = _steps(indices, p.scaled, p.planes)
    for c, shape in enumerate(shapes):
        in_columns = np.empty_like(highs[c])
        in_columns[:, :, _order(shape)] = highs[c]
        v = _foretold(in_columns, leans, True, shape).reshape(rows, columns, -1) * hp[c]
        low = lows[c] * lp[c]
        low[..., 0] = lows[c][..., 0] * dc[c]
        v[..., _lowest(shape)] = low
        plane = restored(v, h.overlap, p.scaled and c > 0, shape)
        out.append(plane if shape == (4, 4) else upsampled(plane, shape == SHAPES[jxr.YUV420]))
    return h, p, np.stack(out)


# --- colours and sample formats ---


def lifted(rgb: np.ndarray) -> np.ndarray:
    r, g, b = rgb
    b = b - r
    r = r + (b + 1 >> 1) - g
    return np.stack([g + (r >> 1), -r, b])


def unlifted(yuv: np.ndarray) -> np.ndarray:
    y, u, b = yuv
    r = -u
    g = y - (r >> 1)
    r = r - (b + 1 >> 1) + g
    return np.stack([r, g, b + r])


def _depth(samples: np.ndarray) -> int:
    return next(d for d, t in DTYPES.items() if samples.dtype == t)


def integers(samples: np.ndarray, depth: int) -> np.ndarray:
    if depth == FLOAT32:
        return float_pixel.to_integers(samples, BIAS, MANTISSA)
    if depth == HALF:
        raw = samples.view(np.uint16).astype(np.int64)
        return np.where(raw >> 15, -(raw & 0x7FFF), raw)
    return samples.astype(np.int64)


def codestream(samples: np.ndarray, o: Options) -> bytes:
    """Height, width and one or three channels as a codestream."""
    depth, (height, width, n) = _depth(samples), samples.shape
    v = np.pad(integers(samples, depth), ((0, -height % 16), (0, -width % 16), (0, 0)), mode="edge")
    v = np.moveaxis(v, 2, 0) << (SCALE if is_scaled(o, depth) else 0)
    v = lifted(v) if n == 3 else v.copy()
    v[0] -= MIDDLE.get(depth, 0) << (SCALE if is_scaled(o, depth) else 0)
    planes = list(v)
    if n == 3 and o.color != jxr.YUV444:
        planes[1:] = [subsampled(p, o.color == jxr.YUV420) for p in planes[1:]]
    return write_planes(planes, (height, width), depth, o)


def samples_of(data: bytes) -> np.ndarray:
    """Height, width and channels of a codestream."""
    h, p, v = read_planes(data)
    if h.depth not in DTYPES:
        raise BadImage("a depth that is not decoded")
    shift = SCALE if p.scaled else 0
    # halves round down but for 16 bits
    half = (1 << shift - 1) - (h.depth != UINT16) if shift else 0
    v[0] += (MIDDLE.get(h.depth, 0) << shift) + half
    v = (unlifted(v) if len(v) == 3 else v) >> shift
    v = np.moveaxis(v, 0, 2)[: h.height, : h.width]
    if h.depth == FLOAT32:
        return float_pixel.to_floats(v, p.bias, p.mantissa)
    if h.depth == HALF:
        size = np.minimum(np.abs(v), 0x7FFF)
        return np.where((v < 0) & (size > 0), size | 0x8000, size).astype(np.uint16).view(np.float16)
    return np.clip(v, *RANGE[h.depth]).astype(DTYPES[h.depth])


def write(samples: np.ndarray, options: Options | None = None) -> bytes:
    """A file of one, three or four channels (the fourth, opacity, is lossless in a plane of its own)."""
    o = options or Options()
    height, width, n = samples.shape
    kind = PIXELS.get((n, _depth(samples)))
    if kind is None:
        raise BadImage("samples that have no pixel format")
    alpha = codestream(samples[..., 3:], Options(overlap=o.overlap, tile_widths=o.tile_widths, tile_heights=o.tile_heights)) if n == 4 else None
    return jxr.write(jxr.File(width, height, jxr.FORMAT_PREFIX + bytes([kind]), codestream(samples[..., : min(n, 3)], o), alpha))


def read(data: bytes) -> np.ndarray:
    """Samples of a file in its own type."""
    f = jxr.read(data)
    if f.pixel_format[:15] != jxr.FORMAT_PREFIX or f.pixel_format[15] not in PIXELS.values():
        raise BadImage("a pixel format that is not shown")
    n = next(n for (n, _), last in PIXELS.items() if last == f.pixel_format[15])
    v = samples_of(f.codestream)
    if n < 4:
        return v
    a = samples_of(f.alpha) if f.alpha else np.full((*v.shape[:2], 1), 255, np.uint8)
    if a.shape[:2] != v.shape[:2]:
        raise BadImage("opacity of another size")
    return np.concatenate([v, a], axis=2)


def raster(data: bytes) -> Raster:
    """The formats that are shown: signed samples are not, halves become single floats."""
    f = jxr.read(data)
    f.layout  # a format that is not shown is told first
    v = read(data)
    if v.dtype == np.float16:
        v = v.astype(np.float32)
    return Raster(v, Color(transfer=LINEAR) if v.dtype == np.float32 else Color(), f.icc)
