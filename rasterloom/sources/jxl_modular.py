"""JPEG XL's lossless mode: headers, context trees, predictors, reversible transforms; reading and writing.

Read: one group of pixels (up to 1024 on a side), grey or RGB, integers of up to
16 bits or floats. Refused: alpha, crops, animation, custom colour, squeezed
channels and frames of the other mode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .jxl import CODESTREAM, RATIOS, LowBits, LowBitsWriter, SelfCorrecting, Weights, _around, codestream
from .jxl_entropy import Code, write_stream
from .raster import BadImage, Raster

UPSAMPLING = ((1, 0), (2, 0), (4, 0), (8, 0))
NAME = ((0, 0), (0, 4), (16, 5), (48, 10))
CHANNEL = ((0, 3), (8, 6), (72, 10), (1096, 13))
SECTION = ((0, 10), (1024, 14), (17408, 22), (4211712, 30))
GREY, XYB = 1, 2
#: The transform that decorrelates written RGB.
YCOCG = 6
GRADIENT, OWN_ERROR = 5, 6
WIDEST = 1024


@dataclass
class Info:
    """What the headers in front of the first frame say."""

    width: int
    height: int
    bits: int = 8
    exponent: int = 0  # bits of a float's exponent; 0: integers
    extra: int = 0
    alpha: bool = False
    xyb: bool = True
    space: int = 0

    @property
    def channels(self) -> int:
        return 1 if self.space == GREY and not self.xyb else 3


@dataclass
class Frame:
    modular: bool = False
    group: int = 256
    flags: int = 0
    ycbcr: bool = False
    passes: int = 1
    width: int = 0
    height: int = 0
    sizes: list[int] = field(default_factory=list)
    color_scales: tuple[int, int] = (3, 2)  # of X and B, in steps of a fifth
    smoothed: bool = True

    def count(self, side: int) -> int:
        return -(-self.width // side) * -(-self.height // side)


def _depth(bits: LowBits) -> tuple[int, int]:
    if bits.take(1):
        n = bits.choice((32, 0), (16, 0), (24, 0), (1, 6))
        return n, 1 + bits.take(4)
    return bits.choice((8, 0), (10, 0), (12, 0), (1, 6)), 0


def _extensions(bits: LowBits) -> None:
    named = bits.long()
    lengths = [bits.long() for k in range(64) if named >> k & 1]
    bits.at += sum(lengths)


def _refuse(wrong: object, what: str) -> None:
    if wrong:
        raise BadImage(f"{what} is not read")


def read_info(bits: LowBits) -> Info:
    """The size header and the metadata, from behind the signature on."""
    eights = bits.take(1)
    one = lambda: 8 * (1 + bits.take(5)) if eights else 1 + bits.choice((0, 9), (0, 13), (0, 18), (0, 30))
    height = one()
    ratio = bits.take(3)
    out = Info(height * RATIOS[ratio][0] // RATIOS[ratio][1] if ratio else one(), height)
    if not bits.take(1):
        _refuse(bits.take(1), "orientation, preview or animation")
        out.bits, out.exponent = _depth(bits)
        bits.take(1)  # whether 16-bit buffers suffice
        out.extra = bits.choice((0, 0), (1, 0), (2, 4), (1, 12))
        for _ in range(out.extra):
            out.alpha |= _extra_channel(bits)
        out.xyb = bool(bits.take(1))
        out.space = _color(bits)
        _extensions(bits)
    _refuse(not bits.take(1), "a custom transform")
    return out


def _extra_channel(bits: LowBits) -> bool:
    """Whether the next extra channel is alpha."""
    if bits.take(1):
        return True
    kind = bits.named()
    _depth(bits)
    bits.choice((0, 0), (3, 0), (4, 0), (1, 3))
    bits.at += 8 * bits.choice(*NAME)
    _refuse(kind in (2, 5), "a spot colour or filter array")
    if kind == 0:
        bits.take(1)
    return kind == 0


def _color(bits: LowBits) -> int:
    if bits.take(1):
        return 0
    profile, space = bits.take(1), bits.named()
    _refuse(profile, "an embedded profile")
    if space != XYB:
        _refuse(bits.named() == 2, "a custom white point")
        _refuse(space != GREY and bits.named() == 2, "custom primaries")
    if bits.take(1):
        bits.take(24)
    else:
        bits.named()
    bits.named()
    return space


def read_frame(bits: LowBits, info: Info) -> Frame:
    """The frame's header and the sizes of its sections."""
    bits.align()
    out, up = Frame(), 1
    if not bits.take(1):
        _refuse(bits.take(2) in (1, 2), "a frame for others' use")
        out.modular = bool(bits.take(1))
        out.flags = bits.long()
        out.ycbcr = not info.xyb and bool(bits.take(1))
        if not out.flags & 0x20:
            bits.at += 6 if out.ycbcr else 0
            up = bits.choice(*UPSAMPLING)
            for _ in range(info.extra):
                bits.choice(*UPSAMPLING)
        if out.modular:
            out.group = 128 << bits.take(2)
        elif info.xyb:
            out.color_scales = bits.take(3), bits.take(3)
        out.passes = bits.choice((1, 0), (2, 0), (3, 0), (4, 3))
        if out.passes > 1:
            scales = bits.choice((0, 0), (1, 0), (2, 0), (3, 1))
            bits.at += 2 * (out.passes - 1)
            for options in (UPSAMPLING, ((0, 0), (1, 0), (2, 0), (0, 3))):
                for _ in range(scales):
                    bits.choice(*options)
        _refuse(bits.take(1), "a cropped frame")
        mode = None
        for _ in range(1 + info.extra):
            mode = _blending(bits, info.extra > 0, mode)
        last = bits.take(1)
        if not last:
            bits.take(2)
            if mode == 0:
                bits.take(1)
        bits.at += 8 * bits.choice(*NAME)
        out.smoothed = _filters(bits, out.modular)
        _extensions(bits)
    out.width, out.height = -(-info.width // up), -(-info.height // up)
    groups = out.count(out.group)
    n = 1 if groups == out.passes == 1 else 2 + out.count(8 * out.group) + groups * out.passes
    _refuse(bits.take(1), "a permuted table of contents")
    bits.align()
    out.sizes = [bits.choice(*SECTION) for _ in range(n)]
    bits.align()
    return out


def _blending(bits: LowBits, extra: bool, first: int | None) -> int:
    """The blending mode of the colour or, given that, of an extra channel; returns the colour's."""
    mode = bits.choice((0, 0), (1, 0), (2, 0), (3, 2))
    with_alpha = extra and mode in (2, 3)
    if with_alpha:
        bits.choice((0, 0), (1, 0), (2, 0), (3, 3))
    if with_alpha or mode == 4:
        bits.take(1)
    first = mode if first is None else first
    if first:
        bits.take(2)
    return first


def _filters(bits: LowBits, modular: bool) -> bool:
    """Skips the smoothing filters' parameters; whether there is any."""
    if bits.take(1):
        return True
    sharpened = bits.take(1)
    if sharpened and bits.take(1):
        bits.at += 6 * 16
    rounds = bits.take(2)
    if rounds:
        if not modular and bits.take(1):
            bits.at += 8 * 16
        if bits.take(1):
            bits.at += 3 * 16 + 32
        if bits.take(1):
            bits.at += (3 if modular else 4) * 16
        if modular:
            bits.at += 16
    _extensions(bits)
    return bool(sharpened or rounds)


# --- trees ---


@dataclass
class Leaf:
    context: int
    predictor: int
    offset: int
    factor: int
    cluster: int = 0


@dataclass
class Fork:
    property: int
    value: int
    above: Fork | Leaf | None = None
    others: Fork | Leaf | None = None


def unpacked(v: int) -> int:
    return v >> 1 if not v & 1 else -(v + 1 >> 1)


@dataclass
class Tree:
    root: Fork | Leaf
    code: Code

    @staticmethod
    def read(bits: LowBits, limit: int) -> Tree:
        """Nodes come level by level: each fork's two branches stand behind all nodes that are open before it."""
        code = Code.read(bits, 6)
        code.begin(bits)
        nodes: list[Fork | Leaf] = []
        open_, leaves = 1, 0
        while len(nodes) < open_:
            if len(nodes) > limit:
                raise BadImage("a context tree is too large")
            kind = code.next(bits, 1)
            if kind:
                nodes.append(Fork(kind - 1, unpacked(code.next(bits, 0))))
                open_ += 2
                continue
            predictor, offset, log, factor = (code.next(bits, k) for k in (2, 3, 4, 5))
            if predictor > 13 or log > 30 or factor > (1 << 31 - log) - 2:
                raise BadImage("a leaf of a context tree is out of range")
            nodes.append(Leaf(leaves, predictor, unpacked(offset), factor + 1 << log))
            leaves += 1
        code.finish()
        samples = Code.read(bits, leaves)
        child = 1
        for node in nodes:
            if isinstance(node, Fork):
                node.above, node.others = nodes[child], nodes[child + 1]
                child += 2
            else:
                node.cluster = samples.clusters[node.context]
        return Tree(nodes[0], samples)

    def leaf(self, property_: Callable[[int], int]) -> Leaf:
        node = self.root
        while isinstance(node, Fork):
            node = node.above if property_(node.property) > node.value else node.others
        return node

    def any(self, test: Callable[[Fork | Leaf], bool]) -> bool:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if test(node):
                return True
            if isinstance(node, Fork):
                stack += [node.above, node.others]
        return False


def _half(s: int) -> int:
    return s >> 1 if s >= 0 else -(-s >> 1)


def predicted(kind: int, n: int, w: int, nw: int, ne: int, nn: int, ww: int, nee: int, own: int) -> int:
    """The prediction of a kind from the neighbours; ``own`` is the self-correcting one, in eighths."""
    if kind == GRADIENT:
        return min(max(n + w - nw, min(n, w)), max(n, w))
    if kind == OWN_ERROR:
        return own + 3 >> 3
    if kind == 13:
        s = 6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8
        return s // 16 if s >= 0 else -(-s // 16)
    if kind == 4:
        return w if abs(n - nw) < abs(w - nw) else n
    return (0, w, n, _half(w + n), 0, 0, 0, ne, nw, ww, _half(w + nw), _half(n + nw), _half(n + ne))[kind]


def read_channels(bits: LowBits, tree: Tree, shapes: list[tuple[int, int]], weights: Weights, stream: int = 0) -> list[np.ndarray]:
    """Samples of channels of ``(height, width)`` as 32-bit integers that wrap."""
    code = tree.code
    code.begin(bits)
    widest = max((w for _, w in shapes), default=0)
    needs_own = tree.any(lambda x: x.property == 15 if isinstance(x, Fork) else x.predictor == OWN_ERROR)
    _refuse(tree.any(lambda x: isinstance(x, Fork) and x.property > 15), "a property of other channels")
    single = tree.root if isinstance(tree.root, Leaf) else None
    out = []
    for k, (height, width) in enumerate(shapes):
        rows = [[0] * width for _ in range(height)]
        own = SelfCorrecting(width, weights) if needs_own and width else None
        for y in range(height):
            row, up, up2 = rows[y], rows[y - 1] if y else None, rows[y - 2] if y > 1 else None
            slope = 0
            for x in range(width):
                w = row[x - 1] if x else up[0] if y else 0
                n = up[x] if y else w
                nw = (up[x - 1] if x else up[0]) if y else w
                ne = up[x + 1] if y and x + 1 < width else n
                nn, ww = up2[x] if up2 else 0, row[x - 2] if x > 1 else w
                value = worst = 0
                if own:
                    value, worst = own.predict(n, nw, ne, w, nn), own.worst_error()
                leaf = single or tree.leaf((k, stream, y, x, abs(n), abs(w), n, w, w - slope, w - nw + n, w - nw, nw - n, n - ne, n - nn, w - ww, worst).__getitem__)
                nee = up[x + 2] if y and x + 2 < width else ne
                difference = unpacked(code.value(bits, leaf.cluster, widest)) * leaf.factor + leaf.offset
                v = difference + predicted(leaf.predictor, n, w, nw, ne, nn, ww, nee, value)
                row[x] = v = (v + (1 << 31) & 0xFFFFFFFF) - (1 << 31)
                if own:
                    own.record(v)
                slope = w - nw + n
        out.append(np.array(rows, dtype=np.int64).reshape(height, width))
    code.finish()
    return out


# --- transforms ---


@dataclass
class Transform:
    """``kind`` 0: a reversible colour transform, 1: a palette."""

    kind: int
    first: int = 0
    rct: int = 0
    n: int = 0
    colors: int = 0
    deltas: int = 0

    @staticmethod
    def read(bits: LowBits) -> Transform:
        kind = bits.take(2)
        _refuse(kind > 1, "a squeezed channel")
        first = bits.choice(*CHANNEL)
        if kind == 0:
            return Transform(0, first, rct=bits.choice((6, 0), (0, 2), (2, 4), (10, 6)))
        n, colors, deltas = bits.choice((1, 0), (3, 0), (4, 0), (1, 13)), bits.choice((0, 8), (256, 10), (1280, 12), (5376, 16)), bits.choice((0, 0), (1, 8), (257, 10), (1281, 16))
        predictor = bits.take(4)
        if predictor == OWN_ERROR:
            read_weights(bits)
        _refuse(deltas, "a palette of differences")
        return Transform(1, first, n=n, colors=colors)

    def reshape(self, shapes: list[tuple[int, int]]) -> None:
        """What the transform made of the channels' shapes."""
        n = 3 if self.kind == 0 else self.n
        own = shapes[self.first : self.first + n]
        if len(own) < n or len(set(own)) > 1:
            raise BadImage("a transform's channels are missing or differ in size")
        if self.kind:
            del shapes[self.first + 1 : self.first + n]
            shapes.insert(0, (n, self.colors))

    def undo(self, channels: list[np.ndarray], bits: int) -> None:
        if self.kind == 0:
            channels[self.first : self.first + 3] = decorrelated_back(channels[self.first : self.first + 3], self.rct)
        else:
            palette = channels.pop(0)
            channels[self.first : self.first + 1] = looked_up(palette, channels[self.first], bits)


def wrapped(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32).astype(np.int64)


def decorrelated_back(c: list[np.ndarray], kind: int) -> list[np.ndarray]:
    """The channels before a reversible transform."""
    order, form = divmod(kind, 7)
    a, b, c = c
    if form == 6:
        base = a - (c >> 1)
        green = c + base
        low = base - (b >> 1)
        a, b, c = low + b, green, low
    else:
        if form & 1:
            c = c + a
        if form >> 1:
            b = b + (a if form >> 1 == 1 else a + c >> 1)
    out: list[np.ndarray] = [a] * 3
    for k, v in zip(_places(order), (a, b, c), strict=True):
        out[k] = wrapped(v)
    return out


def decorrelated(c: list[np.ndarray], kind: int) -> list[np.ndarray]:
    """The channels after a reversible transform."""
    order, form = divmod(kind, 7)
    a, b, c = (c[k] for k in _places(order))
    if form == 6:
        orange = a - c
        low = c + (orange >> 1)
        green = b - low
        return [wrapped(v) for v in (low + (green >> 1), orange, green)]
    if form >> 1:
        b = b - (a if form >> 1 == 1 else a + c >> 1)
    if form & 1:
        c = c - a
    return [wrapped(v) for v in (a, b, c)]


def _places(order: int) -> tuple[int, int, int]:
    """Where the three channels stand in one of six orders."""
    return order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3


def looked_up(palette: np.ndarray, index: np.ndarray, bits: int) -> list[np.ndarray]:
    """Channels by index into a palette; indices beyond it name colours of two built-in cubes."""
    n = palette.shape[1]
    _refuse((index < 0).any(), "a palette of differences")
    top, out = (1 << bits) - 1, []
    beyond = index - n
    fifth = beyond - 64
    for c, colors in enumerate(palette):
        small = (beyond >> 2 * c & 3) * top // 4 + (1 << max(bits - 3, 0))
        large = fifth // 5**c % 5 * top // 4
        own = colors[np.minimum(index, n - 1)] if n else np.zeros_like(index)
        out.append(np.where(index < n, own, np.where(beyond < 64, small, large)))
    return out


def read_weights(bits: LowBits) -> Weights:
    if bits.take(1):
        return Weights()
    p = [bits.take(5) for _ in range(7)]
    return Weights(p[0], p[1], tuple(p[2:]), tuple(bits.take(4) for _ in range(4)))


# --- whole files ---


def info(data: bytes) -> Info:
    """Size, depth and channels without decoding."""
    return read_info(LowBits(codestream(data)[2:]))


def channels_of(data: bytes) -> tuple[Info, list[np.ndarray]]:
    """Integer samples of each channel; floats as the bits that they are stored by."""
    bits = LowBits(codestream(data)[2:])
    about = read_info(bits)
    frame = read_frame(bits, about)
    _refuse(not frame.modular, "a frame of the lossy mode")
    _refuse(len(frame.sizes) != 1, "an image of several groups")
    _refuse(frame.flags & 0x13, "a patch, spline or noise")
    if not bits.take(1):
        bits.take(48)
    _refuse(frame.ycbcr, "YCbCr")
    _refuse(about.extra, "an extra channel")
    if bits.at > 8 * len(bits.data):
        raise BadImage("the file ends in its headers")
    n = about.channels
    shared = Tree.read(bits, min(1 << 22, 1024 + frame.width * frame.height * n // 16)) if bits.take(1) else None
    use_shared, weights = bits.take(1), read_weights(bits)
    transforms = [Transform.read(bits) for _ in range(bits.choice((0, 0), (1, 0), (2, 4), (18, 8)))]
    shapes = [(frame.height, frame.width)] * n
    for t in transforms:
        t.reshape(shapes)
    if use_shared and shared is None:
        raise BadImage("a shared tree is missing")
    tree = shared if use_shared else Tree.read(bits, min(1 << 20, 1024 + sum(h * w for h, w in shapes)))
    found = read_channels(bits, tree, shapes, weights)
    for t in reversed(transforms):
        t.undo(found, about.bits)
    if bits.at > 8 * len(bits.data):
        raise BadImage("the file ends within its samples")
    return about, found


def raster(data: bytes) -> Raster:
    about, found = channels_of(data)
    v = np.stack(found, axis=2)
    if about.exponent:
        if about.bits == 32:
            return Raster(v.astype(np.int32).view(np.float32))
        _refuse(about.bits != 16, "a float of this size")
        return Raster(v.astype(np.int16).view(np.float16).astype(np.float32))
    _refuse(about.bits > 16, "an integer of over 16 bits")
    kind = np.uint8 if about.bits <= 8 else np.uint16
    return Raster(np.clip(v, 0, np.iinfo(kind).max).astype(kind))


def write(samples: np.ndarray) -> bytes:
    """A file of one group from ``(height, width, 1 or 3)`` of 8- or 16-bit integers, single or half floats."""
    height, width, n = samples.shape
    if max(height, width) > WIDEST or n not in (1, 3) or not samples.size:
        raise BadImage("only grey or RGB of up to 1024 on a side is written")
    is_float = samples.dtype.kind == "f"
    depth = 8 * samples.dtype.itemsize
    v = np.ascontiguousarray(samples)
    if is_float:
        v = v.view(np.int32 if depth == 32 else np.int16)
    channels = [v[..., c].astype(np.int64) for c in range(n)]
    mixed = n == 3 and not is_float
    if mixed:
        channels = decorrelated(channels, YCOCG)

    out = LowBitsWriter()
    out.put(int.from_bytes(CODESTREAM, "little"), 16)
    out.put(0, 1)
    out.choose(height - 1, (0, 9), (0, 13), (0, 18), (0, 30))
    out.put(0, 3)
    out.choose(width - 1, (0, 9), (0, 13), (0, 18), (0, 30))
    out.put(0, 2)  # metadata of its own, without further fields
    out.put(is_float, 1)
    if is_float:
        out.choose(depth, (32, 0), (16, 0), (24, 0), (1, 6))
        out.put((8 if depth == 32 else 5) - 1, 4)
    else:
        out.choose(depth, (8, 0), (10, 0), (12, 0), (1, 6))
    out.put(depth <= (14 if mixed else 16), 1)
    out.put(0, 3)  # no extra channel, no XYB
    if n == 3:
        out.put(1, 1)  # sRGB
    else:
        out.put(0, 2)
        for named in (GREY, 1):  # grey, D65
            out.choose(named, (0, 0), (1, 0), (2, 4), (18, 6))
        out.put(0, 1)
        for named in (13, 0):  # the sRGB curve, perceptual
            out.choose(named, (0, 0), (1, 0), (2, 4), (18, 6))
    out.put(0, 2)  # no extensions
    out.put(1, 1)
    out.align()
    out.put(0, 3)  # a plain frame
    out.put(1, 1)
    out.put(0, 2 + 1 + 2)  # no flags, no YCbCr, no upsampling
    out.put(max(0, (max(height, width) - 1).bit_length() - 7), 2)
    out.put(0, 2 + 1 + 2)  # one pass, no crop, replacing
    out.put(1, 1)  # the last frame
    out.put(0, 2 + 1 + 1 + 2 + 2 + 2 + 1)  # no name, no filters, no extensions, sections in order
    out.align()
    body = _section(channels, mixed)
    out.choose(len(body), *SECTION)
    out.align()
    return out.bytes() + body


def _section(channels: list[np.ndarray], mixed: bool) -> bytes:
    out = LowBitsWriter()
    out.put(1, 1)
    out.put(0, 2)  # no shared tree
    out.put(1, 1)
    out.put(mixed, 2)
    if mixed:
        out.put(0, 2 + 2 + 3)
        out.choose(YCOCG, (6, 0), (0, 2), (2, 4), (10, 6))
    write_stream(out, 6, np.array([0, GRADIENT, 0, 0, 0]))  # a single leaf
    write_stream(out, 1, np.concatenate([gradient_residuals(c).ravel() for c in channels]))
    return out.bytes()


def gradient_residuals(v: np.ndarray) -> np.ndarray:
    """Zigzag codes of samples less their clamped gradient, as 32-bit differences."""
    n, w, nw = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    n[1:], w[:, 1:], nw[1:, 1:] = v[:-1], v[:, :-1], v[:-1, :-1]
    n[0, 1:], nw[0, 1:] = v[0, :-1], v[0, :-1]
    w[1:, 0], nw[1:, 0] = v[:-1, 0], v[:-1, 0]
    low, high = np.minimum(n, w), np.maximum(n, w)
    d = wrapped(v - np.clip(n + w - nw, low, high))
    return np.where(d >= 0, 2 * d, -2 * d - 1)
