"""JPEG XR: the container, the headers of images and planes, quantiser rows and index tables."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from .raster import BadImage

SIGNATURE = b"II\xbc\x01"
IMAGE = b"WMPHOTO\0"
# Tags of the container's directory.
XMP, PROFILE, PIXEL_FORMAT, TURN, KIND, WIDTH, HEIGHT, X_RESOLUTION, Y_RESOLUTION = 0x02BC, 0x8773, 0xBC01, 0xBC02, 0xBC04, 0xBC80, 0xBC81, 0xBC82, 0xBC83
OFFSET, BYTES, ALPHA_OFFSET, ALPHA_BYTES = 0xBCC0, 0xBCC1, 0xBCC2, 0xBCC3
# What all pixel formats begin with, and the last byte, channels and samples of those that are shown.
FORMAT_PREFIX = bytes([0x24, 0xC3, 0xDD, 0x6F, 0x03, 0x4E, 0xFE, 0x4B, 0xB1, 0x85, 0x3D, 0x77, 0x76, 0x8D, 0xC9])
FORMATS = {0x08: (1, "UInt8"), 0x0D: (3, "UInt8"), 0x0F: (4, "UInt8"), 0x0B: (1, "UInt16"), 0x15: (3, "UInt16"), 0x11: (1, "Float32"), 0x3E: (1, "Float32"), 0x3B: (3, "Float32")}
# Internal colour formats, bands and output depths.
GREY, YUV420, YUV422, YUV444, YUVK, COMPONENTS, RGB, RGBE = 0, 1, 2, 3, 4, 6, 7, 8
PLANES = {GREY: 1, YUV420: 3, YUV422: 3, YUV444: 3, YUVK: 4, COMPONENTS: 1, RGB: 3, RGBE: 4}
ALL_BANDS, NO_FLEXBITS, NO_HIGHPASS, DC_ONLY = range(4)
SHIFTED_DEPTHS, FLOAT_DEPTH = (2, 3, 6), 7
UNIFORM, SEPARATE, INDEPENDENT = range(3)
#: Bits of a quantiser's number among so many.
_NUMBER_BITS = [max(0, (n - 2).bit_length()) if n > 2 else 0 for n in range(17)]


class HighBits:
    """Bit fields, highest bit first; zeros follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def peek8(self) -> int:
        """The next eight bits, which stay."""
        i = self.at >> 3
        return (self.data[i] << 8 | self.data[i + 1]) >> 8 - (self.at & 7) & 0xFF

    def take(self, n: int) -> int:
        first, end = self.at >> 3, self.at + n + 7 >> 3
        if n == 1 and first < len(self.data):
            self.at += 1
            return self.data[first] >> (-self.at & 7) & 1
        held = self.data[first:end].ljust(end - first, b"\0")
        self.at += n
        return int.from_bytes(held, "big") >> (8 * end - self.at) & (1 << n) - 1

    def align(self) -> None:
        self.at += -self.at % 8


class HighBitsWriter:
    def __init__(self):
        self.value = self.n = 0
        self.done = bytearray()

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & (1 << bits) - 1
        self.n += bits
        if self.n >= 512:
            left = self.n % 8
            self.done += (self.value >> left).to_bytes(self.n // 8, "big")
            self.value, self.n = self.value & (1 << left) - 1, left

    def align(self) -> None:
        self.put(0, -self.n % 8)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return bytes(self.done) + (self.value << pad).to_bytes((self.n + pad) // 8, "big")


# --- the container ---


@dataclass
class File:
    width: int
    height: int
    pixel_format: bytes
    codestream: bytes
    alpha: bytes | None = None
    turn: int | None = None
    resolution: tuple[float | None, float | None] = (None, None)
    icc: bytes | None = None
    xmp: bytes | None = None

    @property
    def layout(self) -> tuple[int, str]:
        """Channels and sample format of a pixel format that is shown."""
        if self.pixel_format[:15] != FORMAT_PREFIX or self.pixel_format[15] not in FORMATS:
            raise BadImage("a pixel format that is not shown")
        return FORMATS[self.pixel_format[15]]


def directory(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """Tag, type, count and value field of each entry, in the ascending order that is required."""
    if len(data) < 8 or not data.startswith(SIGNATURE):
        raise BadImage("no JPEG XR header")
    (at,) = struct.unpack_from("<I", data, 4)
    if at + 2 > len(data):
        raise BadImage("directory beyond the end")
    (n,) = struct.unpack_from("<H", data, at)
    if not n or at + 6 + 12 * n > len(data):
        raise BadImage("empty or truncated directory")
    out = [struct.unpack_from("<HHI4s", data, at + 2 + 12 * i) for i in range(n)]
    if any(a[0] >= b[0] for a, b in zip(out, out[1:], strict=False)):
        raise BadImage("entries out of order")
    return out


def read(data: bytes) -> File:
    held = {tag: (kind, count, field) for tag, kind, count, field in directory(data)}

    def number(tag: int) -> int | None:
        if tag not in held:
            return None
        kind, count, raw = held[tag]
        if count != 1 or kind not in (1, 3, 4):
            raise BadImage(f"tag {tag:#x} is no single number")
        return int.from_bytes(raw[: {1: 1, 3: 2, 4: 4}[kind]], "little")

    def real(tag: int) -> float | None:
        if tag not in held:
            return None
        kind, count, raw = held[tag]
        if (kind, count) != (11, 1):
            raise BadImage(f"tag {tag:#x} is no single float")
        return struct.unpack("<f", raw)[0]

    def body(tag: int) -> bytes | None:
        if tag not in held:
            return None
        _, count, raw = held[tag]
        at = int.from_bytes(raw, "little")
        if count > 4 and at + count > len(data):
            raise BadImage(f"tag {tag:#x} runs past the end")
        return raw[:count] if count <= 4 else data[at : at + count]

    def stream(at: int, size: int) -> bytes:
        if at > len(data):
            raise BadImage("codestream beyond the end")
        return data[at : at + size]

    needed = [number(tag) for tag in (WIDTH, HEIGHT, OFFSET, BYTES)]
    kind = body(PIXEL_FORMAT)
    if None in needed or kind is None or len(kind) != 16:
        raise BadImage("a tag that is required is missing")
    width, height, at, size = needed
    alpha = (number(ALPHA_OFFSET), number(ALPHA_BYTES))
    return File(width, height, kind, stream(at, size), None if None in alpha else stream(*alpha), number(TURN), (real(X_RESOLUTION), real(Y_RESOLUTION)), body(PROFILE), body(XMP))


def write(f: File) -> bytes:
    """A container; every value that does not fit into its entry starts at an even place."""
    bodies: dict[int, tuple[int, bytes]] = {}
    if f.xmp:
        bodies[XMP] = (1, f.xmp)
    if f.icc:
        bodies[PROFILE] = (7, f.icc)
    bodies[PIXEL_FORMAT] = (1, f.pixel_format)
    numbers = {TURN: f.turn or 0, KIND: 0, WIDTH: f.width, HEIGHT: f.height, OFFSET: 0, BYTES: len(f.codestream)}
    if f.alpha:
        numbers |= {ALPHA_OFFSET: 0, ALPHA_BYTES: len(f.alpha)}
    reals = {X_RESOLUTION: f.resolution[0] or 96.0, Y_RESOLUTION: f.resolution[1] or 96.0}
    tags = sorted([*bodies, *numbers, *reals])
    even = lambda raw: raw + b"\0" * (len(raw) % 2)
    at = 8 + 2 + 12 * len(tags) + 4
    tail = b""
    places = {}
    for tag in sorted(bodies):
        if len(bodies[tag][1]) > 4:
            places[tag] = at + len(tail)
            tail += even(bodies[tag][1])
    for tag, raw in ((OFFSET, f.codestream), (ALPHA_OFFSET, f.alpha)):
        if raw is not None and tag in numbers:
            numbers[tag] = at + len(tail)
            tail += even(raw)
    out = SIGNATURE + struct.pack("<IH", 8, len(tags))
    for tag in tags:
        if tag in bodies:
            kind, raw = bodies[tag]
            out += struct.pack("<HHI", tag, kind, len(raw)) + (struct.pack("<I", places[tag]) if tag in places else raw.ljust(4, b"\0"))
        elif tag in reals:
            out += struct.pack("<HHIf", tag, 11, 1, reals[tag])
        else:
            out += struct.pack("<HHII", tag, 4, 1, numbers[tag])
    return out + struct.pack("<I", 0) + tail


# --- headers of the codestream ---


@dataclass
class ImageHeader:
    """What stands before the planes; sizes of tiles are in macroblocks, the last of each direction is what is left."""

    width: int
    height: int
    color: int = GREY
    depth: int = 1
    overlap: int = 0
    hard_tiles: bool = False
    by_frequency: bool = False
    turn: int = 0
    index: bool = False
    long_words: bool = False
    trimmed: bool = False
    rgb_order: bool = False
    premultiplied: bool = False
    alpha: bool = False
    tile_widths: list[int] = field(default_factory=list)
    tile_heights: list[int] = field(default_factory=list)
    tiled: bool = False

    @staticmethod
    def read(bits: HighBits) -> ImageHeader:
        if bytes(bits.take(8) for _ in range(8)) != IMAGE or bits.take(4) != 1:
            raise BadImage("no image header")
        flag = lambda: bool(bits.take(1))
        h = ImageHeader(0, 0, hard_tiles=flag())
        bits.take(3)
        h.tiled, h.by_frequency, h.turn, h.index, h.overlap = flag(), flag(), bits.take(3), flag(), bits.take(2)
        short, h.long_words = flag(), flag()
        if flag():
            raise BadImage("a window of a larger image")
        h.trimmed = flag()
        bits.take(1)
        h.rgb_order, h.premultiplied, h.alpha, h.color, h.depth = flag(), flag(), flag(), bits.take(4), bits.take(4)
        n = 16 if short else 32
        h.width, h.height = 1 + bits.take(n), 1 + bits.take(n)
        if h.tiled:
            across, down = bits.take(12), bits.take(12)
            h.tile_widths = [bits.take(n // 2) for _ in range(across)]
            h.tile_heights = [bits.take(n // 2) for _ in range(down)]
        return h

    def write(self, out: HighBitsWriter) -> None:
        for c in IMAGE:
            out.put(c, 8)
        short = max(self.width, self.height) <= 1 << 16 and max([0, *self.tile_widths, *self.tile_heights]) < 256
        for value, n in ((1, 4), (self.hard_tiles, 1), (1, 3), (self.tiled, 1), (self.by_frequency, 1), (self.turn, 3), (self.index, 1), (self.overlap, 2), (short, 1), (self.long_words, 1), (0, 1), (self.trimmed, 1), (0, 1), (self.rgb_order, 1), (self.premultiplied, 1), (self.alpha, 1), (self.color, 4), (self.depth, 4)):
            out.put(int(value), n)
        n = 16 if short else 32
        out.put(self.width - 1, n)
        out.put(self.height - 1, n)
        if self.tiled:
            out.put(len(self.tile_widths), 12)
            out.put(len(self.tile_heights), 12)
            for v in (*self.tile_widths, *self.tile_heights):
                out.put(v, n // 2)


def read_steps(bits: HighBits, planes: int) -> list[int]:
    """Quantiser of each plane: one for all, one for luma and one for chroma, or one each."""
    mode = bits.take(2) if planes > 1 else UNIFORM
    if mode > INDEPENDENT:
        raise BadImage("a kind of quantiser row that is reserved")
    sent = [bits.take(8) for _ in range((1, 2, planes)[mode])]
    return [sent[min(c, len(sent) - 1)] for c in range(planes)]


def write_steps(out: HighBitsWriter, steps: list[int]) -> None:
    mode = UNIFORM if len(set(steps)) == 1 else SEPARATE if len(set(steps[1:])) == 1 else INDEPENDENT
    if len(steps) > 1:
        out.put(mode, 2)
    for step in steps[: (1, 2, len(steps))[mode]]:
        out.put(step, 8)


def read_number(bits: HighBits, n: int) -> int:
    """Which of ``n`` quantisers a macroblock has."""
    return 1 + bits.take(_NUMBER_BITS[n]) if n > 1 and bits.take(1) else 0


def write_number(out: HighBitsWriter, n: int, number: int) -> None:
    if n > 1:
        out.put(number > 0, 1)
        if number:
            out.put(number - 1, _NUMBER_BITS[n])


@dataclass
class PlaneHeader:
    color: int = GREY
    scaled: bool = False
    bands: int = ALL_BANDS
    planes: int = 1
    shift: int = 0
    mantissa: int = 0
    bias: int = 0
    #: Quantisers of the bands that are there, one for each plane; null where tiles have their own.
    steps: list[list[int] | None] = field(default_factory=list)

    @staticmethod
    def read(bits: HighBits, depth: int) -> PlaneHeader:
        h = PlaneHeader(bits.take(3), bool(bits.take(1)), bits.take(4))
        h.planes = PLANES.get(h.color, 0)
        if not h.planes or h.bands > DC_ONLY:
            raise BadImage("a colour format or bands that are reserved")
        if h.color in (YUV420, YUV422, YUV444):
            bits.take(8)
        elif h.color == COMPONENTS:
            h.planes = 1 + bits.take(4)
            if h.planes > 15:
                raise BadImage("over 15 components")
            bits.take(4)
        if depth in SHIFTED_DEPTHS:
            h.shift = bits.take(8)
        elif depth == FLOAT_DEPTH:
            h.mantissa, h.bias = bits.take(8), (bits.take(8) + 128) % 256 - 128
        for band in range(_band_count(h.bands)):
            if band and bits.take(1):
                h.steps.append(h.steps[-1])  # those of the band below
            else:
                h.steps.append(read_steps(bits, h.planes) if bits.take(1) else None)
        bits.align()
        return h

    def write(self, out: HighBitsWriter, depth: int) -> None:
        for value, n in ((self.color, 3), (self.scaled, 1), (self.bands, 4)):
            out.put(int(value), n)
        if self.color in (YUV420, YUV422, YUV444):
            out.put(0, 8)
        elif self.color == COMPONENTS:
            out.put(self.planes - 1, 4)
            out.put(0, 4)
        if depth in SHIFTED_DEPTHS:
            out.put(self.shift, 8)
        elif depth == FLOAT_DEPTH:
            out.put(self.mantissa, 8)
            out.put(self.bias, 8)
        for band in range(_band_count(self.bands)):
            if band:
                out.put(0, 1)
            out.put(self.steps[band] is not None, 1)
            if self.steps[band] is not None:
                write_steps(out, self.steps[band])
        out.align()


def _band_count(bands: int) -> int:
    """Lowest band, lowpass and highpass, as far as they are there."""
    return {DC_ONLY: 1, NO_HIGHPASS: 2}.get(bands, 3)


def read_long(bits: HighBits) -> int:
    """A length of two, five or nine bytes; other first bytes announce none."""
    first = bits.take(8)
    if first < 0xFB:
        return first << 8 | bits.take(8)
    return bits.take({0xFB: 32, 0xFC: 64}.get(first, 0))


def write_long(out: HighBitsWriter, value: int) -> None:
    if value < 0xFB00:
        out.put(value, 16)
    else:
        large = value >> 32 > 0
        out.put(0xFC if large else 0xFB, 8)
        out.put(value, 64 if large else 32)


def read_index(bits: HighBits, n: int) -> list[int]:
    """Where each tile starts."""
    if bits.take(16) != 1:
        raise BadImage("no index of tiles")
    return [read_long(bits) for _ in range(n)]


def write_index(out: HighBitsWriter, offsets: list[int]) -> None:
    out.put(1, 16)
    for at in offsets:
        write_long(out, at)


def read_profiles(bits: HighBits) -> list[tuple[int, int]]:
    """Profiles and levels that the codestream keeps to, the last one marked."""
    out = []
    while len(out) < 1024:
        out.append((bits.take(8), bits.take(8)))
        if bits.take(16) & 1:
            return out
    raise BadImage("profiles without an end")


def write_profiles(out: HighBitsWriter, profiles: list[tuple[int, int]]) -> None:
    for k, (profile, level) in enumerate(profiles):
        out.put(profile, 8)
        out.put(level, 8)
        out.put(k == len(profiles) - 1, 16)
