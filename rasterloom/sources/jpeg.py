"""JPEG: marker segments, a baseline encoder and a baseline and progressive decoder."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.quantize import CHROMA_STEPS, LUMA_STEPS
from .raster import BadImage, Color, Raster

# Natural place of each coefficient in zigzag order: along the diagonals, their direction in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
PLACE = np.argsort(ZIGZAG)

# The standard Huffman tables, numbers of codes of 1 to 16 bits and the symbols in order.
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    [
        1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177,
        193, 21, 82, 209, 240, 36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55,
        56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106,
        115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163,
        164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211,
        212, 213, 214, 215, 216, 217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
    ],
)
AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    [
        0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193,
        9, 35, 51, 82, 240, 21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241, 23, 24, 25, 26, 38, 39, 40, 41, 42, 53, 54,
        55, 56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105,
        106, 115, 116, 117, 118, 119, 120, 121, 122, 130, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154,
        162, 163, 164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202,
        210, 211, 212, 213, 214, 215, 216, 217, 218, 226, 227, 228, 229, 230, 231, 232, 233, 234, 242, 243, 244, 245, 246, 247, 248, 249, 250,
    ],
)
_F = np.float32


@dataclass
class Segment:
    marker: int
    offset: int
    payload: bytes


def segments(data: bytes) -> Iterator[Segment]:
    """Marker segments up to the first scan or the end of the image."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadImage("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        (n,) = struct.unpack_from(">H", data, at + 2)
        if n < 2 or at + 2 + n > len(data):
            raise BadImage("segment runs past the end")
        yield Segment(marker, at, data[at + 4 : at + 2 + n])
        at += 2 + n


def app_payload(data: bytes, marker: int, prefix: bytes) -> bytes | None:
    """What follows ``prefix`` in the first such application segment."""
    return next((s.payload[len(prefix) :] for s in segments(data) if s.marker == marker and s.payload.startswith(prefix)), None)


def with_icc(data: bytes, profile: bytes) -> bytes:
    """``data`` with a profile in one segment behind its application segments."""
    if len(profile) > 65519:
        raise BadImage("profile too long for one segment")
    at = 2
    for s in segments(data):
        if not 0xE0 <= s.marker <= 0xEF:
            break
        at = s.offset + 4 + len(s.payload)
    body = b"ICC_PROFILE\0\1\1" + profile
    return data[:at] + b"\xff\xe2" + struct.pack(">H", len(body) + 2) + body + data[at:]


# ---------------------------------------------------------------- encoder


def code_table(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical code and its bits for each symbol."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, size)
            code += 1
        at += n
        code <<= 1
    return out


_DC, _AC = [code_table(*DC_LUMA), code_table(*DC_CHROMA)], [code_table(*AC_LUMA), code_table(*AC_CHROMA)]


def _dct(d: list[np.ndarray]) -> list[np.ndarray]:
    """Scaled eight-point transform in single precision; the order of the sums matters to the last bit."""
    s = [d[i] + d[7 - i] for i in range(4)]
    t = [d[i] - d[7 - i] for i in range(4)]
    a, b, c, e = s[0] + s[3], s[1] + s[2], s[1] - s[2], s[0] - s[3]
    z1 = (c + e) * _F(0.707106781)
    p, q, r = t[3] + t[2], t[2] + t[1], t[1] + t[0]
    z5 = (p - r) * _F(0.382683433)
    z2, z4, z3 = p * _F(0.541196100) + z5, r * _F(1.306562965) + z5, q * _F(0.707106781)
    u, v = t[0] + z3, t[0] - z3
    return [a + b, u + z4, e + z1, v - z2, a - b, v + z2, e - z1, u - z4]


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _quantized(plane: np.ndarray, divisors: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each block in zigzag order, halves away from zero."""
    b = _blocks(plane)
    rows = np.stack(_dct([b[..., i] for i in range(8)]), axis=-1)
    both = np.stack(_dct([rows[..., i, :] for i in range(8)]), axis=-2)
    v = both.reshape(*both.shape[:2], 64) * divisors
    return np.where(v < 0, v - _F(0.5), v + _F(0.5)).astype(np.int32)[..., ZIGZAG]


def _bits_of(value: int) -> tuple[int, int]:
    size = abs(value).bit_length()
    return (value if value > 0 else value - 1) & ((1 << size) - 1), size


def _block_codes(block: list[int], before: int, dc: dict, ac: dict, out: list[tuple[int, int]]) -> None:
    code, size = _bits_of(block[0] - before) if block[0] != before else (0, 0)
    out.append(dc[size])
    if size:
        out.append((code, size))
    last, run = max((i for i in range(64) if block[i]), default=0), 0
    for i in range(1, last + 1):
        if not block[i]:
            run += 1
            continue
        out += [ac[0xF0]] * (run // 16)
        code, size = _bits_of(block[i])
        out += [ac[run % 16 * 16 + size], (code, size)]
        run = 0
    if last < 63:
        out.append(ac[0])


def encode(samples: np.ndarray, quality: int = 90, chroma: str = "auto") -> bytes:
    """Baseline file of three components from 8-bit samples of 1 to 4 channels; alpha is left out.

    ``chroma`` is "444", "420" or "auto": halved up to quality 90.
    """
    h, w, c = samples.shape
    if samples.dtype != np.uint8 or not (0 < w < 65536 and 0 < h < 65536 and 1 <= c <= 4 and 1 <= quality <= 100):
        raise BadImage("samples or quality to encode")
    halved = quality <= 90 if chroma == "auto" else chroma == "420"
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS)]
    # Scale factors of the transform's outputs.
    factor = np.array([1.0, 1.387039845, 1.306562965, 1.175875602, 1.0, 0.785694958, 0.541196100, 0.275899379], dtype=_F) * _F(2.828427125)
    divisors = [_F(1) / ((t.astype(_F) * np.repeat(factor, 8)) * np.tile(factor, 8)) for t in steps]
    unit = 16 if halved else 8
    padded = np.pad(samples, ((0, -h % unit), (0, -w % unit), (0, 0)), mode="edge").astype(_F)
    r, g, b = (padded[..., i] for i in ((0, 1, 2) if c > 2 else (0, 0, 0)))
    y = _F(0.299) * r + _F(0.587) * g + _F(0.114) * b - _F(128)
    u = _F(-0.16874) * r - _F(0.33126) * g + _F(0.5) * b
    v = _F(0.5) * r - _F(0.41869) * g - _F(0.08131) * b
    if halved:
        u, v = ((p[::2, ::2] + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2]) * _F(0.25) for p in (u, v))
    luma = _quantized(y, divisors[0])
    chromas = [_quantized(p, divisors[1]) for p in (u, v)]
    codes: list[tuple[int, int]] = []
    before = [0, 0, 0]
    span = 2 if halved else 1
    for my in range(chromas[0].shape[0]):
        for mx in range(chromas[0].shape[1]):
            units = [(0, luma[my * span + i, mx * span + j]) for i in range(span) for j in range(span)]
            units += [(k + 1, p[my, mx]) for k, p in enumerate(chromas)]
            for k, block in units:
                values = block.tolist()
                _block_codes(values, before[k], _DC[k > 0], _AC[k > 0], codes)
                before[k] = values[0]
    codes.append((0x7F, 7))
    text = "".join(f"{code:0{size}b}" for code, size in codes)
    n = len(text) // 8
    body = int(text[: 8 * n], 2).to_bytes(n, "big").replace(b"\xff", b"\xff\0")

    def segment(marker: int, payload: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload

    tables = b"".join(bytes([k]) + bytes(t[ZIGZAG].tolist()) for k, t in enumerate(steps))
    huffman = b"".join(bytes([k, *counts, *symbols]) for k, (counts, symbols) in ((0, DC_LUMA), (0x10, AC_LUMA), (1, DC_CHROMA), (0x11, AC_CHROMA)))
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22 if halved else 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, tables) + segment(0xC0, frame) + segment(0xC4, huffman)
    return head + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 0x3F, 0])) + body + b"\xff\xd9"


# ---------------------------------------------------------------- decoder


class Bits:
    """Bits of one entropy-coded stretch, highest first; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            part = self.data[self.at : self.at + 4]
            self.at += 4
            self.held = (self.held << 32) | int.from_bytes(part.ljust(4, b"\0"), "big")
            self.n += 32

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: np.ndarray) -> int:
        self.need(16)
        found = table[self.held >> (self.n - 16)]
        if found < 0:
            raise BadImage("code of no symbol")
        self.n -= found >> 8
        self.held &= (1 << self.n) - 1
        return found & 255

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def look_up_table(counts: list[int], symbols: list[int]) -> list[int]:
    """Size and symbol for each 16 bits ahead, -1 where no code fits."""
    out = np.full(1 << 16, -1, dtype=np.int32)
    for s, (code, size) in code_table(counts, symbols).items():
        out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | s
    return out.tolist()


@dataclass
class Component:
    name: int
    h: int
    v: int
    steps: int
    coefficients: np.ndarray | None = None
    width: int = 0  # in blocks that hold pixels
    height: int = 0
    before: int = 0


@dataclass
class Jpeg:
    width: int = 0
    height: int = 0
    progressive: bool = False
    components: list[Component] = field(default_factory=list)
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    dc: dict[int, list[int]] = field(default_factory=dict)
    ac: dict[int, list[int]] = field(default_factory=dict)
    restart: int = 0
    adobe: int = -1
    jfif: bool = False

    @property
    def h_max(self) -> int:
        return max(c.h for c in self.components)

    @property
    def v_max(self) -> int:
        return max(c.v for c in self.components)


def parse(data: bytes, headers_only: bool = False) -> Jpeg:
    """Headers and, unless only they are wanted, all coefficients. A broken end keeps what came before it."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    j, at = Jpeg(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0, 0xFF):
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise BadImage("segment runs past the end")
        at += 2 + n
        if marker in (0xC0, 0xC1, 0xC2):
            _frame(j, marker, body)
            if headers_only:
                return j
        elif marker in (0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise BadImage("process that is not read")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                j.steps[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                symbols = list(body[17 : 17 + sum(counts)])
                (j.ac if body[0] >> 4 else j.dc)[body[0] & 15] = look_up_table(counts, symbols)
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (j.restart,) = struct.unpack(">H", body)
        elif marker == 0xE0:
            j.jfif = j.jfif or body.startswith(b"JFIF\0")
        elif marker == 0xEE and body.startswith(b"Adobe") and len(body) >= 12:
            j.adobe = body[11]
        elif marker == 0xDA:
            if not j.components:
                raise BadImage("scan before the frame")
            at = _scan(j, body, data, at)
    if not j.components:
        raise BadImage("no frame")
    return j


def _frame(j: Jpeg, marker: int, body: bytes) -> None:
    depth, j.height, j.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not j.height or not j.width or n not in (1, 3, 4) or len(body) != 6 + 3 * n:
        raise BadImage("frame header")
    j.progressive = marker == 0xC2
    j.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
    if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in j.components):
        raise BadImage("sampling factors")
    mx, my = -(-j.width // (8 * j.h_max)), -(-j.height // (8 * j.v_max))
    for c in j.components:
        c.coefficients = np.zeros((my * c.v, mx * c.h, 64), dtype=np.int32)
        c.width = -(-(-(-j.width * c.h // j.h_max)) // 8)
        c.height = -(-(-(-j.height * c.v // j.v_max)) // 8)


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data cut at restart markers, and where the next marker is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            at += 2
            start = at
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]], at


def _scan(j: Jpeg, body: bytes, data: bytes, at: int) -> int:
    n = body[0]
    chosen = []
    for i in range(n):
        name, tables = body[1 + 2 * i], body[2 + 2 * i]
        c = next((c for c in j.components if c.name == name), None)
        if c is None:
            raise BadImage("scan of no component")
        chosen.append((c, tables >> 4, tables & 15))
    first, last, approx = body[1 + 2 * n : 4 + 2 * n]
    if not j.progressive:
        first, last, approx = 0, 63, 0
    high, low = approx >> 4, approx & 15
    if n == 1:
        c = chosen[0][0]
        units = [[(*chosen[0], y, x)] for y in range(c.height) for x in range(c.width)]
    else:
        mx, my = -(-j.width // (8 * j.h_max)), -(-j.height // (8 * j.v_max))
        units = [[(c, d, a, y * c.v + v, x * c.h + h) for c, d, a in chosen for v in range(c.v) for h in range(c.h)] for y in range(my) for x in range(mx)]
    parts, end = _stretches(data, at)
    step = j.restart or len(units)
    for k, part in enumerate(parts):
        bits, state = Bits(part), [0]
        for c, _, _ in chosen:
            c.before = 0
        try:
            for unit in units[k * step : (k + 1) * step]:
                for c, d, a, y, x in unit:
                    block = c.coefficients[y, x]
                    if not j.progressive:
                        _baseline(bits, c, block, j.dc[d], j.ac[a])
                    elif first == 0:
                        _dc_part(bits, c, block, j.dc.get(d), high, low)
                    else:
                        _ac_part(bits, block, j.ac[a], first, last, high, low, state)
        except (BadImage, KeyError):
            if k == len(parts) - 1 and len(parts) == 1 and not any(c.coefficients.any() for c, _, _ in chosen):
                raise BadImage("scan without data") from None
    return end


def _baseline(bits: Bits, c: Component, block: np.ndarray, dc: list[int], ac: list[int]) -> None:
    c.before += bits.signed(bits.symbol(dc))
    block[0] = c.before
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run < 15:
                return
            k += 16
            continue
        k += run
        if k > 63:
            raise BadImage("coefficient beyond the block")
        block[ZIGZAG[k]] = bits.signed(size)
        k += 1


def _dc_part(bits: Bits, c: Component, block: np.ndarray, dc: list[int] | None, high: int, low: int) -> None:
    if high:
        block[0] |= bits.take(1) << low
    else:
        c.before += bits.signed(bits.symbol(dc))
        block[0] = c.before << low


def _ac_part(bits: Bits, block: np.ndarray, ac: list[int], first: int, last: int, high: int, low: int, state: list[int]) -> None:
    """One block of a progressive scan; ``state`` holds how many blocks more end at once."""
    k, bit = first, 1 << low
    if not high:
        if state[0]:
            state[0] -= 1
            return
        while k <= last:
            s = bits.symbol(ac)
            run, size = s >> 4, s & 15
            if size:
                k += run
                block[ZIGZAG[min(k, 63)]] = bits.signed(size) * bit
                k += 1
            elif run == 15:
                k += 16
            else:
                state[0] = (1 << run) - 1 + bits.take(run)
                return
        return

    def refine(at: int) -> None:
        if bits.take(1) and not abs(block[at]) & bit:
            block[at] += bit if block[at] > 0 else -bit

    if not state[0]:
        while k <= last:
            s = bits.symbol(ac)
            run, size = s >> 4, s & 15
            value = 0
            if size:
                value = bit if bits.take(1) else -bit
            elif run < 15:
                state[0] = (1 << run) + bits.take(run)
                break
            while k <= last:
                at = ZIGZAG[k]
                k += 1
                if block[at]:
                    refine(at)
                elif run:
                    run -= 1
                else:
                    block[at] = value
                    break
    if state[0]:
        state[0] -= 1
        for i in range(k, last + 1):
            if block[ZIGZAG[i]]:
                refine(ZIGZAG[i])


def _fixed(x: float) -> int:
    return int(x * 4096 + 0.5)


def _idct_pass(s: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Even and odd sums of the integer transform, 12 bits up."""
    # The rotations in 12-bit fixed point.
    m = (s[2] + s[6]) * _fixed(0.5411961)
    e2, e3 = m + s[6] * _fixed(-1.847759065), m + s[2] * _fixed(0.765366865)
    e0, e1 = (s[0] + s[4]) * 4096, (s[0] - s[4]) * 4096
    even = [e0 + e3, e1 + e2, e1 - e2, e0 - e3]
    p3, p4, p1, p2 = s[7] + s[3], s[5] + s[1], s[7] + s[1], s[5] + s[3]
    p5 = (p3 + p4) * _fixed(1.175875602)
    p1, p2 = p5 + p1 * _fixed(-0.899976223), p5 + p2 * _fixed(-2.562915447)
    p3, p4 = p3 * _fixed(-1.961570560), p4 * _fixed(-0.390180644)
    odd = [s[1] * _fixed(1.501321110) + p1 + p4, s[3] * _fixed(3.072711026) + p2 + p3, s[5] * _fixed(2.053119869) + p2 + p4, s[7] * _fixed(0.298631336) + p1 + p3]
    return even, odd


def inverse_blocks(c: np.ndarray) -> np.ndarray:
    """Samples of blocks of dequantised coefficients (..., 8, 8), level-shifted and clamped."""
    c = c.astype(np.int64)
    even, odd = _idct_pass([c[..., i, :] for i in range(8)])
    even = [e + 512 for e in even]
    rows = np.stack([(even[i] + odd[i]) >> 10 for i in range(4)] + [(even[i] - odd[i]) >> 10 for i in (3, 2, 1, 0)], axis=-2)
    even, odd = _idct_pass([rows[..., i] for i in range(8)])
    even = [e + 65536 + (128 << 17) for e in even]
    out = np.stack([(even[i] + odd[i]) >> 17 for i in range(4)] + [(even[i] - odd[i]) >> 17 for i in (3, 2, 1, 0)], axis=-1)
    return np.clip(out, 0, 255).astype(np.uint8)


def reduced_blocks(c: np.ndarray, size: int) -> np.ndarray:
    """``size`` by ``size`` samples from the lowest coefficients of each block."""
    if size == 1:
        return np.clip(np.floor(c[..., :1, :1].astype(_F) * _F(0.125) + _F(128.5)), 0, 255).astype(np.uint8)
    u, p = np.mgrid[:size, :size]
    basis = (np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * p + 1) * u * np.pi / (2 * size))).astype(_F)
    out = np.einsum("up,...uv,vq->...pq", basis, c[..., :size, :size].astype(_F), basis)
    return np.clip(np.floor(out + _F(128.5)), 0, 255).astype(np.uint8)


def _upsampled(plane: np.ndarray, hs: int, vs: int, width: int, height: int) -> np.ndarray:
    """A component at full size: triangle weights for factors of two, else the nearest sample."""
    p = plane.astype(np.int32)
    if (hs, vs) == (1, 1):
        return plane[:height, :width]
    if vs == 2 and hs in (1, 2):
        y = np.arange(height)
        near, far = y // 2, np.clip(np.where(y % 2, y // 2 + 1, y // 2 - 1), 0, len(p) - 1)
        mixed = 3 * p[near] + p[far]
        if hs == 1:
            return ((mixed + 2) >> 2).astype(np.uint8)[:, :width]
        out = np.empty((height, 2 * p.shape[1]), dtype=np.int32)
        out[:, 0], out[:, -1] = (mixed[:, 0] + 2) >> 2, (mixed[:, -1] + 2) >> 2
        out[:, 1:-1:2] = (3 * mixed[:, :-1] + mixed[:, 1:] + 8) >> 4
        out[:, 2::2] = (3 * mixed[:, 1:] + mixed[:, :-1] + 8) >> 4
        return out[:, :width].astype(np.uint8)
    if (hs, vs) == (2, 1):
        out = np.empty((len(p), 2 * p.shape[1]), dtype=np.int32)
        out[:, 0], out[:, -1] = p[:, 0], p[:, -1]
        out[:, 1:-1:2] = (3 * p[:, :-1] + p[:, 1:] + 2) >> 2
        out[:, 2::2] = (3 * p[:, 1:] + p[:, :-1] + 2) >> 2
        return out[:height, :width].astype(np.uint8)
    return np.repeat(np.repeat(plane, vs, axis=0), hs, axis=1)[:height, :width]


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    base, u, v = (y.astype(np.int64) << 20) + (1 << 19), cb.astype(np.int64) - 128, cr.astype(np.int64) - 128
    red, green_v, green_u, blue = (int(k * 4096 + 0.5) << 8 for k in (1.402, 0.71414, 0.34414, 1.772))
    planes = [base + v * red, base - v * green_v + ((u * -green_u) & -65536), base + u * blue]
    return np.stack([np.clip(p >> 20, 0, 255) for p in planes], axis=-1).astype(np.uint8)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a.astype(np.int32) * b + 128
    return ((t + (t >> 8)) >> 8).astype(np.uint8)


def decode(data: bytes, scale: int = 1) -> np.ndarray:
    """RGBA pixels at full size or 1/2, 1/4 or 1/8 of it, rounded up."""
    j = parse(data)
    size = 8 // scale
    width, height = -(-j.width // scale), -(-j.height // scale)
    planes = []
    for c in j.components:
        natural = np.zeros(64, dtype=np.int64)
        natural[ZIGZAG] = j.steps[c.steps]
        blocks = (c.coefficients * natural).reshape(*c.coefficients.shape[:2], 8, 8)
        tiles = inverse_blocks(blocks) if size == 8 else reduced_blocks(blocks, size)
        plane = tiles.swapaxes(1, 2).reshape(tiles.shape[0] * size, tiles.shape[1] * size)
        hs, vs = j.h_max // c.h, j.v_max // c.v
        rows = -(-height * c.v // j.v_max)
        planes.append(_upsampled(plane[:rows, : -(-width // hs)], hs, vs, width, height))
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    names = [c.name for c in j.components]
    if len(planes) == 1:
        out[..., :3] = planes[0][..., None]
    elif len(planes) == 3 and (names == [82, 71, 66] or (j.adobe == 0 and not j.jfif)):
        out[..., :3] = np.stack(planes, axis=-1)
    elif len(planes) == 4 and j.adobe == 0:
        out[..., :3] = np.stack([_product(p, planes[3]) for p in planes[:3]], axis=-1)
    else:
        rgb = _rgb(*planes[:3])
        out[..., :3] = _product(255 - rgb, planes[3][..., None]) if len(planes) == 4 and j.adobe == 2 else rgb
    return out


def info(data: bytes) -> tuple[int, int, int, bool, bool]:
    """Width, height, components, whether progressive and whether the chroma is halved."""
    j = parse(data, headers_only=True)
    return j.width, j.height, len(j.components), j.progressive, any((c.h, c.v) != (j.h_max, j.v_max) for c in j.components)


def raster(data: bytes) -> Raster:
    icc = b"".join(s.payload[14:] for s in segments(data) if s.marker == 0xE2 and s.payload.startswith(b"ICC_PROFILE\0"))
    return Raster(decode(data), Color(), icc or None)
