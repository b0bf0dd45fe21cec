"""JPEG XL: the container, the headers in front of the image, bit fields and the self-correcting predictor."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .raster import BadImage

CODESTREAM, CONTAINER = b"\xff\x0a", b"\0\0\0\x0cJXL \r\n\x87\n"
# Aspect ratios that a size header can name.
RATIOS = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}


def boxes(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """Type, place and body of each box of a container; a box without a size runs to the end."""
    at = 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > len(data):
                break
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        end = at + size if size and at < at + size <= len(data) else len(data)
        yield kind.decode("latin-1"), at, data[at + head : end]
        at = end


def codestream(data: bytes) -> bytes:
    """The codestream itself or the parts of it in a container, in the order of the file."""
    if data.startswith(CODESTREAM):
        return data
    if not data.startswith(CONTAINER):
        raise BadImage("no JPEG XL signature")
    out = b"".join(body if kind == "jxlc" else body[4:] for kind, _, body in boxes(data) if kind in ("jxlc", "jxlp"))
    if not out:
        raise BadImage("no codestream in the container")
    return out


class LowBits:
    """Bit fields, lowest bit first; zeros follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        at = self.at
        self.at = end = at + n
        return int.from_bytes(self.data[at >> 3 : end + 7 >> 3], "little") >> (at & 7) & (1 << n) - 1

    def choice(self, *options: tuple[int, int]) -> int:
        """One of four ``(offset, bits)`` by two bits."""
        offset, n = options[self.take(2)]
        return offset + self.take(n)

    def named(self) -> int:
        return self.choice((0, 0), (1, 0), (2, 4), (18, 6))

    def long(self) -> int:
        """A number of up to 64 bits in groups."""
        kind = self.take(2)
        if kind < 3:
            return (0, 1, 17)[kind] + self.take((0, 4, 8)[kind])
        out, shift = self.take(12), 12
        while self.take(1):
            if shift >= 60:
                return out | self.take(4) << shift
            out |= self.take(8) << shift
            shift += 8
        return out

    def align(self) -> None:
        self.at += -self.at % 8


@dataclass
class LowBitsWriter:
    done: bytearray = field(default_factory=bytearray)
    value: int = 0
    n: int = 0

    def put(self, value: int, bits: int) -> None:
        self.value |= (value & (1 << bits) - 1) << self.n
        self.n += bits
        if self.n >= 512:
            whole = self.n // 8
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def choose(self, value: int, *options: tuple[int, int]) -> None:
        """``value`` by the first of four ``(offset, bits)`` that holds it."""
        for k, (offset, bits) in enumerate(options):
            if offset <= value < offset + (1 << bits):
                self.put(k, 2)
                self.put(value - offset, bits)
                return
        raise BadImage("no option holds this value")

    def align(self) -> None:
        self.n += -self.n % 8

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes(-(-self.n // 8), "little")


def size(data: bytes) -> tuple[int, int]:
    """Width and height from the size header."""
    bits = LowBits(codestream(data)[2:])
    eights = bits.take(1)
    one = lambda: 8 * (1 + bits.take(5)) if eights else 1 + bits.choice((0, 9), (0, 13), (0, 18), (0, 30))
    height = one()
    ratio = bits.take(3)
    return (height * RATIOS[ratio][0] // RATIOS[ratio][1] if ratio else one()), height


@dataclass
class Weights:
    """Defaults of the predictor's header."""

    p1: int = 16
    p2: int = 10
    p3: tuple[int, ...] = (7, 7, 7, 0, 0)
    w: tuple[int, ...] = (13, 12, 12, 12)


@dataclass
class SelfCorrecting:
    """Blend of four predictions by how well each has done nearby; values are in eighths.

    Samples are visited in raster order: ``predict`` and then ``record`` for each.
    """

    width: int
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self) -> None:
        self.x = self.y = 0
        self.errors = [0] * self.width  # of the row above, replaced as this row goes on
        self.sub_errors = [(0, 0, 0, 0)] * self.width
        self.w = self.nw = self.n = self.ne = 0
        self.sub_w, self.sub_n, self.sub_ne = (0,) * 4, (0,) * 4, (0,) * 4

    def predict(self, n: int, nw: int, ne: int, w: int, nn: int) -> int:
        n, nw, ne, w, nn = (8 * v for v in (n, nw, ne, w, nn))
        p, a = self.weights, self.weights.p3
        self.subs = (
            w + ne - n,
            n - ((self.w + self.n + self.ne) * p.p1 >> 5),
            w - ((self.w + self.n + self.nw) * p.p2 >> 5),
            n - (self.nw * a[0] + self.n * a[1] + self.ne * a[2] + (nn - n) * a[3] + (nw - w) * a[4] >> 5),
        )
        shares = []
        for i in range(4):
            e = self.sub_w[i] + self.sub_n[i] + self.sub_ne[i] & 0xFFFFFFFF
            shift = max(0, (e + 1 >> 5).bit_length() - 1)
            shares.append(4 + (p.w[i] * ((1 << 24) // ((e >> shift) + 1)) >> shift))
        down = max(0, (sum(shares) >> 4).bit_length() - 1)
        shares = [s >> down for s in shares]
        total = sum(shares)
        out = ((total >> 1) - 1 + sum(s * v for s, v in zip(shares, self.subs, strict=True))) * ((1 << 24) // total) >> 24
        if (self.n ^ self.w) | (self.n ^ self.nw) <= 0:
            out = min(max(out, min(n, w, ne)), max(n, w, ne))
        self.value = out
        return out

    def worst_error(self) -> int:
        return max((self.w, self.n, self.nw, self.ne), key=abs)

    def record(self, sample: int) -> None:
        error = self.value - 8 * sample
        sub = tuple(abs(s - 8 * sample) + 3 >> 3 for s in self.subs)
        self.errors[self.x], self.sub_errors[self.x] = error, sub
        self.x += 1
        if self.x == self.width:
            self.x, self.y = 0, self.y + 1
            self.w, self.n = 0, self.errors[0]
            self.nw = self.n
            self.sub_n = self.sub_w = self.sub_errors[0]
            self.ne, self.sub_ne = (self.errors[1], self.sub_errors[1]) if self.width > 1 else (self.n, self.sub_n)
            return
        self.w, self.nw, self.n = error, self.n, self.ne
        self.sub_w, self.sub_n = self.sub_n, tuple(a + b & 0xFFFFFFFF for a, b in zip(self.sub_ne, sub, strict=True))
        if self.x + 1 >= self.width:
            self.ne, self.sub_ne = self.n, self.sub_n
        elif self.y:
            self.ne, self.sub_ne = self.errors[self.x + 1], self.sub_errors[self.x + 1]


def _around(v: np.ndarray, y: int, x: int) -> tuple[int, int, int, int, int]:
    """North, north-west, north-east, west and two north, with the borders' stand-ins."""
    west, north = (int(v[y, x - 1]) if x else None), (int(v[y - 1, x]) if y else None)
    n = north if y else west or 0
    w = west if x else north or 0
    nw = int(v[y - 1, x - 1]) if x and y else (north if y else west or 0)
    ne = int(v[y - 1, x + 1]) if y and x + 1 < v.shape[1] else n
    return n, nw, ne, w, int(v[y - 2, x]) if y > 1 else 0


def residuals(samples: np.ndarray) -> np.ndarray:
    """Samples less their self-correcting predictions."""
    out, p = np.zeros_like(samples, dtype=np.int64), SelfCorrecting(samples.shape[1])
    for y in range(samples.shape[0]):
        for x in range(samples.shape[1]):
            out[y, x] = samples[y, x] - (p.predict(*_around(samples, y, x)) + 3 >> 3)
            p.record(int(samples[y, x]))
    return out


def restored(differences: np.ndarray) -> np.ndarray:
    out, p = np.zeros_like(differences, dtype=np.int64), SelfCorrecting(differences.shape[1])
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            out[y, x] = differences[y, x] + (p.predict(*_around(out, y, x)) + 3 >> 3)
            p.record(int(out[y, x]))
    return out


def container(stream: bytes, parts: int = 1) -> bytes:
    """A container around a codestream, whole or in numbered parts."""
    out = CONTAINER + struct.pack(">I4s4sI4s", 20, b"ftyp", b"jxl ", 0, b"jxl ")
    if parts == 1:
        return out + struct.pack(">I4s", 8 + len(stream), b"jxlc") + stream
    step = -(-len(stream) // parts)
    for i in range(parts):
        body = struct.pack(">I", i | (0x80000000 if i == parts - 1 else 0)) + stream[i * step : (i + 1) * step]
        out += struct.pack(">I4s", 8 + len(body), b"jxlp") + body
    return out
