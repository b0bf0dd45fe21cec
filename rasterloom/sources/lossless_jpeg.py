"""Lossless JPEG: interleaved samples of up to 16 bits, each from its neighbours and a coded difference."""

from __future__ import annotations

import struct

import numpy as np

from .jpeg import Bits, _stretches, look_up_table
from .raster import BadImage


def _difference(bits: Bits, table: list[int]) -> int:
    size = bits.symbol(table)
    if size > 16:
        raise BadImage("size of a difference")
    return 32768 if size == 16 else bits.signed(size)


def _predict(kind: int, a: int, b: int, c: int) -> int:
    """From the left, the upper and the upper left sample."""
    return (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[kind]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (height, width, components) as 16-bit integers, and their precision."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    at, tables, frame, restart = 2, {}, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadImage("marker expected")
        marker = data[at + 1]
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC3:
            precision, h, w, k = struct.unpack_from(">BHHB", body)
            if not 2 <= precision <= 16 or not h or not w or not k:
                raise BadImage("frame header")
            if any(body[i + 1] != 0x11 for i in range(6, 6 + 3 * k, 3)):
                raise BadImage("sampling factors")
            frame = [body[i] for i in range(6, 6 + 3 * k, 3)]
        elif marker in (0xC0, 0xC1, 0xC2):
            raise BadImage("not lossless")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = look_up_table(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if frame is None:
                raise BadImage("scan before the frame")
            n = body[0]
            chosen = [(frame.index(body[1 + 2 * i]), tables[body[2 + 2 * i] >> 4]) for i in range(n)]
            kind, shift = body[1 + 2 * n], body[3 + 2 * n] & 15
            if not 1 <= kind <= 7:
                raise BadImage("predictor")
            return _scan(data, at, chosen, kind, shift, restart, np.zeros((h, w, len(frame)), np.uint16), precision), precision
    raise BadImage("no scan")


def _scan(data: bytes, at: int, chosen: list, kind: int, shift: int, restart: int, out: np.ndarray, precision: int) -> np.ndarray:
    h, w, _ = out.shape
    parts, _ = _stretches(data, at)
    mask, start = (1 << precision) - 1, 1 << (precision - shift - 1)
    above = [[0] * w for _ in chosen]
    parts = iter(parts)
    bits, left = Bits(next(parts)), restart
    fresh = [True] * len(chosen)
    for y in range(h):
        a = [0] * len(chosen)
        corner = [0] * len(chosen)
        for x in range(w):
            for i, (component, table) in enumerate(chosen):
                b = above[i][x]
                if fresh[i]:
                    p, fresh[i] = start, False
                elif not x:
                    p = b
                elif not y:
                    p = a[i]
                else:
                    p = _predict(kind, a[i], b, corner[i])
                v = (p + _difference(bits, table)) & mask
                out[y, x, component] = v << shift
                a[i], corner[i], above[i][x] = v, b, v
            left -= 1
            if restart and not left and (y, x) != (h - 1, w - 1):
                bits, left = Bits(next(parts, b"")), restart
                fresh = [True] * len(chosen)
    return out


def encode(samples: np.ndarray, precision: int, kind: int = 1, restart: int = 0) -> bytes:
    """A file of one interleaved scan; its Huffman codes have five bits each."""
    h, w, n = samples.shape
    v = samples.astype(np.int64)
    counts, symbols = [0] * 16, list(range(17))
    counts[4] = 17
    codes, stretches = [], []
    fresh = [True] * n
    for y in range(h):
        for x in range(w):
            for c in range(n):
                a, b, d = (v[y, x - 1, c] if x else 0), (v[y - 1, x, c] if y else 0), (v[y - 1, x - 1, c] if x and y else 0)
                p = 1 << (precision - 1) if fresh[c] else b if not x else a if not y else _predict(kind, int(a), int(b), int(d))
                fresh[c] = False
                e = int(v[y, x, c] - p) & 0xFFFF
                e = e - 65536 if e > 32768 else e
                size = abs(e).bit_length() if e != 32768 else 16
                codes.append(f"{size:05b}" + (f"{e if e > 0 else e + (1 << size) - 1:0{size}b}" if 0 < size < 16 else ""))
            if restart and (y * w + x + 1) % restart == 0:
                stretches.append("".join(codes))
                codes, fresh = [], [True] * n
    if codes:
        stretches.append("".join(codes))

    def segment(marker: int, payload: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload

    body = b""
    for k, text in enumerate(stretches):
        text += "1" * (-len(text) % 8)
        body += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHB", precision, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    head = b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, bytes([0, *counts, *symbols]))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    return head + segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([kind, 0, 0])) + body + b"\xff\xd9"
