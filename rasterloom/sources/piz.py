"""The wavelet block compression of OpenEXR: used values renumbered, a 2-D wavelet, and Huffman codes with runs."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from .raster import BadImage

SYMBOLS = (1 << 16) + 1
LOOK = 14
# Table entries that stand for runs of unused symbols.
SHORT_RUN, LONG_RUN = 59, 63
LONGEST, LONG_FROM = 255 + 6, 6


def _pair(a: np.ndarray, b: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and difference of 16-bit values; ``narrow`` where no difference needs more than 15 bits."""
    if narrow:
        a, b = a.astype(np.int16).astype(np.int32), b.astype(np.int16).astype(np.int32)
        return ((a + b) >> 1) & 0xFFFF, (a - b) & 0xFFFF
    a = (a + 0x8000) & 0xFFFF
    m, d = (a + b) >> 1, a - b
    return np.where(d < 0, (m + 0x8000) & 0xFFFF, m), d & 0xFFFF


def _unpair(m: np.ndarray, d: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    if narrow:
        m, d = m.astype(np.int16).astype(np.int32), d.astype(np.int16).astype(np.int32)
        a = m + (d & 1) + (d >> 1)
        return a & 0xFFFF, (a - d) & 0xFFFF
    b = (m - (d >> 1)) & 0xFFFF
    return (d + b - 0x8000) & 0xFFFF, b


def _levels(h: int, w: int) -> list[int]:
    out, step = [], 1
    while 2 * step <= min(h, w):
        out.append(step)
        step *= 2
    return out


def wavelet(plane: np.ndarray, top: int, inverse: bool = False) -> np.ndarray:
    """Transform of a plane of 16-bit values up to ``top``. Each level pairs what the one before left at even places."""
    v = plane.astype(np.int32)
    h, w = v.shape
    narrow = top < 1 << 14
    steps = _levels(h, w)
    for p in reversed(steps) if inverse else steps:
        ys, xs = (h - 2 * p) // (2 * p) + 1, (w - 2 * p) // (2 * p) + 1
        rows, columns = slice(0, ys * 2 * p, 2 * p), slice(0, xs * 2 * p, 2 * p)
        low_rows, low_columns = slice(p, ys * 2 * p, 2 * p), slice(p, xs * 2 * p, 2 * p)
        work = _unpair if inverse else _pair
        if w & p:  # a column without a partner is paired downwards only
            x = xs * 2 * p
            v[rows, x], v[low_rows, x] = work(v[rows, x], v[low_rows, x], narrow)
        if h & p:
            y = ys * 2 * p
            v[y, columns], v[y, low_columns] = work(v[y, columns], v[y, low_columns], narrow)
        a, b, c, d = (v[r, s] for r, s in ((rows, columns), (rows, low_columns), (low_rows, columns), (low_rows, low_columns)))
        if inverse:
            left, right = _unpair(a, c, narrow), _unpair(b, d, narrow)
            top_pair, low_pair = _unpair(left[0], right[0], narrow), _unpair(left[1], right[1], narrow)
            v[rows, columns], v[rows, low_columns], v[low_rows, columns], v[low_rows, low_columns] = *top_pair, *low_pair
        else:
            top_pair, low_pair = _pair(a, b, narrow), _pair(c, d, narrow)
            left, right = _pair(top_pair[0], low_pair[0], narrow), _pair(top_pair[1], low_pair[1], narrow)
            v[rows, columns], v[low_rows, columns], v[rows, low_columns], v[low_rows, low_columns] = *left, *right
    return v.astype(np.uint16)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; of equal counts the lower symbol goes first."""
    heap = [(n, s, [s]) for s, n in counts.items()]
    heapq.heapify(heap)
    out = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        n1, _, low = heapq.heappop(heap)
        n2, s, high = heapq.heappop(heap)
        for m in (low, high):
            for x in m:
                out[x] += 1
        heapq.heappush(heap, (n1 + n2, s, high + low))
    return out


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """``(code, bits)`` of each symbol, codes given from the longest to the shortest and then by symbol."""
    by_size: dict[int, list[int]] = {}
    for s in sorted(lengths):
        by_size.setdefault(lengths[s], []).append(s)
    out, code = {}, 0
    for size in range(58, 0, -1):
        for k, s in enumerate(by_size.get(size, ())):
            out[s] = (code + k, size)
        code = (code + len(by_size.get(size, ()))) >> 1
    return out


def _bytes(text: str) -> bytes:
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def huffman_pack(values: np.ndarray) -> bytes:
    """Table and codes of 16-bit values; a symbol beyond the largest marks runs."""
    if not len(values):
        return bytes(20)
    symbols, counts = np.unique(values, return_counts=True)
    first, run = int(symbols[0]), int(symbols[-1]) + 1
    codes = canonical(code_lengths(dict(zip(symbols.tolist(), counts.tolist(), strict=True)) | {run: 1}))
    table, s = [], first
    while s <= run:
        if s in codes:
            table.append(f"{codes[s][1]:06b}")
            s += 1
            continue
        gap = 1
        while s + gap not in codes and gap < LONGEST:
            gap += 1
        if gap >= LONG_FROM:
            table.append(f"{LONG_RUN:06b}{gap - LONG_FROM:08b}")
        else:
            table.append(f"{SHORT_RUN + gap - 2:06b}" if gap > 1 else "000000")
        s += gap
    written = {s: f"{c:0{n}b}" for s, (c, n) in codes.items()}
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        own = written[int(values[a])]
        while a < z:
            n = min(z - a, 256)
            a += n
            shorter = len(own) + len(written[run]) + 8 < len(own) * (n - 1)
            out.append(own + written[run] + f"{n - 1:08b}" if shorter else own * n)
    body = "".join(out)
    packed = _bytes("".join(table))
    return struct.pack("<5I", first, run, len(packed), len(body), 0) + packed + _bytes(body)


def huffman_unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint16)
    if len(data) < 20:
        raise BadImage("short Huffman block")
    first, run, _, bits, _ = struct.unpack_from("<5I", data)
    if run >= SYMBOLS or first > run:
        raise BadImage("Huffman header")
    text = f"{int.from_bytes(data[20:], 'big'):0{8 * (len(data) - 20)}b}" if len(data) > 20 else ""
    at, s, lengths = 0, first, {}
    while s <= run:
        size = int(text[at : at + 6], 2)
        at += 6
        if size == LONG_RUN:
            s += int(text[at : at + 8], 2) + LONG_FROM
            at += 8
        elif size >= SHORT_RUN:
            s += size - SHORT_RUN + 2
        else:
            if size:
                lengths[s] = size
            s += 1
    at += -at % 8
    codes = {f"{c:0{k}b}": s for s, (c, k) in canonical(lengths).items()}
    sizes = sorted({len(c) for c in codes})
    out, end = [], at + bits
    while at < end:
        for k in sizes:
            if (s := codes.get(text[at : at + k])) is not None:
                at += k
                break
        else:
            raise BadImage("code of no symbol")
        if s == run:
            out += out[-1:] * int(text[at : at + 8], 2)
            at += 8
        else:
            out.append(s)
    if len(out) != n:
        raise BadImage("number of coded values")
    return np.array(out, dtype=np.uint16)


def _planes(words: np.ndarray, shapes: list[tuple[int, int]], lines: int):
    """Views of the 16-bit planes of channel-major words; ``shapes`` are samples a line and words a sample."""
    at = 0
    for width, per in shapes:
        n = width * per * lines
        block = words[at : at + n].reshape(lines, width, per)
        for k in range(per):
            yield block[:, :, k]
        at += n


def _channel_major(words: np.ndarray, shapes: list[tuple[int, int]], lines: int) -> np.ndarray:
    rows = words.reshape(lines, -1)
    cuts = np.cumsum([0, *(w * p for w, p in shapes)])
    return np.concatenate([rows[:, a:z].reshape(-1) for a, z in zip(cuts, cuts[1:], strict=False)])


def _line_major(words: np.ndarray, shapes: list[tuple[int, int]], lines: int) -> np.ndarray:
    cuts = np.cumsum([0, *(w * p * lines for w, p in shapes)])
    return np.concatenate([words[a:z].reshape(lines, -1) for a, z in zip(cuts, cuts[1:], strict=False)], axis=1).reshape(-1)


def pack(raw: bytes, shapes: list[tuple[int, int]], lines: int) -> bytes:
    words = _channel_major(np.frombuffer(raw, "<u2"), shapes, lines).copy()
    used = np.zeros(1 << 16, dtype=bool)
    used[words] = True
    used[0] = False  # zero is always in use and not listed
    bitmap = np.packbits(used, bitorder="little")
    filled = np.flatnonzero(bitmap)
    low, high = (int(filled[0]), int(filled[-1])) if len(filled) else (8191, 0)
    used[0] = True
    rank = np.cumsum(used) - 1
    words = rank[words].astype(np.uint16)
    for plane in _planes(words, shapes, lines):
        plane[:] = wavelet(plane, int(rank[-1]))
    coded = huffman_pack(words)
    return struct.pack("<2H", low, high) + (bitmap[low : high + 1].tobytes() if low <= high else b"") + struct.pack("<I", len(coded)) + coded


def unpack(data: bytes, size: int, shapes: list[tuple[int, int]], lines: int) -> bytes:
    low, high = struct.unpack_from("<2H", data)
    if high >= 8192:
        raise BadImage("range of the bitmap")
    bitmap, at = np.zeros(8192, np.uint8), 4
    if low <= high:
        bitmap[low : high + 1] = np.frombuffer(data, np.uint8, high - low + 1, at)
        at += high - low + 1
    used = np.unpackbits(bitmap, bitorder="little").astype(bool)
    used[0] = True
    values = np.flatnonzero(used).astype(np.uint16)
    (n,) = struct.unpack_from("<I", data, at)
    words = huffman_unpack(data[at + 4 : at + 4 + n], size // 2).copy()
    for plane in _planes(words, shapes, lines):
        plane[:] = wavelet(plane, len(values) - 1, inverse=True)
    if words.max(initial=0) >= len(values):
        raise BadImage("value without a number")
    return _line_major(values[words], shapes, lines).astype("<u2").tobytes()
