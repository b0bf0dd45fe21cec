"""TIFF: directories, pages in strips, and a writer with strips or tiles."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from . import jpeg, png
from .raster import BadImage, Color, Raster

# Bytes of a value by field type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMAT = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
# Tags read and written here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_COUNTS, PLANAR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, LOW, HIGH, ICC = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 322, 323, 324, 325, 339, 340, 341, 34675
DEFLATE = (8, 32946)


@dataclass
class Entry:
    kind: int
    count: int
    data: bytes

    def values(self, order: str) -> tuple:
        n = TYPE_SIZE[self.kind]
        if self.kind in (5, 10):
            flat = struct.unpack(f"{order}{2 * self.count}{'I' if self.kind == 5 else 'i'}", self.data)
            return tuple(zip(flat[::2], flat[1::2], strict=True))
        if self.kind == 2:
            return (self.data,)
        return struct.unpack(f"{order}{self.count}{_FORMAT[self.kind]}", self.data[: n * self.count])


def byte_order(data: bytes) -> str:
    if data[:4] == b"II*\0":
        return "<"
    if data[:4] == b"MM\0*":
        return ">"
    raise BadImage("no TIFF header")


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, Entry], int]:
    """Entries of a directory by tag and the next directory. Unknown types and values beyond the end are left out; of equal tags the last counts."""
    if at + 2 > len(data):
        raise BadImage("directory beyond the end")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    end = at + 2 + 12 * n
    if end + 4 > len(data):
        raise BadImage("truncated directory")
    out = {}
    for i in range(at + 2, end, 12):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, i)
        size = TYPE_SIZE.get(kind, 0) * count
        start = i + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, i + 8)[0]
        if kind in TYPE_SIZE and start + size <= len(data):
            out[tag] = Entry(kind, count, data[start : start + size])
    return out, struct.unpack_from(f"{order}I", data, end)[0]


def pages(data: bytes) -> list[Raster]:
    """Every page of the chain of directories."""
    order = byte_order(data)
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        entries, following = directory(data, at, order)
        out.append(_page(data, entries, order))
        at = following
    return out


def _page(data: bytes, entries: dict[int, Entry], order: str) -> Raster:
    def one(tag: int, default: int = 0) -> int:
        return int(entries[tag].values(order)[0]) if tag in entries else default

    w, h, channels, bits, kind = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(SAMPLE_FORMAT, 1)
    if w <= 0 or h <= 0 or STRIP_OFFSETS not in entries or one(PLANAR, 1) != 1:
        raise BadImage("page without size, strips or interleaved samples")
    code = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 16): "f2", (3, 32): "f4"}.get((kind, bits))
    if code is None:
        raise BadImage(f"{bits}-bit samples of kind {kind}")
    dtype = np.dtype(code).newbyteorder(order)
    rows = one(ROWS, h) or h
    body, row_bytes = bytearray(), w * channels * dtype.itemsize
    strips = zip(entries[STRIP_OFFSETS].values(order), entries[STRIP_COUNTS].values(order), strict=False)
    for i, (at, n) in enumerate(strips):
        strip = data[at : at + n]
        if one(COMPRESSION, 1) in DEFLATE:
            strip = zlib.decompress(strip)
        elif one(COMPRESSION, 1) != 1:
            raise BadImage("compression that is not read")
        want = row_bytes * min(rows, h - i * rows)
        if len(strip) < want:
            raise BadImage("short strip")
        body += strip[:want]
    if len(body) != h * row_bytes:
        raise BadImage("missing strips")
    samples = np.frombuffer(bytes(body), dtype).reshape(h, w, channels).astype(dtype.newbyteorder("="))
    icc = entries[ICC].data if ICC in entries else None
    return Raster(samples, Color(), icc)


def raster(data: bytes) -> Raster:
    """The first page as a display raster: gray or RGB, unsigned 8 or 16 bits or floats; halves are widened."""
    order = byte_order(data)
    entries, _ = directory(data, struct.unpack_from(f"{order}I", data, 4)[0], order)
    photometric = entries[PHOTOMETRIC].values(order)[0] if PHOTOMETRIC in entries else 1
    page = _page(data, entries, order)
    if photometric not in (1, 2) or page.samples.shape[2] > 4:
        raise BadImage("photometric kind or number of samples")
    if page.samples.dtype == np.float16:
        page.samples = page.samples.astype(np.float32)
    if page.samples.dtype not in (np.uint8, np.uint16, np.float32):
        raise BadImage("signed or 32-bit integer samples")
    if page.samples.dtype == np.float32:
        page.color.transfer, page.color.float_semantics = 8, "DisplayReferred"
    return page


def tile(samples: np.ndarray, ty: int, tx: int, height: int, width: int) -> np.ndarray:
    """One tile, zero beyond the edges."""
    out = np.zeros((height, width, samples.shape[2]), dtype=samples.dtype)
    part = samples[ty * height : (ty + 1) * height, tx * width : (tx + 1) * width]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def png_page(data: bytes) -> np.ndarray:
    """Samples of an 8-bit gray, RGB or RGBA PNG, to be packed anew as a page."""
    p = png.read(data)
    if p.depth != 8 or p.color_type not in (0, 2, 6):
        raise BadImage("PNG layout of a page")
    return p.samples


def write(images: list[np.ndarray | bytes], *, compress: bool = True, rows_per_strip: int = 64, tile_size: tuple[int, int] | None = None, icc: bytes | None = None) -> bytes:
    """Pages in little-endian order, each in strips or, with ``tile_size`` (height, width), in tiles. Bytes are a JPEG file that goes in as it is."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for samples in images:
        if isinstance(samples, bytes):
            w, h, c, _, _ = jpeg.info(samples)
            at = len(out)
            out += samples + b"\0" * (len(samples) % 2)
            entries = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * c), COMPRESSION: (3, [7]), PHOTOMETRIC: (3, [6 if c == 3 else 1]), STRIP_OFFSETS: (4, [at]), SAMPLES: (3, [c]), ROWS: (4, [h]), STRIP_COUNTS: (4, [len(samples)]), PLANAR: (3, [1])}
            link = _linked(out, link, entries)
            continue
        h, w, c = samples.shape
        little = samples.astype(samples.dtype.newbyteorder("<"))
        if tile_size:
            th, tw = tile_size
            parts = [tile(little, ty, tx, th, tw) for ty in range(-(-h // th)) for tx in range(-(-w // tw))]
        else:
            parts = [little[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        raw = [np.ascontiguousarray(p).tobytes() for p in parts]
        packed = [zlib.compress(p) if compress else p for p in raw]
        offsets = []
        for p in packed:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[samples.dtype.kind]
        entries = {
            WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * samples.dtype.itemsize] * c), COMPRESSION: (3, [8 if compress else 1]), PHOTOMETRIC: (3, [2 if c > 2 else 1]),
            SAMPLES: (3, [c]), PLANAR: (3, [1]), SAMPLE_FORMAT: (3, [kind] * c),
        }
        if tile_size:
            entries |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, [len(p) for p in packed])}
        else:
            entries |= {STRIP_OFFSETS: (4, offsets), ROWS: (4, [rows_per_strip]), STRIP_COUNTS: (4, [len(p) for p in packed])}
        if icc:
            entries[ICC] = (7, list(icc))
        link = _linked(out, link, entries)
    return bytes(out)


def _linked(out: bytearray, link: int, entries: dict[int, tuple[int, list]]) -> int:
    """Appends a directory, points the one before to it and gives the place of its own pointer."""
    at, body, extra = len(out), struct.pack("<H", len(entries)), b""
    struct.pack_into("<I", out, link, at)
    over = at + 2 + 12 * len(entries) + 4
    for tag, (field_type, values) in sorted(entries.items()):
        value = struct.pack(f"<{len(values)}{_FORMAT[field_type]}", *values)
        if len(value) > 4:
            pointer, extra = struct.pack("<I", over + len(extra)), extra + value + b"\0" * (len(value) % 2)
            value = pointer
        body += struct.pack("<HHI", tag, field_type, len(values)) + value.ljust(4, b"\0")
    out += body + b"\0\0\0\0" + extra
    return at + len(body)
