"""PNG: chunks, decoding and encoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .raster import LINEAR, BadImage, Color, Raster

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples of a pixel by colour type, and the bit depths read for it.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (8, 16), 2: (8, 16), 3: (8,), 4: (8, 16), 6: (8, 16)}


def chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Type and payload of each chunk up to the end chunk; checksums must hold."""
    if not data.startswith(SIGNATURE):
        raise BadImage("no PNG signature")
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("truncated chunk")
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            raise BadImage("chunk runs past the end")
        body = data[at + 4 : at + 8 + n]
        if zlib.crc32(body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise BadImage(f"checksum of chunk at {at}")
        yield body[:4].decode("latin-1"), body[4:]
        if body[:4] == b"IEND":
            return
        at += 12 + n


@dataclass
class Png:
    width: int = 0
    height: int = 0
    depth: int = 0
    color_type: int = -1
    samples: np.ndarray | None = None
    palette: bytes | None = None
    palette_alpha: bytes | None = None
    icc: bytes | None = None
    icc_name: str | None = None
    srgb_intent: int | None = None
    gamma: float | None = None
    chromaticities: tuple[float, ...] | None = None
    cicp: tuple[int, int, int, bool] | None = None
    mastering: tuple[int, ...] | None = None
    light_level: tuple[int, int] | None = None
    exif: bytes | None = None
    text: dict[str, str] = field(default_factory=dict)


def info(data: bytes) -> tuple[int, int, int, str] | None:
    """Width, height, channels and sample format from the header chunk alone."""
    if len(data) < 33 or not data.startswith(SIGNATURE) or data[12:16] != b"IHDR":
        return None
    w, h, depth, kind = struct.unpack(">iiBB", data[16:26])
    if w <= 0 or h <= 0 or kind not in CHANNELS:
        return None
    return w, h, 4 if kind == 3 else CHANNELS[kind], "UInt16" if depth == 16 and kind != 3 else "UInt8"


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the filters of rows that start with their filter byte; an unknown filter is none."""
    h, n = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((h, n), dtype=np.uint8)
    above = np.zeros(n, dtype=np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:  # left: running sums of each byte lane
            pad = -n % bpp
            lanes = np.append(line, np.zeros(pad, np.uint8)).reshape(-1, bpp)
            out[y] = np.add.accumulate(lanes, axis=0, dtype=np.uint8).reshape(-1)[:n]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            out[y] = _recursive(line, above, bpp, kind)
        else:
            out[y] = line
        above = out[y]
    return out


def _recursive(line: np.ndarray, above: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    row, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(row)):
        a, b = (row[i - bpp] if i >= bpp else 0), up[i]
        if kind == 3:
            row[i] = (row[i] + (a + b) // 2) & 255
        else:
            c = up[i - bpp] if i >= bpp else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            row[i] = (row[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.frombuffer(bytes(row), np.uint8)


def read(data: bytes) -> Png:
    """All chunks that carry pixels or colour, and the unfiltered samples; 16-bit samples in native order."""
    p, packed = Png(), []
    for kind, body in chunks(data):
        if kind == "IHDR":
            if p.width or len(body) != 13:
                raise BadImage("header chunk")
            p.width, p.height, p.depth, p.color_type, method, filtering, interlace = struct.unpack(">iiBBBBB", body)
            if p.width <= 0 or p.height <= 0 or method or filtering:
                raise BadImage("header values")
            if interlace or p.depth not in DEPTHS.get(p.color_type, ()):
                raise BadImage("interlacing or a depth that is not read")
        elif kind == "IDAT":
            packed.append(body)
        elif kind == "PLTE":
            if not body or len(body) % 3:
                raise BadImage("palette length")
            p.palette = body
        elif kind == "tRNS":
            p.palette_alpha = body
        elif kind == "iCCP":
            name, _, rest = body.partition(b"\0")
            p.icc_name, p.icc = name.decode("latin-1"), zlib.decompress(rest[1:])
        elif kind == "sRGB" and len(body) == 1:
            p.srgb_intent = body[0]
        elif kind == "gAMA" and len(body) == 4:
            p.gamma = int.from_bytes(body, "big") / 100_000
        elif kind == "cHRM" and len(body) == 32:
            p.chromaticities = tuple(x / 100_000 for x in struct.unpack(">8I", body))
        elif kind == "cICP" and len(body) == 4:
            p.cicp = (body[0], body[1], body[2], body[3] != 0)
        elif kind in ("mDCV", "mDCv") and len(body) == 24:
            p.mastering = struct.unpack(">8H2I", body)
        elif kind == "cLLI" and len(body) == 8:
            p.light_level = struct.unpack(">2I", body)
        elif kind == "eXIf":
            p.exif = body
        elif kind == "tEXt":
            key, _, value = body.partition(b"\0")
            p.text[key.decode("latin-1")] = value.decode("latin-1")
    if not p.width or not packed:
        raise BadImage("no header or no pixels")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    channels = CHANNELS[p.color_type]
    bpp = channels * p.depth // 8
    if len(raw) != p.height * (p.width * bpp + 1):
        raise BadImage("length of the pixels")
    rows = unfilter(np.frombuffer(raw, np.uint8).reshape(p.height, -1), bpp)
    samples = rows.view(">u2").astype(np.uint16) if p.depth == 16 else rows
    p.samples = samples.reshape(p.height, p.width, channels)
    return p


def raster(data: bytes) -> Raster:
    """Pixels in their own layout, palettes expanded; colour from cICP, else linear for gamma 1, else sRGB."""
    p = read(data)
    color = Color()
    if p.cicp:
        color = Color(p.cicp[0], p.cicp[1], p.cicp[3])
    elif p.gamma == 1.0:
        color.transfer = LINEAR
    return Raster(palette_pixels(p) if p.color_type == 3 else p.samples, color, p.icc)


def palette_pixels(p: Png) -> np.ndarray:
    if p.palette is None:
        raise BadImage("no palette")
    entries = np.frombuffer(p.palette, np.uint8).reshape(-1, 3)
    if p.samples.max(initial=0) >= len(entries):
        raise BadImage("index beyond the palette")
    alpha = np.full(len(entries), 255, np.uint8)
    given = np.frombuffer(p.palette_alpha or b"", np.uint8)[: len(entries)]
    alpha[: len(given)] = given
    return np.column_stack([entries, alpha])[p.samples[..., 0]]


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def filtered(rows: np.ndarray, bpp: int) -> bytes:
    """Rows with their filter bytes: the filter of the least sum of bytes taken as signed, the lowest of equals."""
    v = rows.astype(np.int16)
    a = np.pad(v, ((0, 0), (bpp, 0)))[:, : v.shape[1]]
    b = np.pad(v, ((1, 0), (0, 0)))[:-1]
    c = np.pad(b, ((0, 0), (bpp, 0)))[:, : v.shape[1]]
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    options = np.stack([v, v - a, v - b, v - (a + b) // 2, v - nearest]).astype(np.uint8)
    cost = np.abs(options.view(np.int8).astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    body = options[best, np.arange(len(rows))]
    return np.column_stack([best.astype(np.uint8), body]).tobytes()


def write(samples: np.ndarray, *, icc: bytes | None = None, icc_name: str = "ICC profile", srgb_intent: int | None = None, gamma: float | None = None, chromaticities: tuple | None = None, cicp: tuple | None = None, mastering: tuple | None = None, light_level: tuple | None = None, exif: bytes | None = None, level: int = 6) -> bytes:
    """Encodes 8- or 16-bit samples of 1 to 4 channels. A profile displaces the sRGB chunk."""
    h, w, c = samples.shape
    if samples.dtype not in (np.uint8, np.uint16) or not h or not w:
        raise BadImage("samples to encode")
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    depth = 8 * samples.dtype.itemsize
    rows = np.ascontiguousarray(samples, dtype=samples.dtype.newbyteorder(">")).reshape(h, -1).view(np.uint8)
    out = [SIGNATURE, chunk(b"IHDR", struct.pack(">iiBBBBB", w, h, depth, kind, 0, 0, 0))]
    if cicp:
        out.append(chunk(b"cICP", bytes(map(int, cicp))))
    if mastering:
        out.append(chunk(b"mDCV", struct.pack(">8H2I", *mastering)))
    if light_level:
        out.append(chunk(b"cLLI", struct.pack(">2I", *light_level)))
    if icc:
        out.append(chunk(b"iCCP", icc_name.encode("latin-1") + b"\0\0" + zlib.compress(icc)))
    elif srgb_intent is not None:
        out.append(chunk(b"sRGB", bytes([srgb_intent])))
    if gamma is not None:
        out.append(chunk(b"gAMA", round(gamma * 100_000).to_bytes(4, "big")))
    if chromaticities:
        out.append(chunk(b"cHRM", struct.pack(">8I", *(round(x * 100_000) for x in chromaticities))))
    out.append(chunk(b"IDAT", zlib.compress(filtered(rows, c * depth // 8), level)))
    if exif:
        out.append(chunk(b"eXIf", exif))
    return b"".join([*out, chunk(b"IEND", b"")])
