"""OpenEXR scan-line images with no, run-length, zlib or wavelet compression."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from . import piz
from .raster import LINEAR, BadImage, Color, Raster

MAGIC = b"\x76\x2f\x31\x01"
# Compression codes with the scan lines of their blocks, and sample types by code.
NONE, RLE, ZIPS, ZIP, PIZ = 0, 1, 2, 3, 4
LINES = {NONE: 1, RLE: 1, ZIPS: 1, ZIP: 16, PIZ: 32}
TYPES = {0: "<u4", 1: "<f2", 2: "<f4"}
_CODES = {"uint32": 0, "float16": 1, "float32": 2}


@dataclass
class Exr:
    channels: dict[str, np.ndarray] = field(default_factory=dict)
    compression: int = NONE
    attributes: dict[str, tuple[str, bytes]] = field(default_factory=dict)


def split_delta(raw: bytes) -> bytes:
    """Even bytes, then odd ones, as differences plus 128."""
    b = np.frombuffer(raw, np.uint8)
    t = np.concatenate([b[::2], b[1::2]])
    out = t.copy()
    out[1:] = t[1:] - t[:-1] + np.uint8(128)
    return out.tobytes()


def merge_sum(data: bytes) -> bytes:
    """Undoes ``split_delta``."""
    b = np.frombuffer(data, np.uint8).copy()
    b[1:] -= np.uint8(128)
    t = np.add.accumulate(b, dtype=np.uint8)
    out = np.empty(len(t), np.uint8)
    half = (len(t) + 1) // 2
    out[::2], out[1::2] = t[:half], t[half:]
    return out.tobytes()


def rle_pack(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes as a count less one and the byte; up to 127 others after their negated count."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return b""
    cuts = np.flatnonzero(np.diff(b)) + 1
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 127):
            part = plain[i : i + 127]
            out.append(256 - len(part))
            out.extend(part)
        plain.clear()

    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
        n = z - a
        while n >= 3:
            flush()
            take = min(n, 128)
            out += bytes((take - 1, data[a]))
            n -= take
        plain += data[a : a + 1] * n
    flush()
    return bytes(out)


def rle_unpack(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i] - 256 if data[i] > 127 else data[i]
        if n < 0:
            part, i = data[i + 1 : i + 1 - n], i + 1 - n
            if len(part) != -n:
                raise BadImage("literal run")
        else:
            if i + 1 >= len(data):
                raise BadImage("repeat run")
            part, i = data[i + 1 : i + 2] * (n + 1), i + 2
        out += part
    if len(out) != size:
        raise BadImage("length of the runs")
    return bytes(out)


def pack_block(raw: bytes, compression: int, shapes: list[tuple[int, int]], lines: int) -> bytes:
    """A block, or its raw bytes where packing does not shrink it. ``shapes`` are samples a line and 16-bit words a sample of each channel."""
    packed = raw
    if compression == RLE:
        packed = rle_pack(split_delta(raw))
    elif compression in (ZIPS, ZIP):
        packed = zlib.compress(split_delta(raw))
    elif compression == PIZ:
        packed = piz.pack(raw, shapes, lines)
    return packed if len(packed) < len(raw) else raw


def unpack_block(data: bytes, compression: int, size: int, shapes: list[tuple[int, int]], lines: int) -> bytes:
    if compression == NONE or len(data) == size:
        return data
    if compression == PIZ:
        return piz.unpack(data, size, shapes, lines)
    raw = merge_sum(rle_unpack(data, size) if compression == RLE else zlib.decompress(data))
    if len(raw) != size:
        raise BadImage("length of a block")
    return raw


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("latin-1"), end + 1


@dataclass
class Header:
    width: int
    height: int
    top: int
    compression: int
    channels: list[tuple[str, np.dtype]]
    attributes: dict[str, tuple[str, bytes]]
    end: int


def header(data: bytes) -> Header:
    """The attributes, without any samples."""
    if not data.startswith(MAGIC):
        raise BadImage("no EXR magic number")
    (version,) = struct.unpack_from("<I", data, 4)
    if version & 0x1A00:
        raise BadImage("tiles, parts or deep samples")
    at, attributes = 8, {}
    while data[at]:
        name, at = _text(data, at)
        kind, at = _text(data, at)
        (n,) = struct.unpack_from("<i", data, at)
        attributes[name] = (kind, data[at + 4 : at + 4 + n])
        at += 4 + n
    at += 1
    x0, y0, x1, y1 = struct.unpack("<4i", attributes["dataWindow"][1])
    w, h = x1 - x0 + 1, y1 - y0 + 1
    compression = attributes["compression"][1][0]
    if w <= 0 or h <= 0 or compression not in LINES:
        raise BadImage("size or compression that is not read")
    listed, i, body = [], 0, attributes["channels"][1]
    while body[i]:
        name, i = _text(body, i)
        listed.append((name, np.dtype(TYPES[struct.unpack_from("<i", body, i)[0]])))
        i += 16
    listed.sort()
    return Header(w, h, y0, compression, listed, attributes, at)


def read(data: bytes) -> Exr:
    """All channels, full size, by name."""
    head = header(data)
    w, h, y0, at, listed, compression = head.width, head.height, head.top, head.end, head.channels, head.compression
    out = Exr({n: np.zeros((h, w), t) for n, t in listed}, compression, head.attributes)
    lines = LINES[compression]
    row_bytes = sum(w * t.itemsize for _, t in listed)
    shapes = [(w, t.itemsize // 2) for _, t in listed]
    for offset in struct.unpack_from(f"<{-(-h // lines)}Q", data, at):
        y, n = struct.unpack_from("<ii", data, offset)
        count = min(lines, h - (y - y0))
        raw = unpack_block(data[offset + 8 : offset + 8 + n], compression, row_bytes * count, shapes, count)
        rows = np.frombuffer(raw, np.uint8).reshape(count, row_bytes)
        left = 0
        for name, t in listed:
            right = left + w * t.itemsize
            out.channels[name][y - y0 : y - y0 + count] = np.ascontiguousarray(rows[:, left:right]).view(t)
            left = right
    return out


def write(channels: dict[str, np.ndarray], compression: int = ZIP) -> bytes:
    """Encodes half, float or uint32 channels of one size, in the order of their names."""
    listed = sorted(channels.items())
    h, w = listed[0][1].shape

    def attribute(name: str, kind: str, body: bytes) -> bytes:
        return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(body)) + body

    names = b"".join(n.encode() + b"\0" + struct.pack("<iBBBBii", _CODES[v.dtype.name], 0, 0, 0, 0, 1, 1) for n, v in listed) + b"\0"
    window = struct.pack("<4i", 0, 0, w - 1, h - 1)
    head = MAGIC + struct.pack("<I", 2) + b"".join([
        attribute("channels", "chlist", names), attribute("compression", "compression", bytes([compression])), attribute("dataWindow", "box2i", window), attribute("displayWindow", "box2i", window),
        attribute("lineOrder", "lineOrder", b"\0"), attribute("pixelAspectRatio", "float", struct.pack("<f", 1)), attribute("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), attribute("screenWindowWidth", "float", struct.pack("<f", 1)),
    ]) + b"\0"
    lines, blocks = LINES[compression], []
    shapes = [(w, v.dtype.itemsize // 2) for _, v in listed]
    rows = np.concatenate([np.ascontiguousarray(v.astype(v.dtype.newbyteorder("<"))).view(np.uint8).reshape(h, -1) for _, v in listed], axis=1)
    for y in range(0, h, lines):
        part = rows[y : y + lines]
        packed = pack_block(part.tobytes(), compression, shapes, len(part))
        blocks.append(struct.pack("<ii", y, len(packed)) + packed)
    at = len(head) + 8 * len(blocks)
    offsets = np.cumsum([at, *(len(b) for b in blocks[:-1])]).astype("<u8").tobytes()
    return head + offsets + b"".join(blocks)


def shown(names: list[str]) -> list[str]:
    """The channels that make the picture."""
    if {"R", "G", "B"} <= set(names):
        return ["R", "G", "B", "A"] if "A" in names else ["R", "G", "B"]
    if len(names) == 1 or "Y" in names:
        return names if len(names) == 1 else ["Y"]
    raise BadImage("no channels to show")


def raster(data: bytes) -> Raster:
    """R, G, B and A, else a single channel, else Y, in single precision and scene-linear light."""
    have = read(data).channels
    names = shown(list(have))
    if any(have[n].dtype == np.uint32 for n in names):
        raise BadImage("integer channels are no light")
    samples = np.stack([have[n].astype(np.float32) for n in names], axis=2)
    return Raster(samples, Color(transfer=LINEAR, float_semantics="SceneReferred"))
