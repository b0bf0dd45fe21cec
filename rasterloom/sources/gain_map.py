"""Gain-map JPEG: two renditions in one file, their parameters, and the HDR image made of them."""

from __future__ import annotations

import math
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np

from . import jpeg
from .raster import LINEAR, BadImage, Color, Raster

# Identifiers of the segments and the name spaces of their packets.
XMP, MPF = b"http://ns.adobe.com/xap/1.0/\0", b"MPF\0"
RDF, HDRGM = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://ns.adobe.com/hdr-gain-map/1.0/"
CONTAINER, ITEM = "http://ns.google.com/photos/1.0/container/", "http://ns.google.com/photos/1.0/container/item/"
MPF_LENGTH = 90
OFFSET = 1 / 64


@dataclass
class Parameters:
    gain_max: float
    capacity_max: float
    gain_min: float = 1.0
    gamma: float = 1.0
    offset_sdr: float = OFFSET
    offset_hdr: float = OFFSET
    capacity_min: float = 1.0
    base_is_hdr: bool = False

    def check(self) -> None:
        if not (0 < self.gain_min <= self.gain_max and self.gamma > 0 and self.offset_sdr >= 0 and self.offset_hdr >= 0 and 1 <= self.capacity_min < self.capacity_max):
            raise BadImage("gain map parameters")

    def weight(self, headroom: float) -> float:
        """Share of the gain that a display with this headroom shows."""
        low, high = math.log2(self.capacity_min), math.log2(self.capacity_max)
        return min(max((math.log2(headroom) - low) / (high - low), 0.0), 1.0)


#: Names of the parameters in the packet, and whether they are logarithms there.
_NAMES = {"GainMapMin": ("gain_min", True), "GainMapMax": ("gain_max", True), "Gamma": ("gamma", False), "OffsetSDR": ("offset_sdr", False), "OffsetHDR": ("offset_hdr", False), "HDRCapacityMin": ("capacity_min", True), "HDRCapacityMax": ("capacity_max", True)}


def _tree(packet: bytes) -> ET.Element | None:
    if b"<!DOCTYPE" in packet:
        return None
    try:
        return ET.fromstring(packet.rstrip(b"\0 "))
    except ET.ParseError:
        return None


def _value(node: ET.Element, name: str) -> str | None:
    """An attribute, or a child's text, or the first item of its list."""
    found = node.get(f"{{{HDRGM}}}{name}")
    if found is None and (child := node.find(f"{{{HDRGM}}}{name}")) is not None:
        item = child.find(f".//{{{RDF}}}li")
        found = (child if item is None else item).text
    return None if found is None else found.strip()


def parameters(packet: bytes) -> Parameters | None:
    root = _tree(packet)
    for node in [] if root is None else root.iter(f"{{{RDF}}}Description"):
        texts = {n: _value(node, n) for n in _NAMES}
        if _value(node, "Version") is None or texts["GainMapMax"] is None or texts["HDRCapacityMax"] is None:
            continue
        try:
            values = {field: 2.0 ** float(texts[n]) if log else float(texts[n]) for n, (field, log) in _NAMES.items() if texts[n] is not None}
        except ValueError:
            return None
        return Parameters(**values, base_is_hdr=(_value(node, "BaseRenditionIsHDR") or "").lower() == "true")
    return None


def declared_length(packet: bytes) -> int | None:
    """Bytes of the gain map by the container directory."""
    root = _tree(packet)
    for node in [] if root is None else root.iter(f"{{{CONTAINER}}}Item"):
        if (node.get(f"{{{ITEM}}}Semantic") or "").lower() == "gainmap":
            text = node.get(f"{{{ITEM}}}Length") or ""
            return int(text) if text.isdigit() and int(text) else None
    return None


def index_entries(payload: bytes, at: int) -> list[tuple[int, int, int]]:
    """``(attribute, length, absolute offset)`` of up to 16 images; ``at`` is the payload's place in the file."""
    order = {b"MM\0*": ">", b"II*\0": "<"}.get(payload[:4])
    if order is None or len(payload) < 16:
        return []
    (start,) = struct.unpack_from(f"{order}I", payload, 4)
    if start + 2 > len(payload):
        return []
    (n,) = struct.unpack_from(f"{order}H", payload, start)
    if start + 2 + 12 * n + 4 > len(payload):
        return []
    tags = {struct.unpack_from(f"{order}H", payload, i)[0]: struct.unpack_from(f"{order}I", payload, i + 8)[0] for i in range(start + 2, start + 2 + 12 * n, 12)}
    images, first = tags.get(0xB001, 0), tags.get(0xB002, 0)
    if not 0 < images <= 16 or not first or first + 16 * images > len(payload):
        return []
    rows = [struct.unpack_from(f"{order}3I", payload, first + 16 * i) for i in range(images)]
    return [(a, n, at + o if o else 0) for a, n, o in rows]


def split(data: bytes) -> tuple[bytes, bytes, Parameters] | None:
    """Base, gain map and parameters; the index locates the map, else the container directory."""
    if not data.startswith(b"\xff\xd8"):
        return None
    start, length = -1, 0
    for s in jpeg.segments(data):
        if s.marker == 0xE2 and s.payload.startswith(MPF):
            for _, n, at in index_entries(s.payload[4:], s.offset + 8):
                if at and data[at : at + 2] == b"\xff\xd8":
                    start, length = at, n if 0 < n <= len(data) - at else len(data) - at
                    break
            break
    if start < 0 and (packet := jpeg.app_payload(data, 0xE1, XMP)) is not None:
        n = declared_length(packet)
        if n and n < len(data) and data[-n:][:2] == b"\xff\xd8":
            start, length = len(data) - n, n
    if start < 0:
        return None
    gain = data[start : start + length]
    packet = jpeg.app_payload(gain, 0xE1, XMP)
    found = parameters(packet) if packet is not None else None
    return None if found is None else (data[:start], gain, found)


def _packet(body: str) -> bytes:
    text = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}">{body}</rdf:RDF></x:xmpmeta>'
    return XMP + text.encode()


def _segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def _spliced(data: bytes, more: bytes) -> bytes:
    at = 2
    for s in jpeg.segments(data):
        if not 0xE0 <= s.marker <= 0xEF:
            break
        at = s.offset + 4 + len(s.payload)
    return data[:at] + more + data[at:]


def assembled(base: bytes, gain: bytes, p: Parameters) -> bytes:
    """One file of a base and a gain map, neither of them encoded anew."""
    p.check()
    shown = " ".join(f'hdrgm:{n}="{(math.log2(getattr(p, f)) if log else getattr(p, f))!r}"' for n, (f, log) in _NAMES.items())
    gain = _spliced(gain, _segment(0xE1, _packet(f'<rdf:Description rdf:about="" xmlns:hdrgm="{HDRGM}" hdrgm:Version="1.0" {shown} hdrgm:BaseRenditionIsHDR="{p.base_is_hdr}"/>')))
    items = f'<rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic="Primary" Item:Mime="image/jpeg"/></rdf:li><rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic="GainMap" Item:Mime="image/jpeg" Item:Length="{len(gain)}"/></rdf:li>'
    directory = f'<rdf:Description rdf:about="" xmlns:Container="{CONTAINER}" xmlns:Item="{ITEM}" xmlns:hdrgm="{HDRGM}" hdrgm:Version="1.0"><Container:Directory><rdf:Seq>{items}</rdf:Seq></Container:Directory></rdf:Description>'
    xmp = _segment(0xE1, _packet(directory))
    total = len(base) + len(xmp) + MPF_LENGTH
    at = _spliced(base, xmp + b"\0" * MPF_LENGTH).index(b"\0" * MPF_LENGTH, 2 + len(xmp))
    tags = struct.pack(">H", 3) + struct.pack(">HHI4s", 0xB000, 7, 4, b"0100") + struct.pack(">HHII", 0xB001, 4, 1, 2) + struct.pack(">HHII", 0xB002, 7, 32, 50) + struct.pack(">I", 0)
    entries = struct.pack(">4I", 0x30000, total, 0, 0) + struct.pack(">4I", 0, len(gain), total - (at + 8), 0)
    index = _segment(0xE2, MPF + b"MM\0*" + struct.pack(">I", 8) + tags + entries)
    return _spliced(base, xmp + index) + gain


def _linear(codes: np.ndarray) -> np.ndarray:
    c = codes / 255.0
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def fitted(hdr: np.ndarray, sdr: np.ndarray, downscale: int = 4) -> tuple[np.ndarray, Parameters]:
    """Gain map and parameters of a linear HDR and an 8-bit rendition (height, width, 3 or 4)."""
    luma = np.array([0.2126, 0.7152, 0.0722])
    y_sdr, y_hdr = _linear(sdr[..., :3]) @ luma, np.maximum(hdr[..., :3].astype(np.float64), 0) @ luma
    gain = np.log2((y_hdr + OFFSET) / (y_sdr + OFFSET))
    low, high = float(gain.min()), float(gain.max())
    high = max(high, low + 1e-9)
    h, w = gain.shape
    ys, xs = np.arange(0, h, downscale), np.arange(0, w, downscale)
    sums = np.add.reduceat(np.add.reduceat(gain.astype(np.float32).astype(np.float64), ys, axis=0), xs, axis=1)
    counts = np.outer(np.diff(np.append(ys, h)), np.diff(np.append(xs, w)))
    codes = np.rint(np.clip((sums / counts - low) / (high - low), 0, 1) * 255).astype(np.uint8)
    return codes, Parameters(gain_min=2.0**low, gain_max=2.0**high, capacity_max=max(2.0**high, 1.0625))


def reconstructed(base: np.ndarray, gain: np.ndarray, p: Parameters, headroom: float) -> np.ndarray:
    """Linear HDR samples for a display; at no headroom the base itself, made linear."""
    if p.base_is_hdr:
        raise BadImage("base is HDR")
    light = _linear(base[..., :3])
    weight = p.weight(headroom)
    if not weight:
        return light.astype(np.float32)

    def axis(n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = (np.arange(n) + 0.5) * cells / n - 0.5
        low = np.clip(np.floor(u), 0, cells - 1).astype(int)
        return low, np.minimum(low + 1, cells - 1), np.clip(u - low, 0, 1)

    g = gain[..., :3].astype(np.float64)
    (y0, y1, fy), (x0, x1, fx) = axis(base.shape[0], g.shape[0]), axis(base.shape[1], g.shape[1])
    fy, fx = fy[:, None, None], fx[None, :, None]
    row = lambda y: g[y][:, x0] * (1 - fx) + g[y][:, x1] * fx
    recovery = (row(y0) * (1 - fy) + row(y1) * fy) / 255
    if p.gamma != 1:
        recovery = recovery ** (1 / p.gamma)
    low, high = math.log2(p.gain_min), math.log2(p.gain_max)
    return ((light + p.offset_sdr) * 2.0 ** ((low + (high - low) * recovery) * weight) - p.offset_hdr).astype(np.float32)


def raster(data: bytes) -> Raster:
    """The HDR rendition at full weight, or the base where that is the HDR one already."""
    found = split(data)
    if found is None:
        raise BadImage("no gain map")
    base, gain, p = found
    if p.base_is_hdr:
        return jpeg.raster(base)
    samples = reconstructed(jpeg.decode(base), jpeg.decode(gain), p, p.capacity_max)
    return Raster(samples, Color(transfer=LINEAR, float_semantics="DisplayReferred"))
