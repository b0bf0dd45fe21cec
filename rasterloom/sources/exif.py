"""EXIF from JPEG, TIFF and PNG files."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from . import jpeg, png, tiff
from .raster import BadImage
from .tiff import Entry

# Tags of the typed fields and of the two linked directories.
ASCII_TAGS = {"make": 0x010F, "model": 0x0110, "software": 0x0131, "artist": 0x013B, "copyright": 0x8298}
RATIONAL_TAGS = {"exposure_time": 0x829A, "f_number": 0x829D, "focal_length": 0x920A}
SHORT_TAGS = {"iso": 0x8827, "focal_length_35mm": 0xA405, "orientation": 0x0112}
SCALAR_TAGS = {"pixel_width": 0xA002, "pixel_height": 0xA003}
TAKEN, FILED, EXIF_DIRECTORY, GPS_DIRECTORY = 0x9003, 0x0132, 0x8769, 0x8825
LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT, TIME, DATE = 1, 2, 3, 4, 5, 6, 7, 0x1D


@dataclass
class Exif:
    make: str | None = None
    model: str | None = None
    capture_time: datetime | None = None
    file_time: datetime | None = None
    exposure_time: tuple[int, int] | None = None
    f_number: tuple[int, int] | None = None
    iso: int | None = None
    focal_length: tuple[int, int] | None = None
    focal_length_35mm: int | None = None
    software: str | None = None
    artist: str | None = None
    copyright: str | None = None
    orientation: int | None = None
    pixel_width: int | None = None
    pixel_height: int | None = None
    latitude: float | None = None
    longitude: float | None = None
    altitude: float | None = None
    gps_time: datetime | None = None
    raw: dict[int, bytes] = field(default_factory=dict)


def ratio(value: tuple[int, int]) -> float:
    """A rational as a number; 0 for a zero denominator."""
    return value[0] / value[1] if value[1] else 0.0


def read(data: bytes) -> Exif | None:
    """EXIF of a file of any of the three kinds; null without any."""
    if data.startswith(b"\xff\xd8"):
        block = jpeg.app_payload(data, 0xE1, b"Exif\0\0")
    elif data.startswith(png.SIGNATURE):
        block = next((body for kind, body in png.chunks(data) if kind == "eXIf"), None)
    else:
        block = data
    return None if block is None else from_tiff(block)


def from_tiff(data: bytes) -> Exif | None:
    """EXIF of a TIFF block: its first directory with the EXIF and the GPS directory that it links."""
    try:
        order = tiff.byte_order(data)
    except BadImage:
        return None
    entries, _ = tiff.directory(data, struct.unpack_from(f"{order}I", data, 4)[0], order)
    linked = {}
    for tag in (EXIF_DIRECTORY, GPS_DIRECTORY):
        if tag in entries:
            try:
                linked[tag] = tiff.directory(data, entries[tag].values(order)[0], order)[0]
            except BadImage:
                linked[tag] = {}
    entries |= linked.get(EXIF_DIRECTORY, {})
    out = Exif(raw={t: e.data for t, e in entries.items()})
    for name, tag in ASCII_TAGS.items():
        setattr(out, name, _text(entries.get(tag)))
    for name, tag in RATIONAL_TAGS.items():
        e = entries.get(tag)
        if e and e.kind == 5 and e.count:
            setattr(out, name, e.values(order)[0])
    for name, tag in (SHORT_TAGS | SCALAR_TAGS).items():
        e = entries.get(tag)
        if e and e.kind in (3, 4) and e.count:
            setattr(out, name, e.values(order)[0])
    out.file_time = _time(entries.get(FILED))
    out.capture_time = _time(entries.get(TAKEN)) or out.file_time
    if GPS_DIRECTORY in linked:
        _gps(out, linked[GPS_DIRECTORY], order)
    return out


def _text(e: Entry | None) -> str | None:
    return e.data.rstrip(b"\0 ").decode("utf-8", "replace") if e and e.kind == 2 else None


def _time(e: Entry | None) -> datetime | None:
    try:
        return datetime.strptime(_text(e) or "", "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def _three(e: Entry | None, order: str) -> list[float] | None:
    if not e or e.kind != 5 or e.count < 3:
        return None
    parts = e.values(order)[:3]
    return None if any(not d for _, d in parts) else [n / d for n, d in parts]


def _gps(out: Exif, gps: dict[int, Entry], order: str) -> None:
    """Degrees with a sign; an axis without a value is 0 if the other has one."""

    def axis(value: int, ref: int, negative: str) -> float | None:
        parts = _three(gps.get(value), order)
        if parts is None:
            return None
        degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -degrees if gps.get(ref) and gps[ref].data.rstrip(b"\0 ").decode("latin-1") == negative else degrees

    lat, lon = axis(LAT, LAT_REF, "S"), axis(LON, LON_REF, "W")
    if lat is None and lon is None:
        return
    out.latitude, out.longitude = lat or 0.0, lon or 0.0
    e = gps.get(ALT)
    if e and e.kind == 5 and e.count and e.values(order)[0][1]:
        below = gps.get(ALT_REF) and gps[ALT_REF].data[:1] == b"\1"
        out.altitude = ratio(e.values(order)[0]) * (-1 if below else 1)
    parts = _three(gps.get(TIME), order)
    try:
        day = datetime.strptime((gps[DATE].data if DATE in gps else b"").rstrip(b"\0 ").decode("latin-1"), "%Y:%m:%d")
    except ValueError:
        return
    if parts:
        out.gps_time = day + timedelta(seconds=parts[0] * 3600 + parts[1] * 60 + parts[2])
