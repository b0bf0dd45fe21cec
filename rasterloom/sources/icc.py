"""ICC profiles: adding the tag of coded colour points."""

from __future__ import annotations

import hashlib
import struct

from .raster import BadImage


def with_cicp(profile: bytes, primaries: int, transfer: int, matrix: int = 0, full_range: bool = True) -> bytes:
    """The profile with a ``cicp`` tag behind its others and a new profile id."""
    if len(profile) < 132 or struct.unpack_from(">I", profile)[0] != len(profile):
        raise BadImage("profile size")
    (n,) = struct.unpack_from(">I", profile, 128)
    end = 132 + 12 * n
    if end > len(profile):
        raise BadImage("tag table")
    size = len(profile) + 24
    entries = [struct.unpack_from(">4sII", profile, 132 + 12 * i) for i in range(n)]
    # The table grows by an entry, so everything behind it moves by one.
    table = b"".join(struct.pack(">4sII", name, at + 12, length) for name, at, length in entries)
    body = b"cicp\0\0\0\0" + bytes([primaries, transfer, matrix, full_range])
    out = bytearray(struct.pack(">I", size) + profile[4:128] + struct.pack(">I", n + 1) + table + struct.pack(">4sII", b"cicp", size - 12, 12) + profile[end:] + body)
    hashed = bytearray(out)
    for a, z in ((44, 48), (64, 68), (84, 100)):  # flags, rendering intent and the id itself count as zero
        hashed[a:z] = bytes(z - a)
    out[84:100] = hashlib.md5(hashed).digest()
    return bytes(out)


def cicp(profile: bytes) -> tuple[int, int, int, bool] | None:
    """The coded colour points of a profile, if it has them."""
    (n,) = struct.unpack_from(">I", profile, 128)
    for i in range(n):
        name, at, length = struct.unpack_from(">4sII", profile, 132 + 12 * i)
        if name == b"cicp" and length >= 12:
            a, b, c, d = profile[at + 8 : at + 12]
            return a, b, c, d != 0
    return None


def srgb() -> bytes:
    """An sRGB display profile of version 4, made from the definition: D65 primaries adapted to D50 and the parametric curve."""
    # The D50 white point, the adaptation from D65, the adapted primaries and the curve, in 1/65536.
    white = (63190, 65536, 54061)
    adaptation = (68674, 1502, -3291, 1939, 64912, -1118, -605, 987, 49262)
    primaries = {b"rXYZ": (28576, 14581, 912), b"gXYZ": (25241, 46981, 6362), b"bXYZ": (9373, 3974, 46788)}
    curve = (157286, 62119, 3417, 5072, 2651)

    def text(value: str) -> bytes:
        raw = value.encode("utf-16-be")
        return b"mluc" + struct.pack(">III2s2sII", 0, 1, 12, b"en", b"US", len(raw), 28) + raw

    fixed = lambda kind, values: kind + struct.pack(f">I{len(values)}i", 0, *values)
    curve_body = b"para" + struct.pack(">IHH5i", 0, 3, 0, *curve)
    tags = {b"desc": text("sRGB"), b"cprt": text("No copyright, use freely"), b"wtpt": fixed(b"XYZ ", white), b"chad": fixed(b"sf32", adaptation)}
    tags |= {name: fixed(b"XYZ ", v) for name, v in primaries.items()} | {name: curve_body for name in (b"rTRC", b"gTRC", b"bTRC")}
    at = 132 + 12 * len(tags)
    places: dict[bytes, int] = {}
    tail, table = b"", b""
    for name, body in tags.items():
        if body not in places:  # equal curves are stored once
            places[body] = at + len(tail)
            tail += body + b"\0" * (-len(body) % 4)
        table += struct.pack(">4sII", name, places[body], len(body))
    head = struct.pack(">I4sI4s4s4s12s4s4sI4s4sQI3i4s", at + len(tail), b"\0" * 4, 0x04300000, b"mntr", b"RGB ", b"XYZ ", struct.pack(">6H", 2000, 1, 1, 0, 0, 0), b"acsp", b"\0" * 4, 0, b"\0" * 4, b"\0" * 4, 0, 0, *white, b"\0" * 4)
    out = bytearray(head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + table + tail)
    hashed = bytearray(out)
    for a, z in ((44, 48), (64, 68), (84, 100)):
        hashed[a:z] = bytes(z - a)
    out[84:100] = hashlib.md5(hashed).digest()
    return bytes(out)
