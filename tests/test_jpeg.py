"""JPEG: bytes of the encoder, pixels of the decoder, metadata and gain maps."""

import hashlib
import math
import struct
from datetime import datetime

import numpy as np
import pytest

from rasterloom.sources import exif, facade, gain_map, jpeg, lossless_jpeg, png
from rasterloom.sources.raster import BadImage

# Digests of the files that the established encoder makes of the pattern below.
DIGESTS = {
    (64, 48, 3, 100): "405C469522DBFFBD3EA6656CA5FA62F5FF93A2B33E51A64611092C64AB64189C", (64, 48, 3, 95): "E4EF55CB2F8FE8E793C1697A6982E8947D18E5558C149F3DE4566E298D144053",
    (64, 48, 3, 90): "121DBEE8B23135CEFC6F7069ACE80F2000650BA834174240EBB5C5ED3E0472CE", (64, 48, 3, 25): "0E424AB0EBEF5518605923CEA45FA96F712B574BF45EFD0C13D6962791D0E794",
    (64, 48, 3, 1): "C68F1513A36C1CEB771112DBA3AEA4ABB83C550A28A8F8F81E537E40818AD5A4", (67, 45, 3, 95): "8F5E7A06ABA04EBA6A3AF8F0DBBB89F7936CFE0A4D5405530D5B4E3F5939B3E1",
}


def pattern(w, h, c):
    out, seed = np.zeros((h, w, c), np.uint8), 0x12345678
    for y in range(h):
        for x in range(w):
            seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
            out[y, x, 0] = min(255, max(0, x * 255 // max(1, w - 1) + (seed >> 28) - 8))
            if c > 1:
                out[y, x, 1] = min(255, y * 255 // max(1, h - 1) + (((x >> 3) ^ (y >> 3)) & 1) * 60)
            if c > 2:
                out[y, x, 2] = int(128 + 100 * math.sin(x * 0.35))
    return out


@pytest.mark.parametrize("case", DIGESTS)
def test_encoder_bytes(case):
    w, h, c, q = case
    assert hashlib.sha256(jpeg.encode(pattern(w, h, c), q)).hexdigest().upper() == DIGESTS[case]


def psnr(a, b):
    return 10 * math.log10(255**2 / max(1e-9, float(((a.astype(float) - b) ** 2).mean())))


@pytest.mark.parametrize(("q", "chroma", "least"), [(95, "auto", 37), (90, "auto", 30), (75, "444", 31), (75, "420", 29)])
def test_round_trip_quality(q, chroma, least):
    y, x = np.mgrid[:45, :67]
    smooth = np.stack([x * 3, y * 5, 128 + 60 * np.sin(x * 0.1) * np.cos(y * 0.1)], axis=-1).astype(np.uint8)
    assert psnr(jpeg.decode(jpeg.encode(smooth, q, chroma))[..., :3], smooth) > least


def test_sizes_and_scales():
    for w, h in ((1, 1), (8, 8), (17, 13), (130, 7), (7, 130)):
        data = jpeg.encode(pattern(w, h, 3), 90)
        assert jpeg.info(data) == (w, h, 3, False, True)
        for scale in (1, 2, 4, 8):
            assert jpeg.decode(data, scale).shape == (-(-h // scale), -(-w // scale), 4)


def direct_idct(c):
    u, x = np.mgrid[:8, :8]
    basis = np.where(u == 0, math.sqrt(0.5), 1) / 2 * np.cos((2 * x + 1) * u * math.pi / 16)
    return np.clip(np.floor(basis.T @ c @ basis + 128.5), 0, 255)


def test_integer_transform_is_near_the_exact_one():
    rng = np.random.default_rng(0)
    blocks = rng.integers(-60, 60, (50, 8, 8))
    exact = np.stack([direct_idct(b) for b in blocks])
    assert np.abs(jpeg.inverse_blocks(blocks).astype(int) - exact).max() <= 1
    assert (jpeg.reduced_blocks(blocks, 1)[..., 0, 0] == np.clip(np.floor(blocks[:, 0, 0] / 8 + 128.5), 0, 255)).all()


def progressive(data):
    """The baseline file of one 8-bit gray-like image as spectral selection and successive approximation scans."""
    j = jpeg.parse(data)
    head = data[: data.index(b"\xff\xc0")]
    frame = b"\xff\xc2" + data[data.index(b"\xff\xc0") + 2 : data.index(b"\xff\xc4")]
    table = lambda k, symbols: bytes([k, *([0] * 7), len(symbols), *([0] * 8), *symbols])
    symbols = list(range(255))  # eight-bit codes, the last one left out
    dht = table(0, symbols) + table(0x10, symbols)
    out = head + frame + b"\xff\xc4" + struct.pack(">H", len(dht) + 2) + dht

    def scan(components, first, last, high, low, codes):
        text = "".join(codes)
        text += "1" * (-len(text) % 8)
        body = int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
        names = b"".join(bytes([c.name, 0]) for c in components)
        payload = bytes([len(components)]) + names + bytes([first, last, high << 4 | low])
        return b"\xff\xda" + struct.pack(">H", len(payload) + 2) + payload + body

    def value(v):
        n = abs(v).bit_length()
        return (f"{(v if v > 0 else v + (1 << n) - 1):0{n}b}" if n else ""), n

    mx, my = -(-j.width // (8 * j.h_max)), -(-j.height // (8 * j.v_max))
    units = [(c, y * c.v + v, x * c.h + h) for y in range(my) for x in range(mx) for c in j.components for v in range(c.v) for h in range(c.h)]
    codes, before = [], dict.fromkeys((c.name for c in j.components), 0)
    for c, y, x in units:
        dc = int(c.coefficients[y, x, 0]) >> 1
        bits, n = value(dc - before[c.name])
        before[c.name] = dc
        codes.append(f"{n:08b}{bits}")
    out += scan(j.components, 0, 0, 0, 1, codes)
    out += scan(j.components, 0, 0, 1, 0, [str(int(c.coefficients[y, x, 0]) & 1) for c, y, x in units])
    cut = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    for c in j.components:
        blocks = [c.coefficients[y, x][jpeg.ZIGZAG].tolist() for y in range(c.height) for x in range(c.width)]
        codes, waiting = [], 0
        for b in blocks:
            run, part = 0, []
            for v in map(cut, b[1:]):
                if not v:
                    run += 1
                    continue
                part += ["11110000"] * (run // 16)
                bits, n = value(v)
                part.append(f"{run % 16 << 4 | n:08b}{bits}")
                run = 0
            if part and waiting:
                size = waiting.bit_length() - 1
                codes.append(f"{size << 4:08b}" + (f"{waiting - (1 << size):0{size}b}" if size else ""))
                waiting = 0
            codes += part
            waiting += run > 0
        if waiting:
            size = waiting.bit_length() - 1
            codes.append(f"{size << 4:08b}" + (f"{waiting - (1 << size):0{size}b}" if size else ""))
        out += scan([c], 1, 63, 0, 1, codes)
        codes = []
        for b in blocks:
            run, late = 0, []
            last = max((i for i in range(1, 64) if abs(b[i]) == 1), default=0)
            for i in range(1, 64):
                old = cut(b[i])
                if old:
                    late.append(str(abs(b[i]) & 1))
                elif b[i] and i <= last:
                    codes.append(f"{run << 4 | 1:08b}{int(b[i] > 0)}" + "".join(late))
                    run, late = 0, []
                else:
                    run += 1
                    if run == 16 and i < last:
                        codes.append("11110000" + "".join(late))
                        run, late = 0, []
            if run or late or last < 63:
                codes.append("00000000" + "".join(late))
        out += scan([c], 1, 63, 1, 0, codes)
    return out + b"\xff\xd9"


@pytest.mark.parametrize(("w", "h", "q"), [(33, 21, 90), (16, 16, 95), (40, 24, 50)])
def test_progressive_scans_give_the_same_pixels(w, h, q):
    data = jpeg.encode(pattern(w, h, 3), q)
    again = progressive(data)
    assert jpeg.info(again)[3]
    assert (jpeg.decode(again) == jpeg.decode(data)).all()


def test_damage_keeps_what_came_before():
    data = jpeg.encode(pattern(64, 48, 3), 90)
    cut = jpeg.decode(data[: len(data) * 2 // 3])
    assert (cut[:8] == jpeg.decode(data)[:8]).all()
    for bad in (b"\xff\xd8", b"\xff\xd8\xff\xd9", data[:30]):
        with pytest.raises((BadImage, IndexError, struct.error)):
            jpeg.decode(bad)
    assert facade.decode(b"\xff\xd8\xff\xd9")["error"]


def test_profile_is_spliced():
    data = jpeg.with_icc(jpeg.encode(pattern(8, 8, 3)), b"p" * 500)
    assert jpeg.raster(data).icc == b"p" * 500
    assert [s.marker for s in jpeg.segments(data)][:3] == [0xE0, 0xE2, 0xDB]
    with pytest.raises(BadImage):
        jpeg.with_icc(data, b"p" * 65520)


def directory(order, at, entries):
    body, extra, over = struct.pack(f"{order}H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in sorted(entries):
        if len(value) > 4:
            value, extra = struct.pack(f"{order}I", over + len(extra)), extra + value
        body += struct.pack(f"{order}HHI", tag, kind, count) + value.ljust(4, b"\0")
    return body + b"\0\0\0\0" + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    p = lambda f, *v: struct.pack(order + f, *v)
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    gps = [(1, *text("S")), (2, 5, 3, p("6I", 10, 1, 30, 1, 36, 1)), (3, *text("W")), (4, 5, 3, p("6I", 1, 1, 0, 1, 0, 0)), (5, 1, 1, b"\1"), (6, 5, 1, p("2I", 50, 4)), (7, 5, 3, p("6I", 1, 1, 2, 1, 3, 1)), (0x1D, *text("2020:02:03"))]
    shot = [(0x829A, 5, 1, p("2I", 1, 250)), (0x829D, 5, 1, p("2I", 28, 10)), (0x8827, 3, 2, p("2H", 400, 800)), (0x9003, *text("2021:05:06 07:08:09")), (0xA002, 4, 1, p("I", 4000))]
    main = [(0x010F, *text("Maker  ")), (0x0132, *text("0000:00:00 00:00:00")), (0x0112, 3, 1, p("H", 6)), (0x9999, 99, 1, b"1234"), (0x0110, 2, 100, p("I", 1 << 20)), (0x8769, 4, 1, p("I", 400)), (0x8825, 4, 1, p("I", 800))]
    block = (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8) + directory(order, 8, main)
    block = block.ljust(400, b"\0") + directory(order, 400, shot)
    block = block.ljust(800, b"\0") + directory(order, 800, gps)
    plain = np.zeros((2, 2, 3), np.uint8)
    body = b"Exif\0\0" + block
    in_jpeg = jpeg.encode(plain)
    in_jpeg = in_jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + in_jpeg[2:]
    for data in (block, in_jpeg, png.write(plain, exif=block)):
        e = exif.read(data)
        assert (e.make, e.model, e.iso, e.orientation, e.pixel_width) == ("Maker", None, 400, 6, 4000)
        assert (e.exposure_time, exif.ratio(e.f_number)) == ((1, 250), 2.8)
        assert (e.capture_time, e.file_time) == (datetime(2021, 5, 6, 7, 8, 9), None)
        assert e.latitude == pytest.approx(-10.51) and e.longitude == 0 and e.altitude == -12.5
        assert e.gps_time == datetime(2020, 2, 3, 1, 2, 3)
    assert exif.ratio((5, 0)) == 0 and exif.read(jpeg.encode(plain)) is None and exif.read(b"none") is None


def test_gain_map():
    y, x = np.mgrid[:32, :48]
    sdr = np.repeat((16 + 224 * x / 47).astype(np.uint8)[..., None], 3, axis=2)
    light = gain_map._linear(sdr)
    hdr = (light * (1 + x / 16)[..., None]).astype(np.float32)
    codes, p = gain_map.fitted(hdr, sdr)
    assert codes.shape == (8, 12) and p.capacity_max == pytest.approx(p.gain_max)
    out = gain_map.reconstructed(sdr, codes[..., None], p, p.capacity_max)
    assert np.abs(out - hdr).max() < 0.2
    assert (gain_map.reconstructed(sdr, codes[..., None], p, 1.0) == light.astype(np.float32)).all()
    data = gain_map.assembled(jpeg.encode(sdr, 95), jpeg.encode(codes[..., None], 95), p)
    base, gain, back = gain_map.split(data)
    assert back.gain_max == pytest.approx(p.gain_max) and not back.base_is_hdr
    assert jpeg.decode(gain).shape == (8, 12, 4) and (jpeg.decode(base) == jpeg.decode(jpeg.encode(sdr, 95))).all()
    row = facade.decode(data)
    assert (row["format"], row["sample_format"], row["error"]) == ("gain_map_jpeg", "Float32", None)
    # Without the index, the container directory locates the map.
    at = data.index(b"MPF\0")
    assert gain_map.split(data[:at] + b"XXX\0" + data[at + 4 :])[1] == gain
    assert gain_map.split(jpeg.encode(sdr)) is None and facade.decode(jpeg.encode(sdr))["format"] == "jpeg"


@pytest.mark.parametrize("kind", range(1, 8))
@pytest.mark.parametrize(("precision", "restart"), [(8, 0), (12, 5), (16, 7)])
def test_lossless_round_trip(kind, precision, restart):
    rng = np.random.default_rng(kind)
    samples = rng.integers(0, 1 << precision, (6, 7, 2)).astype(np.uint16)
    samples[:3] = samples[:3] // 3
    back, bits = lossless_jpeg.decode(lossless_jpeg.encode(samples, precision, kind, restart))
    assert bits == precision and (back == samples).all()


def test_lossless_refuses_other_processes():
    with pytest.raises(BadImage):
        lossless_jpeg.decode(jpeg.encode(pattern(8, 8, 3)))
