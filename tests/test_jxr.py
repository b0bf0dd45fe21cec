"""JPEG XR: the container, headers, bit fields and reversible transforms."""

import numpy as np
import pytest

from rasterloom.operators import macroblocks as m
from rasterloom.sources import facade, icc, jxr, parts
from rasterloom.sources.raster import BadImage


def file(last=0x0D, **more):
    return jxr.File(40, 30, jxr.FORMAT_PREFIX + bytes([last]), b"codestream!", **more)


@pytest.mark.parametrize("more", [{}, {"alpha": b"alpha", "turn": 3, "resolution": (72.0, 300.0)}, {"icc": icc.srgb(), "xmp": b"<x/>", "alpha": b"odd"}])
def test_containers(more):
    f = file(**more)
    got = jxr.read(jxr.write(f))
    assert (got.width, got.height, got.pixel_format, got.codestream, got.alpha, got.icc, got.xmp) == (40, 30, f.pixel_format, b"codestream!", f.alpha, f.icc, f.xmp)
    assert got.turn == (f.turn or 0) and got.resolution == (f.resolution[0] or 96.0, f.resolution[1] or 96.0)
    assert parts.info(jxr.write(f)) == ("jxr", 40, 30, 3, "UInt8", None)
    assert facade.decode(jxr.write(f))["error"] == "no image header"
    names = [name for *_, name, _, _, _ in parts.parts(jxr.write(f))]
    assert names == sorted(names) and "BC80" in names


def test_broken_containers():
    good = jxr.write(file())
    for data in (good[:7], good[:20], b"II\xbc\x02" + good[4:], good[:8] + b"\0\0" + good[10:], jxr.write(file(0x09))):
        assert parts.info(data)[-1]
    swapped = bytearray(good)
    swapped[10:22], swapped[22:34] = good[22:34], good[10:22]
    with pytest.raises(BadImage, match="order"):
        jxr.read(bytes(swapped))


@pytest.mark.parametrize("h", [
    jxr.ImageHeader(1, 1), jxr.ImageHeader(70_000, 3, color=7, depth=7, overlap=2, rgb_order=True, alpha=True),
    jxr.ImageHeader(640, 480, hard_tiles=True, tiled=True, tile_widths=[3, 4], tile_heights=[5], index=True, by_frequency=True, turn=5, trimmed=True, long_words=True, premultiplied=True),
    jxr.ImageHeader(9, 9, tiled=True, tile_widths=[300]),
])
def test_image_headers(h):
    out = jxr.HighBitsWriter()
    h.write(out)
    out.put(5, 3)
    bits = jxr.HighBits(out.bytes())
    assert jxr.ImageHeader.read(bits) == h and bits.take(3) == 5
    with pytest.raises(BadImage):
        jxr.ImageHeader.read(jxr.HighBits(b"WMPHOTO\1" + bytes(20)))


@pytest.mark.parametrize(("h", "depth"), [
    (jxr.PlaneHeader(steps=[[9], [8], [7]]), 1), (jxr.PlaneHeader(jxr.YUV444, True, jxr.NO_HIGHPASS, 3, 4, steps=[[1, 2, 2], None]), 2),
    (jxr.PlaneHeader(jxr.YUV420, True, planes=3, steps=[[4] * 3, [5] * 3, [6, 7, 8]]), 1),
    (jxr.PlaneHeader(jxr.COMPONENTS, False, jxr.DC_ONLY, 5, 0, 10, -3, [[1, 2, 3, 4, 5]]), 7), (jxr.PlaneHeader(jxr.YUVK, planes=4, steps=[None, [6, 6, 6, 6], None]), 1),
])
def test_plane_headers(h, depth):
    out = jxr.HighBitsWriter()
    out.put(1, 3)
    h.write(out, depth)
    data = out.bytes()
    bits = jxr.HighBits(data)
    bits.take(3)
    assert jxr.PlaneHeader.read(bits, depth) == h and bits.at == 8 * len(data)


def test_bands_may_share_quantisers():
    out = jxr.HighBitsWriter()
    for value, n in ((jxr.GREY, 3), (0, 1), (jxr.ALL_BANDS, 4), (1, 1), (9, 8), (1, 1), (0, 1), (1, 1), (7, 8)):
        out.put(value, n)
    assert jxr.PlaneHeader.read(jxr.HighBits(out.bytes()), 1).steps == [[9], [9], [7]]


def test_numbers_indices_and_profiles():
    out = jxr.HighBitsWriter()
    for n in range(1, 17):
        for k in range(n):
            jxr.write_number(out, n, k)
    offsets = [0, 0xFAFF, 0xFB00, 2**32 - 1, 2**40]
    out.align()
    jxr.write_index(out, offsets)
    jxr.write_profiles(out, [(111, 4), (44, 255)])
    bits = jxr.HighBits(out.bytes())
    assert all(jxr.read_number(bits, n) == k for n in range(1, 17) for k in range(n))
    bits.align()
    assert jxr.read_index(bits, 5) == offsets and jxr.read_profiles(bits) == [(111, 4), (44, 255)]
    rng = np.random.default_rng(0)
    fields = [(int(rng.integers(0, 1 << n)), n) for n in rng.integers(1, 33, 3000).tolist()]
    out = jxr.HighBitsWriter()
    for value, n in fields:
        out.put(value, n)
    bits = jxr.HighBits(out.bytes())
    assert [bits.take(n) for _, n in fields] == [v for v, _ in fields] and bits.take(40) == 0


@pytest.mark.parametrize(("there", "back"), [
    (m.two_by_two, m.two_by_two), (lambda *v: m.two_by_two(*v, 1), lambda *v: m.two_by_two(*v, 1)), (m.rotated, m.rotated_back), (m.rotated_twice, m.rotated_twice_back),
])
def test_steps_are_reversible(there, back):
    v = np.random.default_rng(1).integers(-5000, 5000, (4, 4000))
    assert (np.stack(back(*there(*v))) == v).all()


def test_transforms_are_reversible():
    v = np.random.default_rng(2).integers(-300, 300, (33, 50))
    p = m.macroblocks(v)
    assert p.shape == (3, 4, 256) and (m.plane(p, 33, 50) == v).all()
    assert (p[0, 0, :4] == v[0, :4]).all() and (p[0, 0, 4:8] == v[1, :4]).all() and (p[0, 0, 16:20] == v[0, 4:8]).all()
    assert (m.block_inverse(m.block_forward(p.reshape(3, 4, 16, 16))) == p.reshape(3, 4, 16, 16)).all()
    assert (m.low_inverse(m.low_forward(p)) == p).all()
    assert (m.inverse(m.forward(p)) == p).all()
    flat = m.forward(np.full((1, 1, 256), 80))
    assert not flat[0, 0, 1:].any() and flat[0, 0, 0]
    even = 2 * p
    for rows in (2, 4):
        assert (m.chroma_low_inverse(m.chroma_low_forward(even, rows), rows) == even).all()
    assert (m.scaled(m.scaled(even, True), False) == even).all()
    assert (m.dequantized(p, 3) == 3 * p).all()
    assert m.ones(np.array([0, 0xFFFF, 0x10001, 0b1011])).tolist() == [0, 16, 1, 3]


def test_made_profile():
    profile = icc.srgb()
    assert int.from_bytes(profile[:4], "big") == len(profile) and profile[36:40] == b"acsp"
    n = int.from_bytes(profile[128:132], "big")
    tags = [(profile[132 + 12 * i : 136 + 12 * i], int.from_bytes(profile[136 + 12 * i : 140 + 12 * i], "big"), int.from_bytes(profile[140 + 12 * i : 144 + 12 * i], "big")) for i in range(n)]
    assert {t for t, _, _ in tags} >= {b"desc", b"rXYZ", b"gTRC", b"wtpt", b"chad"} and all(at % 4 == 0 and at + size <= len(profile) for _, at, size in tags)
    assert icc.cicp(icc.with_cicp(profile, 9, 16)) == (9, 16, 0, True)
