"""Round trips and refusals of the file formats."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from rasterloom.sources import exr, facade, jpeg, piz, png, tiff
from rasterloom.sources.raster import HLG, PQ, BadImage

small = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(1, 4))


@settings(deadline=None, max_examples=40)
@given(st.sampled_from([np.uint8, np.uint16]).flatmap(lambda t: arrays(t, small)))
def test_png_round_trip(samples):
    back = png.raster(png.write(samples))
    assert back.samples.dtype == samples.dtype and (back.samples == samples).all()


@settings(deadline=None, max_examples=40)
@given(st.sampled_from([np.uint8, np.uint16, np.int16, np.uint32, np.float32, np.float16]).flatmap(lambda t: arrays(t, small)), st.booleans())
def test_tiff_round_trip(samples, compress):
    pages = tiff.pages(tiff.write([samples, samples], compress=compress, rows_per_strip=2))
    assert len(pages) == 2
    assert all(np.array_equal(p.samples, samples, equal_nan=samples.dtype.kind == "f") for p in pages)


@settings(deadline=None, max_examples=40)
@given(st.sampled_from([exr.NONE, exr.RLE, exr.ZIPS, exr.ZIP, exr.PIZ]), st.integers(1, 40), st.integers(1, 20), st.integers(0, 3))
def test_exr_round_trip(compression, h, w, seed):
    rng = np.random.default_rng(seed)
    channels = {"G": rng.normal(size=(h, w)).astype(np.float16), "R": np.zeros((h, w), np.float32), "id": rng.integers(0, 5, (h, w)).astype(np.uint32)}
    back = exr.read(exr.write(channels, compression))
    assert list(back.channels) == ["G", "R", "id"]
    assert all((back.channels[n] == v).all() for n, v in channels.items())


@given(st.binary(max_size=400))
def test_exr_byte_coding(raw):
    assert exr.merge_sum(exr.split_delta(raw)) == raw
    assert exr.rle_unpack(exr.rle_pack(raw), len(raw)) == raw


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, 9])
def test_png_unfilter(kind):
    rng = np.random.default_rng(kind)
    rows = np.column_stack([np.full(5, kind), rng.integers(0, 256, (5, 12))]).astype(np.uint8)
    out = png.unfilter(rows, 3)
    for y in range(5):
        for i in range(12):
            a = int(out[y, i - 3]) if i >= 3 else 0
            b = int(out[y - 1, i]) if y else 0
            c = int(out[y - 1, i - 3]) if y and i >= 3 else 0
            near = min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2]
            add = {1: a, 2: b, 3: (a + b) // 2, 4: near}.get(kind, 0)
            assert out[y, i] == (int(rows[y, i + 1]) + add) % 256


def indexed(palette=b"\1\2\3\4\5\6", alpha=b"\7", at=1):
    head = (1).to_bytes(4, "big") * 2 + bytes([8, 3, 0, 0, 0])
    parts = [(b"IHDR", head), (b"PLTE", palette), (b"tRNS", alpha), (b"IDAT", zlib.compress(bytes([0, at]))), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(png.chunk(*p) for p in parts)


def test_png_palette():
    assert png.raster(indexed(at=0)).samples.tolist() == [[[1, 2, 3, 7]]]
    assert png.raster(indexed(at=1)).samples.tolist() == [[[4, 5, 6, 255]]]
    with pytest.raises(BadImage):
        png.raster(indexed(at=2))


def test_png_metadata():
    s = np.zeros((2, 2, 3), np.uint8)
    p = png.read(png.write(s, cicp=(9, PQ, 0, True), mastering=tuple(range(10)), light_level=(5, 6), gamma=1.0, chromaticities=(0.3127, 0.329) + (0.1,) * 6, icc=b"x" * 50, exif=b"II*\0"))
    assert (p.cicp, p.mastering, p.light_level, p.gamma, p.icc, p.exif) == ((9, PQ, 0, True), tuple(range(10)), (5, 6), 1.0, b"x" * 50, b"II*\0")
    assert p.chromaticities[:2] == (0.3127, 0.329)
    assert png.raster(png.write(s, gamma=1.0)).color.transfer == 8
    for transfer in (PQ, HLG):
        with pytest.raises(BadImage):
            png.raster(png.write(s, cicp=(9, transfer, 0, True))).rgba8()


def test_damaged_files_are_errors_in_the_row():
    good = png.write(np.zeros((3, 3, 1), np.uint8))
    bad = good[:-20] + b"x" + good[-19:]
    assert facade.decode(good)["error"] is None
    assert facade.decode(bad)["format"] == "png" and facade.decode(bad)["error"]
    assert facade.decode(b"nothing")["error"] == "no known format"
    assert facade.decode(None)["error"] and facade.decode(b"")["error"]
    assert facade.decode(b"II*\0")["error"] and facade.decode(exr.MAGIC)["error"]


def test_display_and_float_projection():
    wide = png.raster(png.write(np.array([[[65535, 0x1234]]], np.uint16)))
    assert wide.rgba8().tolist() == [[[255, 255, 255, 0x12]]]
    assert wide.floats()[0, 0, 0] == 1.0
    light = exr.raster(exr.write({"Y": np.ones((1, 1), np.float32)}))
    with pytest.raises(BadImage):
        light.rgba8()


def test_tile_padding():
    s = np.arange(15, dtype=np.uint8).reshape(3, 5, 1)
    assert tiff.tile(s, 1, 1, 2, 3)[..., 0].tolist() == [[13, 14, 0], [0, 0, 0]]


def test_data_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png.write(np.full((2, 3, 3), 9, np.uint8)))
    (tmp_path / "b.exr").write_bytes(exr.write({"Y": np.ones((4, 5), np.float32)}))
    (tmp_path / "c.txt").write_bytes(b"text")
    facade.register_source(spark)
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("raster").load(str(tmp_path)).collect()}
    assert (rows["a.png"].width, rows["a.png"].channels, rows["a.png"].color.transfer) == (3, 3, 13)
    assert (rows["b.exr"].height, rows["b.exr"].sample_format) == (4, "Float32")
    assert rows["c.txt"].error


@pytest.mark.parametrize("top", [100, 60000])
@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (7, 5), (16, 33), (32, 32)])
def test_wavelet_inverse(shape, top):
    plane = np.random.default_rng(top).integers(0, top, shape).astype(np.uint16)
    assert (piz.wavelet(piz.wavelet(plane, top), top, inverse=True) == plane).all()


@pytest.mark.parametrize("kind", ["flat", "runs", "noise", "skew"])
def test_huffman_round_trip(kind):
    rng = np.random.default_rng(1)
    values = {"flat": np.full(700, 5), "runs": np.repeat(rng.integers(0, 60000, 20), 300), "noise": rng.integers(0, 65536, 3000), "skew": (rng.exponential(3, 5000) ** 3).astype(int) % 65536}[kind].astype(np.uint16)
    packed = piz.huffman_pack(values)
    assert (piz.huffman_unpack(packed, len(values)) == values).all()
    if kind in ("flat", "runs"):
        assert len(packed) < len(values)


def test_smooth_images_shrink():
    y, x = np.mgrid[:64, :80]
    smooth = {"R": (np.sin(x / 20) * np.cos(y / 15)).astype(np.float16)}
    sizes = {c: len(exr.write(smooth, c)) for c in (exr.NONE, exr.ZIP, exr.PIZ)}
    assert sizes[exr.PIZ] < sizes[exr.NONE] and sizes[exr.ZIP] < sizes[exr.NONE]


def test_pages_from_other_files():
    picture = np.random.default_rng(0).integers(0, 256, (9, 7, 3)).astype(np.uint8)
    file = jpeg.encode(picture)
    data = tiff.write([file, tiff.png_page(png.write(picture))], rows_per_strip=4)
    first, following = tiff.directory(data, int.from_bytes(data[4:8], "little"), "<")
    at, n = first[tiff.STRIP_OFFSETS].values("<")[0], first[tiff.STRIP_COUNTS].values("<")[0]
    assert data[at : at + n] == file and first[tiff.COMPRESSION].values("<") == (7,)
    second, end = tiff.directory(data, following, "<")
    assert end == 0 and second[tiff.HEIGHT].values("<") == (9,)
    with pytest.raises(BadImage):
        tiff.pages(data)  # packed JPEG strips are written and not read
    with pytest.raises(BadImage):
        tiff.png_page(png.write(picture.astype(np.uint16)))
