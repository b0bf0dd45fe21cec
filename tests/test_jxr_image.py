"""JPEG XR images: every sample format, overlap, order of bands, tiles and quantisers."""

import numpy as np
import pytest

from rasterloom.operators import overlap
from rasterloom.sources import facade, jxr, jxr_coefficients, jxr_image
from rasterloom.sources.jxr_image import Options
from rasterloom.sources.raster import BadImage

FORMATS = [(1, np.uint8), (3, np.uint8), (4, np.uint8), (1, np.uint16), (3, np.uint16), (1, np.int16), (3, np.int16), (1, np.int32), (3, np.int32), (1, np.float16), (3, np.float16), (1, np.float32)]


def picture(n, dtype, height=35, width=50, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    v = np.stack([128 + 60 * np.sin(x / (5 + k)) + 40 * np.cos(y / (9 - k)) + rng.normal(0, 3, x.shape) for k in range(n)], axis=2)
    if np.dtype(dtype).kind == "f":
        return (v / 64 - (dtype == np.float16)).astype(dtype)
    return np.clip(v * {1: 1, 2: 100, 4: 30000}[np.dtype(dtype).itemsize], 0, np.iinfo(dtype).max).astype(dtype)


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize(("n", "dtype"), FORMATS)
def test_lossless(n, dtype, levels):
    v = picture(n, dtype)
    got = jxr_image.read(jxr_image.write(v, Options(overlap=levels)))
    assert got.dtype == v.dtype and got.shape == v.shape
    if dtype == np.float32:
        assert np.abs(got - v).max() < 1e-3 and (jxr_image.read(jxr_image.write(got)) == got).all()
    else:
        assert (got == v).all()


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("more", [{"by_frequency": True}, {"tile_widths": [1, 2], "tile_heights": [1]}, {"tile_widths": [2], "by_frequency": True}])
def test_orders_and_tiles_are_lossless(levels, more):
    v = picture(3, np.uint8)
    assert (jxr_image.read(jxr_image.write(v, Options(overlap=levels, **more))) == v).all()


@pytest.mark.parametrize("more", [{"steps": (30, 40, 50)}, {"steps": (60, 60, 60), "by_frequency": True}, {"flexible": False}, {"dropped": 2}, {"dropped": 1, "by_frequency": True}])
@pytest.mark.parametrize("n", [1, 3])
def test_lossy(n, more):
    v = picture(n, np.uint8, 70, 90)
    data, whole = jxr_image.write(v, Options(overlap=1, **more)), jxr_image.write(v, Options(overlap=1))
    assert len(data) < len(whole) and np.abs(jxr_image.read(data).astype(int) - v).mean() < 5


@pytest.mark.parametrize("color", [jxr.YUV420, jxr.YUV422])
@pytest.mark.parametrize("levels", [0, 1, 2])
def test_halved_chroma(color, levels):
    y, x = np.mgrid[0:70, 0:90]
    smooth = np.stack([60 + x, 200 - y, 100 + (x + y) // 4], axis=2).astype(np.uint8)
    for more in ({}, {"by_frequency": True}, {"tile_widths": [2, 1], "tile_heights": [2]}):
        got = jxr_image.read(jxr_image.write(smooth, Options(overlap=levels, color=color, **more)))
        assert np.abs(got[:-4, :-4].astype(int) - smooth[:-4, :-4]).max() <= 3, more
    v = picture(3, np.uint8, 70, 90)
    lossy, fine = (jxr_image.write(v, Options((k, k, k), levels, color=color)) for k in (50, 0))
    assert 4 * len(lossy) < len(fine)  # scaled samples keep three bits more
    assert np.abs(jxr_image.read(fine).mean(2) - v.mean(2)).mean() < 2 and np.abs(jxr_image.read(lossy).mean(2) - v.mean(2)).mean() < 6
    grey = np.repeat(picture(1, np.uint8), 3, axis=2)
    assert (jxr_image.read(jxr_image.write(grey, Options(overlap=levels, color=color))) == grey).all()


def test_chroma_filters():
    rng = np.random.default_rng(4)
    for shape in ((2, 2), (4, 2), (2, 8), (8, 6)):
        v = rng.integers(-900, 900, shape)
        assert (overlap.pairs_filtered(overlap.pairs_filtered(v), True) == v).all()
        assert (overlap.pairs_filtered(overlap.pairs_filtered(v, True)) == v).all()
    for down in (False, True):
        flat = np.full((16, 16), 5)
        assert (jxr_image.upsampled(jxr_image.subsampled(flat, down), down) == 5).all()
    line = np.arange(16)[None] * 10
    assert jxr_image.subsampled(line, False)[0, 1:-1].tolist() == list(range(20, 140, 20)) and jxr_image.upsampled(line, False)[0, :4].tolist() == [0, 5, 10, 15]


def test_steps_follow_the_quantiser():
    v = picture(1, np.uint8, 64, 64)
    sizes = [len(jxr_image.write(v, Options((k, k, k)))) for k in (0, 8, 24, 40, 60, 90)]
    assert sizes == sorted(sizes, reverse=True)
    assert [jxr_image.step(k, False) for k in (0, 1, 5, 31, 32, 47, 48, 64)] == [1, 1, 2, 8, 8, 16, 16, 32]
    assert [jxr_image.step(k, True) for k in (1, 15, 16, 32)] == [2, 30, 32, 64]


def test_fuzzed_pictures():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        height, width = rng.integers(1, 60, 2)
        dtype = [np.uint8, np.uint16, np.int32][seed % 3]
        top = min(1 << 24, np.iinfo(dtype).max) // 4 ** (seed % 5) + 1
        v = rng.integers(-top if dtype == np.int32 else 0, top, (height, width, [1, 3][seed % 2])).astype(dtype)
        assert (jxr_image.read(jxr_image.write(v, Options(overlap=seed % 3, by_frequency=seed % 4 == 1))) == v).all(), seed


def test_flat_pictures_are_small():
    assert len(jxr_image.write(np.full((160, 160, 3), 77, np.uint8))) < 600


def test_overlap_is_reversible():
    rng = np.random.default_rng(1)
    for shape in ((4, 4), (4, 16), (32, 48)):
        v = rng.integers(-9000, 9000, shape)
        assert (overlap.filtered(overlap.filtered(v), True) == v).all() and (overlap.filtered(overlap.filtered(v, True)) == v).all()
    w = rng.integers(-9000, 9000, (50, 4, 4))
    assert (overlap.square(overlap.square(w), True) == w).all()
    flat = overlap.filtered(np.full((16, 16), 64))
    assert np.ptp(flat[2:-2, 2:-2]) <= 2


def test_layout_and_blocks():
    v = np.arange(32 * 48).reshape(32, 48)
    p = jxr_image.laid(v)
    assert (jxr_image.spread(p) == v).all() and p[0, 0, 0] == 0 and p[0, 0, 16] == 4 * 48 and p[0, 0, 64] == 4
    for seed in range(200):
        rng = np.random.default_rng(seed)
        values = [0, *(rng.integers(-3, 4, 15) * rng.integers(0, 2, 15) * 7 ** int(rng.integers(0, 6))).tolist()]
        scan, back, out = jxr_coefficients.Scan(range(16)), jxr_coefficients.Scan(range(16)), jxr.HighBitsWriter()
        pairs = scan.pairs(values, 0)
        if pairs:
            jxr_coefficients.Blocks().code(jxr_coefficients.Writer(out), seed % 2, pairs)
            got = jxr_coefficients.Blocks().code(jxr_coefficients.Reader(jxr.HighBits(out.bytes())), seed % 2, None)
            assert got == pairs and back.spread(got) == values and back.order == scan.order


@pytest.mark.parametrize("n", sorted(jxr_coefficients.WORDS))
def test_codes_are_whole(n):
    for words in jxr_coefficients.WORDS[n]:
        assert len(words) == n and sum(2.0 ** -len(w) for w in words) == 1 and len(set(words)) == n
    assert all(len(row) == n for row in jxr_coefficients.WEIGHTS.get(n, []))


def test_patterns_return():
    rng = np.random.default_rng(2)
    there, back = jxr_coefficients.Patterns(), jxr_coefficients.Patterns()
    for p, seed in zip(rng.integers(0, 65536, 400).tolist() + [0] * 50 + [65535] * 50, rng.integers(0, 2, 500).tolist(), strict=True):
        sent = there.differences(0, p, seed)
        assert back.pattern(0, sent, seed) == p
        there.count(0, p)
        back.count(0, p)


def test_broken_files_are_rows_with_errors():
    good = jxr_image.write(picture(3, np.uint8), Options(overlap=1))
    assert facade.decode(good)["error"] is None and facade.decode(good)["format"] == "jxr"
    rng = np.random.default_rng(3)
    for _ in range(150):
        bad = bytearray(good[: int(rng.integers(4, len(good)))] if rng.integers(0, 2) else good)
        bad[int(rng.integers(4, len(bad)))] = int(rng.integers(0, 256))
        facade.decode(bytes(bad))
    with pytest.raises(BadImage):
        jxr_image.write(np.zeros((4, 4, 2), np.uint8))


def test_shown_formats():
    for n, dtype in FORMATS:
        row = facade.decode(jxr_image.write(picture(n, dtype)))
        assert (row["error"] is None) == (np.dtype(dtype).kind != "i"), (n, dtype)
        assert row["error"] or row["channels"] == n
