"""JPEG XL's lossy mode: colours, blocks, quantisers, contexts and whole files."""

import numpy as np
import pytest

from rasterloom.sources import facade, jxl_lossy, jxl_modular
from rasterloom.sources.jxl import LowBits, LowBitsWriter
from rasterloom.sources.jxl_entropy import Code, Plan
from rasterloom.sources.jxl_lossy import Quantizer
from rasterloom.sources.raster import BadImage


def picture(height, width, noise=2.0):
    y, x = np.mgrid[0:height, 0:width]
    v = np.stack([128 + 60 * np.sin(x / 15) + 40 * np.cos(y / 19), 100 + 50 * np.sin((x + y) / 31), 60 + x % 256 / 2], axis=2)
    return np.clip(v + np.random.default_rng(1).normal(0, noise, v.shape), 0, 255).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b) ** 2).mean()))


def test_colours_and_blocks_return():
    rng = np.random.default_rng(0)
    rgb = rng.random((3, 9, 7))
    assert np.allclose(jxl_lossy.from_xyb(jxl_lossy.to_xyb(rgb)), rgb, atol=1e-5)
    grey = jxl_lossy.to_xyb(np.full((3, 1, 1), 0.5))
    assert abs(grey[0]) < 1e-6 and grey[1] > 0
    v = rng.normal(0, 1, (3, 24, 16))
    assert np.allclose(jxl_lossy.planes_of(jxl_lossy.blocks_of(v)), v)
    assert np.allclose(jxl_lossy.blocks_of(np.full((1, 8, 8), 3.0))[0, 0, 0].ravel(), [3, *[0] * 63])


@pytest.mark.parametrize(("rows", "columns"), [(1, 1), (2, 2), (4, 4), (1, 2), (4, 2), (32, 16)])
def test_large_blocks(rows, columns):
    y, x = np.mgrid[0 : 8 * rows, 0 : 8 * columns]
    smooth = 5 + np.cos((y + 0.5) * np.pi / (8 * rows)) + 2 * np.cos((x + 0.5) * np.pi / (8 * columns))
    for v in (smooth, np.random.default_rng(6).normal(0, 1, smooth.shape)):
        coefficients, means = jxl_lossy.large_forward(v)
        bare = coefficients.copy()
        bare[:rows, :columns] = 0
        assert means.shape == (rows, columns) and np.allclose(jxl_lossy.large_inverse(bare, means), v)
    if rows * columns > 1:
        means = jxl_lossy.large_forward(smooth)[1]
        assert np.allclose(means, smooth.reshape(rows, 8, columns, 8).mean((1, 3)), atol=1e-9)


def test_lowest_frequencies_shrink():
    assert np.allclose(jxl_lossy._shrink(32)[[0, 1, 31]], [1, 0.9996047255830407, 0.6603391026591464])


def test_scan_and_tables():
    assert sorted(jxl_lossy.SCAN) == list(range(64)) and jxl_lossy.SCAN[:6] == [0, 8, 1, 2, 9, 16]
    assert len(jxl_lossy.BY_PLACE) == len(jxl_lossy.BY_LEFT) == 63
    assert max(2 * (jxl_lossy.BY_LEFT[left - 1] + jxl_lossy.BY_PLACE[place]) + 1 for place in range(63) for left in range(1, 64 - place)) < jxl_lossy.PLACE_CONTEXTS
    w = jxl_lossy.weights()
    assert np.isclose(w[0, 0, 0], 1 / 3150) and (np.diff(w[1, 0]) >= 0).all() and np.allclose(w, w.transpose(0, 2, 1))
    assert [jxl_lossy.global_scale_of(d) for d in (0, 0.3, 1.0, 6.0)] == [73728, 9080, 2025, 535] and 797 < jxl_lossy.global_scale_of(2.5) < 1019


@pytest.mark.parametrize(("height", "width"), [(1, 1), (8, 8), (64, 64), (70, 90), (300, 520)])
def test_files(height, width):
    v = picture(height, width)
    sizes = []
    for distance, least in ((0, 48), (1.0, 37), (3.0, 30)):
        data = jxl_lossy.write(v, distance)
        got = jxl_lossy.raster(data).samples
        assert got.shape == v.shape and psnr(got, v) > least
        sizes.append(len(data))
    assert sizes == sorted(sizes, reverse=True)
    assert jxl_modular.info(data).xyb and facade.decode(data)["error"] is None and facade.decode(data)["format"] == "jxl"


def test_several_groups_of_lowest_coefficients():
    v = np.zeros((16, 2100, 3), np.uint8)
    v[:, ::7] = 200
    v[:, 2048:, 1] = 90
    assert psnr(jxl_lossy.raster(jxl_lossy.write(v, 0)).samples, v) > 40


def test_quantisers():
    v = picture(40, 48)
    fine, coarse = (jxl_lossy.write(v, q=Quantizer(4096, 32, p), multiplier=m) for p, m in ((3, 60), (0, 8)))
    assert len(fine) > len(coarse) and psnr(jxl_lossy.raster(fine).samples, v) > psnr(jxl_lossy.raster(coarse).samples, v)
    q, m = Quantizer(), np.full((2, 3), 32)
    blocks = jxl_lossy.blocks_of(np.random.default_rng(4).random((3, 16, 24)))
    lows, highs = jxl_lossy.quantize(blocks, q, m)
    back = jxl_lossy.dequantize(lows, highs, q, m, np.zeros((2, 2, 3), int))
    for c in range(3):
        assert np.abs(back[c] - blocks[c]).max() < 1.2 * max(q.steps(m, c).max(), q.low_step(c))


def test_coefficients_return_by_any_contexts():
    rng = np.random.default_rng(5)
    highs = (rng.normal(0, 2, (3, 5, 7, 8, 8)) * (rng.random((3, 5, 7, 8, 8)) < 0.3)).astype(np.int64)
    highs[..., 0, 0] = 0
    highs[:, 2, 3] = 0
    values = jxl_lossy.values_of(highs)
    contexts = jxl_lossy.Contexts([k % 4 for k in range(3 * 13 * 2 * 3)], 4, [20], [[0, 3], [], []])
    multipliers, lows = rng.integers(1, 40, (5, 7)), rng.integers(-5, 6, (3, 5, 7))
    groups = contexts.of(multipliers, lows)
    assert groups.shape == (3, 5, 7) and groups.max() < 4
    at = (13 * 1 * 2 + int(multipliers[1, 2] > 20)) * 3 + int(lows[0, 1, 2] > 0) + int(lows[0, 1, 2] > 3)
    assert groups[1, 1, 2] == contexts.groups[at]
    out, plan, n = LowBitsWriter(), Plan([values]), (37 + 458) * 4
    plan.describe(out, n)
    plan.write(out, values)
    bits = LowBits(out.bytes())
    code = Code.read(bits, n)
    assert (jxl_lossy.read_values(bits, code, 0, contexts, groups) == highs).all()


def test_broken_files_are_rows_with_errors():
    good = jxl_lossy.write(picture(40, 40), 1.0)
    rng = np.random.default_rng(3)
    for _ in range(120):
        bad = bytearray(good[: int(rng.integers(4, len(good)))] if rng.integers(0, 2) else good)
        bad[int(rng.integers(2, len(bad)))] = int(rng.integers(0, 256))
        facade.decode(bytes(bad))
    for wrong in (np.zeros((4, 4, 3), np.uint16), np.zeros((4, 4, 1), np.uint8), np.zeros((0, 4, 3), np.uint8)):
        with pytest.raises(BadImage):
            jxl_lossy.write(wrong)
