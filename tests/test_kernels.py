"""Bit fields, headers, predictors, float integers and profiles."""

import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from rasterloom.functions import float_pixel
from rasterloom.sources import icc, jxl
from rasterloom.sources.raster import BadImage


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 32)), max_size=30))
def test_low_bits(fields):
    w = jxl.LowBitsWriter()
    for value, n in fields:
        w.put(value, n)
    r = jxl.LowBits(w.bytes())
    assert [r.take(n) for _, n in fields] == [v & (1 << n) - 1 for v, n in fields]


@pytest.mark.parametrize(("bits", "value"), [([(0, 2)], 0), ([(1, 2), (9, 4)], 10), ([(2, 2), (200, 8)], 217), ([(3, 2), (5, 12), (1, 1), (7, 8), (0, 1)], 5 | 7 << 12)])
def test_long_numbers(bits, value):
    w = jxl.LowBitsWriter()
    for v, n in bits:
        w.put(v, n)
    assert jxl.LowBits(w.bytes()).long() == value


@pytest.mark.parametrize(("fields", "expected"), [([(1, 1), (4, 5), (1, 3)], (40, 40)), ([(0, 1), (0, 2), (299, 9), (5, 3)], (533, 300)), ([(0, 1), (1, 2), (1000, 13), (0, 3), (0, 2), (6, 9)], (7, 1001))])
def test_size_header(fields, expected):
    w = jxl.LowBitsWriter()
    for v, n in fields:
        w.put(v, n)
    stream = jxl.CODESTREAM + w.bytes() + b"\0" * 8
    for data in (stream, jxl.container(stream), jxl.container(stream, 3)):
        assert jxl.codestream(data) == stream and jxl.size(data) == expected
    with pytest.raises(BadImage):
        jxl.codestream(b"other")


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (2, 2), (17, 23)])
def test_self_correcting_predictor(shape):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, shape)
    assert (jxl.restored(jxl.residuals(noise)) == noise).all()
    y, x = np.mgrid[: shape[0], : shape[1]]
    smooth = (3 * x + 2 * y + rng.integers(0, 2, shape)).astype(np.int64)
    assert np.abs(jxl.residuals(smooth)[1:, 1:]).sum() <= np.abs(smooth[1:, 1:]).sum()


@pytest.mark.parametrize(("bias", "bits"), [(127, 23), (127, 13), (15, 10), (4, 8)])
def test_float_integers(bias, bits):
    rng = np.random.default_rng(bits)
    values = np.concatenate([rng.normal(size=500), rng.normal(size=500) * 1e-3, [0.0, 1.0, -1.0, 0.5]]).astype(np.float32)
    once = float_pixel.to_integers(values, bias, bits)
    back = float_pixel.to_floats(once, bias, bits)
    assert (float_pixel.to_integers(back, bias, bits) == once).all()
    if (bias, bits) == (127, 23):
        assert (back == values).all()
    large = np.abs(values) > 2.0 ** (2 - bias) * 4
    assert np.allclose(back[large], values[large], rtol=2.0**-bits, atol=0)


def test_profile_gets_colour_points():
    body = b"desc\0\0\0\0text"
    profile = bytearray(128) + struct.pack(">I4sII", 1, b"desc", 144, len(body)) + body
    profile[:4] = struct.pack(">I", len(profile))
    profile[44:48] = b"flag"
    out = icc.with_cicp(bytes(profile), 9, 16, 0, True)
    assert len(out) == len(profile) + 24 and icc.cicp(out) == (9, 16, 0, True) and icc.cicp(bytes(profile)) is None
    at, n = struct.unpack_from(">II", out, 136)
    assert out[at : at + n] == body
    plain = bytearray(out)
    plain[44:48], plain[64:68], plain[84:100] = bytes(4), bytes(4), bytes(16)
    assert out[84:100] == hashlib.md5(plain).digest()
    with pytest.raises(BadImage):
        icc.with_cicp(bytes(profile)[:-1], 1, 1)
