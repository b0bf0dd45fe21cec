"""The lossless JPEG XL mode: entropy coding, trees, transforms, refusals; headers and parts of every format; the sink."""

import random
import struct

import numpy as np
import pytest

from rasterloom.sources import facade, jpeg, jxl, jxl_entropy, jxl_modular, parts, png, tiff
from rasterloom.sources.jxl import LowBits, LowBitsWriter
from rasterloom.sources.raster import BadImage

STREAMS = [[0], [5] * 10, [1, 0] * 20, list(range(300)), [2**31 - 1, 0, 7], []]


@pytest.mark.parametrize("values", STREAMS)
@pytest.mark.parametrize("contexts", [1, 6])
def test_streams_round_trip(values, contexts):
    out = LowBitsWriter()
    out.put(5, 3)
    jxl_entropy.write_stream(out, contexts, np.array(values, dtype=np.int64))
    out.put(21, 5)
    bits = LowBits(out.bytes())
    assert bits.take(3) == 5
    code = jxl_entropy.Code.read(bits, contexts)
    code.begin(bits)
    assert [code.next(bits, contexts - 1) for _ in values] == values
    code.finish()
    assert bits.take(5) == 21


def test_places_of_a_histogram_are_a_partition():
    rng = np.random.default_rng(1)
    for size in (32, 64, 256):
        for _ in range(20):
            n = int(rng.integers(1, size + 1))
            counts = jxl_entropy.to_counts(jxl_entropy.Counter(dict(enumerate(rng.integers(1, 1000, n).tolist()))), size)
            model = jxl_entropy.Ans.of(counts)
            assert sum(counts) == 4096 == len(set(zip(model.symbol, model.place, strict=True)))
            assert np.bincount(model.symbol, minlength=size).tolist() == counts
            out = LowBitsWriter()
            jxl_entropy.write_counts(out, counts)
            assert jxl_entropy.read_counts(LowBits(out.bytes()), size.bit_length() - 1) == counts


def test_even_and_short_histograms():
    out = LowBitsWriter()
    out.put(2, 2)
    jxl_entropy.put_small(out, 6)
    assert jxl_entropy.read_counts(LowBits(out.bytes()), 5)[:8] == [586] + [585] * 6 + [0]
    out = LowBitsWriter()
    out.put(1, 2)
    jxl_entropy.put_small(out, 40)
    with pytest.raises(BadImage):
        jxl_entropy.read_counts(LowBits(out.bytes()), 5)


def test_prefix_codes():
    # Canonical codes come highest bit first into fields that are lowest bit first.
    code = jxl_entropy.Prefix.of({7: 1, 3: 2, 9: 3, 4: 3})
    out = LowBitsWriter()
    for value, n in ((0b0, 1), (0b01, 2), (0b011, 3), (0b111, 3)):
        out.put(value, n)
    bits = LowBits(out.bytes())
    assert [code.next(bits) for _ in range(4)] == [7, 3, 4, 9]
    with pytest.raises(BadImage):
        jxl_entropy.Prefix.of({0: 1, 1: 2})
    out = LowBitsWriter()  # a simple code of four symbols, skewed
    out.put(1, 2)
    out.put(3, 2)
    for s in (5, 2, 0, 7):
        out.put(s, 3)
    out.put(1, 1)
    assert jxl_entropy.Prefix.read(LowBits(out.bytes()), 8).table == jxl_entropy.Prefix.of({5: 1, 2: 2, 0: 3, 7: 3}).table
    out = LowBitsWriter()  # lengths by a code of code lengths: 1 and 2 by one bit each
    out.put(0, 2)
    for name in jxl_entropy.LENGTH_ORDER[:2]:
        out.put(0b0111, 4)
        assert name in (1, 2)
    for n in (1, 2, 2):
        out.put(n - 1, 1)
    assert jxl_entropy.Prefix.read(LowBits(out.bytes()), 5).table == jxl_entropy.Prefix.of({0: 1, 1: 2, 2: 2}).table


def test_back_references():
    """A prefix-coded stream whose copies reach one row up and one place back."""
    code = jxl_entropy.Code([0, 0], [jxl_entropy.Hybrid(8)], [jxl_entropy.Prefix.of({s: 8 for s in range(256)})], False, (224, 3, jxl_entropy.Hybrid(0)))
    out = LowBitsWriter()
    put = lambda s: out.put(int(f"{s:08b}"[::-1], 2), 8)
    for s in (1, 2, 3, 4, 224, 0, 224, 1):
        put(s)
    bits = LowBits(out.bytes())
    got = [code.value(bits, 0, 4) for _ in range(10)]
    assert got == [1, 2, 3, 4, 1, 2, 3, 3, 3, 3]


def test_permutations_and_clusters():
    code = jxl_entropy.Code([0] * 8, [jxl_entropy.Hybrid(4)], [jxl_entropy.Prefix.of({s: 3 for s in range(8)})], False)
    out = LowBitsWriter()
    for s in (3, 2, 0, 1):
        out.put(int(f"{s:03b}"[::-1], 2), 3)
    assert jxl_entropy.read_permutation(LowBits(out.bytes()), code, 6, 1) == [0, 3, 1, 4, 2, 5]
    out = LowBitsWriter()
    out.put(1, 1)
    out.put(1, 2)
    out.put(0b101, 3)
    assert jxl_entropy.read_clusters(LowBits(out.bytes()), 3) == [1, 0, 1]
    with pytest.raises(BadImage):
        jxl_entropy.read_clusters(LowBits(bytes([0b11111111])), 3)


SHAPES = [(1, 1), (16, 16), (17, 13), (33, 40), (100, 60)]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float16, np.float32])
def test_lossless_round_trip(shape, n, kind):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[: shape[0], : shape[1]]
    smooth = np.stack([11 * x + 7 * y + 50 * c for c in range(n)], axis=2)
    for v in (smooth, smooth * 0 + 137, rng.integers(0, 65536, smooth.shape)):
        v = (v / 7 - 100).astype(kind) if np.dtype(kind).kind == "f" else v.astype(kind)
        for data in (jxl_modular.write(v), jxl.container(jxl_modular.write(v), 3)):
            got = facade.decode(data)
            assert got["error"] is None and (got["format"], got["width"], got["height"], got["channels"]) == ("jxl", shape[1], shape[0], n)
            held = np.frombuffer(got["pixels"], {"UInt8": "u1", "UInt16": "<u2", "Float32": "<f4"}[got["sample_format"]]).reshape(*shape, n)
            assert (held == (v.astype(np.float32) if v.dtype.kind == "f" else v)).all()
            assert parts.info(data) == ("jxl", shape[1], shape[0], n, got["sample_format"], None)


def test_damaged_files_are_refused():
    rng = random.Random(1)
    good = jxl_modular.write(np.arange(600, dtype=np.uint8).reshape(20, 30, 1))
    for _ in range(150):
        data = bytearray(good)
        data[rng.randrange(2, len(data))] ^= 1 << rng.randrange(8)
        row = facade.decode(bytes(data[: rng.randrange(3, len(data) + 1)]))
        assert row["error"] is None or row["pixels"] is None
    assert facade.decode(good[:12])["error"]
    for wrong in (np.zeros((4, 4, 2), np.uint8), np.zeros((1025, 1, 1), np.uint8)):
        with pytest.raises(BadImage):
            jxl_modular.write(wrong)


@pytest.mark.parametrize("kind", range(42))
def test_reversible_transforms(kind):
    rng = np.random.default_rng(kind)
    c = [rng.integers(-1000, 1000, (5, 6)) for _ in range(3)]
    assert all((a == b).all() for a, b in zip(jxl_modular.decorrelated_back(jxl_modular.decorrelated(c, kind), kind), c, strict=True))


def test_palettes():
    palette = np.array([[10, 20], [30, 40], [50, 60]])
    index = np.array([[0, 1, 2, 2 + 63, 2 + 64, 2 + 64 + 7]])
    got = np.stack(jxl_modular.looked_up(palette, index, 8))[:, 0].T.tolist()
    assert got[:2] == [[10, 30, 50], [20, 40, 60]]
    assert got[2] == [32, 32, 32] and got[3] == [3 * 255 // 4 + 32] * 3
    assert got[4] == [0, 0, 0] and got[5] == [2 * 255 // 4, 255 // 4, 0]
    shapes = [(4, 5)] * 3
    jxl_modular.Transform(1, 0, n=3, colors=7).reshape(shapes)
    assert shapes == [(3, 7), (4, 5)]
    with pytest.raises(BadImage):
        jxl_modular.Transform(0, 1).reshape(shapes)


def test_trees_choose_leaves():
    leaf = [jxl_modular.Leaf(i, 0, 0, 1) for i in range(3)]
    tree = jxl_modular.Tree(jxl_modular.Fork(3, 4, jxl_modular.Fork(2, 0, leaf[0], leaf[1]), leaf[2]), None)
    at = lambda y, x: tree.leaf({2: y, 3: x}.__getitem__).context
    assert (at(1, 5), at(0, 5), at(9, 4)) == (0, 1, 2)


@pytest.mark.parametrize("predictor", range(14))
def test_leaves_of_every_predictor(predictor):
    """Residuals of a plain computation by the predictor, coded by hand, give the samples back."""
    v = np.random.default_rng(predictor).integers(0, 200, (9, 11))
    if predictor == 6:
        d = jxl.residuals(v)
    else:
        d = np.zeros_like(v)
        for y in range(9):
            for x in range(11):
                n, nw, ne, w, nn = jxl._around(v, y, x)
                ww, nee = int(v[y, x - 2]) if x > 1 else w, int(v[y - 1, x + 2]) if y and x + 2 < 11 else ne
                d[y, x] = v[y, x] - jxl_modular.predicted(predictor, n, w, nw, ne, nn, ww, nee, 0)
    out = LowBitsWriter()
    jxl_entropy.write_stream(out, 6, np.array([0, predictor, 0, 0, 0]))
    jxl_entropy.write_stream(out, 1, np.where(d >= 0, 2 * d, -2 * d - 1).ravel())
    bits = LowBits(out.bytes())
    tree = jxl_modular.Tree.read(bits, 10)
    assert (jxl_modular.read_channels(bits, tree, [(9, 11)], jxl.Weights())[0] == v).all()


def test_parts_and_tags(spark):
    block = struct.pack("<4sI", b"II*\0", 8) + struct.pack("<HHHI4sI", 1, 0x0112, 3, 1, struct.pack("<HH", 6, 0), 0)
    body = b"Exif\0\0" + block
    photo = jpeg.encode(np.full((8, 8, 1), 9, np.uint8))
    photo = photo[:2] + struct.pack(">BBH", 0xFF, 0xE1, 2 + len(body)) + body + photo[2:]
    files = spark.createDataFrame([("a", bytearray(photo)), ("b", bytearray(png.write(np.zeros((3, 4, 3), np.uint8)))), ("c", bytearray(tiff.write([np.zeros((5, 6, 1), np.uint16)] * 2))), ("d", bytearray(b"nothing")), ("e", None)], "path string, content binary")
    found = {}
    for r in parts.listed(files).collect():
        found.setdefault(r.path, []).append((r.page, r.name))
    assert found["a"][0] == (0, "E1") and [n for _, n in found["b"]] == ["IHDR", "IDAT", "IEND"]
    assert {p for p, _ in found["c"]} == {0, 1} and "d" not in found and "e" not in found
    assert {(r.path, r.field, r.value) for r in parts.tagged(files).collect() if not r.field.startswith("tag")} == {("a", "orientation", "6")}
    rows = {r.path: r for r in parts.described(files).collect()}
    assert (rows["a"].width, rows["b"].channels, rows["c"].sample_format) == (8, 3, "UInt16")
    assert rows["d"].error == rows["e"].error == "no known format"


@pytest.mark.parametrize("kind", ["png", "jpeg", "tiff", "exr", "jxl"])
def test_sink(spark, tmp_path, kind):
    facade.register_source(spark)
    v = np.arange(8 * 9 * 3, dtype=np.uint8).reshape(8, 9, 3)
    rows = spark.createDataFrame([(f"i{k}", 9, 8, 3, "UInt8", bytearray(v.tobytes())) for k in range(5)], "name string, width int, height int, channels int, sample_format string, pixels binary")
    rows.write.format("raster").option("format", kind).mode("append").save(f"{tmp_path}/{kind}")
    back = spark.read.format("raster").load(f"{tmp_path}/{kind}").collect()
    assert len(back) == 5 and {(r.format, r.width, r.height, r.error) for r in back} == {(kind, 9, 8, None)}
    if kind in ("png", "jxl"):
        assert {bytes(r.pixels) for r in back} == {v.tobytes()}
