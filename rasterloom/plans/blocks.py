"""Queries for block transforms, layouts and code tables, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks, integers, quantize
from ..operators import neighbours, rasters
from ..sources import jpeg
from .queries import _PLAIN, GRAD, ORACLES, QUERIES, VECTORS, longs, query, rgbk, rounded

__all__ = ["ORACLES", "QUERIES"]


@query(f"""WITH {VECTORS}, w AS (SELECT k, i, CASE WHEN k = 0 THEN 1.0 ELSE sqrt(2) END / 8 * cos((2 * i + 1) * k * pi() / 16) AS c FROM range(8) a(k), range(8) b(i)),
    h AS (SELECT v.y, v.x // 8 AS r, w.k, sum(v.s * w.c) AS s FROM v JOIN w ON w.i = v.x % 8 WHERE v.n = 64 GROUP BY 1, 2, 3)
    SELECT h.y, 8 * w.k + h.k AS place, round(sum(h.s * w.c) + 0.00001, 3) + 0.0 AS coefficient FROM h JOIN w ON w.i = h.r GROUP BY 1, 2""")
def jxl_dct8_forward(spark, sf_dir):
    """Each embedding as an 8 by 8 block through the forward transform."""
    v = rasters.vectors(spark, sf_dir).where(F.size("samples") == 64)
    out = v.select("y", F.posexplode(blocks.forward_dct(F.transform("samples", lambda s: s.cast("double")), 8)).alias("place", "c"))
    return out.select("y", *longs(place=F.col("place")), (F.round(F.col("c") + 0.00001, 3) + 0.0).alias("coefficient"))


@query(f"""WITH {_PLAIN}, q AS (SELECT y AS row_id, r + k AS a, g - b AS b, ((r + k) - (g - b)) >> 1 AS t, b AS c, k AS d, r, g FROM p)
    SELECT row_id, a - (t - c) AS a, b + (t - d) AS b, t - d AS c, t - c AS d, r AS a0, g AS b0, c AS c0, d AS d0 FROM q""")
def jxr_core_2x2(spark, sf_dir):
    """The two-by-two core, and again for its inputs."""
    r, g, b, k = rgbk()
    px = rasters.plain_items(spark, sf_dir)
    once = px.select(F.col("y").alias("row_id"), *longs(**dict(zip("abcd", blocks.core_2x2(r, g, b, k), strict=True))))
    back = blocks.core_2x2(*(F.col(c) for c in "abcd"))
    return once.select("row_id", "a", "b", "c", "d", *longs(**{f"{n}0": c for n, c in zip("abcd", back, strict=True)}))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r, g, g - ((r + 2) >> 2) AS b1 FROM p), s AS (SELECT *, r - ((b1 + 1) >> 1) AS a1 FROM q), t AS (SELECT *, a1 - (b1 >> 5) - (b1 >> 9) - (b1 >> 13) AS a2 FROM s)
    SELECT y, a2 AS a, b1 - ((a2 + 2) >> 2) AS b, r AS a0, g AS b0 FROM t""")
def jxr_overlap_pair(spark, sf_dir):
    """The boundary pre-filter and its inverse."""
    r, g = F.col("r"), F.col("g")
    a, b = blocks.overlap_pair(r, g)
    px = rasters.plain_items(spark, sf_dir).select("y", *longs(a=a, b=b))
    a0, b0 = blocks.overlap_pair_inverse(F.col("a"), F.col("b"))
    return px.select("y", "a", "b", *longs(a0=a0, b0=b0))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r * 200 AS a, g * 257 AS b FROM p), n AS (SELECT *, CASE WHEN a > 32767 THEN a - 65536 ELSE a END AS sa, CASE WHEN b > 32767 THEN b - 65536 ELSE b END AS sb, (a + 32768) % 65536 AS o FROM q)
    SELECT y, (((sa + sb) >> 1) + 65536) % 65536 AS narrow_mean, (sa - sb + 131072) % 65536 AS narrow_difference,
    CASE WHEN o < b THEN (((o + b) >> 1) + 32768) % 65536 ELSE (o + b) >> 1 END AS wide_mean, (o - b + 65536) % 65536 AS wide_difference FROM n""")
def piz_wavelet_pair(spark, sf_dir):
    a, b = F.col("r") * 200, F.col("g") * 257
    narrow, wide = blocks.wavelet_pair(a, b, True), blocks.wavelet_pair(a, b, False)
    return rasters.plain_items(spark, sf_dir).select("y", *longs(narrow_mean=narrow[0], narrow_difference=narrow[1], wide_mean=wide[0], wide_difference=wide[1]))


@query("""SELECT l_orderkey AS y, CASE WHEN (l_partkey * 37) % 65536 >= 32768 THEN -((l_partkey * 37) % 32768) ELSE (l_partkey * 37) % 32768 END AS pixel,
    CASE WHEN (l_partkey * 37) % 65536 = 32768 THEN 0 ELSE (l_partkey * 37) % 65536 END AS bits FROM lineitem""")
def jxr_half_pixel(spark, sf_dir):
    """Half bits as signed integers and back; a negative zero comes back as zero."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    px = rows.select(F.col("l_orderkey").alias("y"), *longs(pixel=blocks.half_to_integer((F.col("l_partkey") * 37) % 65536)))
    return px.select("y", "pixel", *longs(bits=blocks.integer_to_half(F.col("pixel"))))


@query(f"""WITH {_PLAIN} SELECT y AS row_id, round(g - (0.0 + (k - 4) / 84.0) * r, 6) + 0.0 AS x, round(b - (1.0 + (k - 2) / 84.0) * r, 6) + 0.0 AS b, round(CAST(g AS DOUBLE), 4) AS x0, round(CAST(b AS DOUBLE), 4) AS b0 FROM p""")
def jxl_chroma_from_luma(spark, sf_dir):
    """Chroma less its share of the luma, and restored."""
    r, g, b, k = rgbk()
    kx, kb = blocks.correlation(k - 4, 0.0, 84), blocks.correlation(k - 2, 1.0, 84)
    px = rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), (g - kx * r).alias("x"), (b - kb * r).alias("c"), (kx * r).alias("sx"), (kb * r).alias("sb"))
    return px.select("row_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("c", 6) + 0.0).alias("b"), (F.round(F.col("x") + F.col("sx"), 4) + 0.0).alias("x0"), (F.round(F.col("c") + F.col("sb"), 4) + 0.0).alias("b0"))


@query("""SELECT p_partkey AS id, (p_size + 1) // 2 AS half, (p_size + 3) // 4 AS quarter, (p_size + 7) // 8 AS eighth, bit_count(p_size) AS ones FROM part""")
def scaled_sizes(spark, sf_dir):
    """Sizes of scaled decodes, rounded up, and the number of set bits."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    return parts.select(F.col("p_partkey").alias("id"), *longs(half=F.ceil(size / 2), quarter=F.ceil(size / 4), eighth=F.ceil(size / 8), ones=F.bit_count(size)))


@query("""WITH m AS (SELECT x, y, x // 7 AS tx, y // 5 AS ty FROM range(23) a(x), range(11) b(y))
    SELECT x, y, least(tx, 2) AS tile_x, least(ty, 1) AS tile_y, (x IN (0, 7, 14)) AS left_edge, (y IN (0, 5)) AS top_edge FROM m""")
def jxr_tile_masks(spark, sf_dir):
    """Tiles of 3 by 2 over 23 by 11 macroblocks, the last of each taking the rest, and the blocks on their left and upper edges."""
    at = spark.range(23 * 11).select((F.col("id") % 23).alias("x"), F.floor(F.col("id") / 23).alias("y"))
    tiles = at.select("x", "y", *longs(tile_x=F.least(F.floor(F.col("x") / 7), F.lit(2)), tile_y=F.least(F.floor(F.col("y") / 5), F.lit(1))))
    first = lambda c, t: F.col(c) == F.min(c).over(Window.partitionBy(t))
    return tiles.withColumn("left_edge", first("x", "tile_x")).withColumn("top_edge", first("y", "tile_y"))


_SHAPES = [(8, 8), (16, 16), (32, 32), (16, 8), (32, 8), (32, 16)]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(_SHAPES))}) t(shape, w, h)),
    c AS (SELECT shape, w, h, x, y, x < w // 8 AND y < h // 8 AS low, y * (w // h) AS gy FROM s, range(32) a(x), range(32) b(y) WHERE x < w AND y < h)
    SELECT shape, row_number() OVER (PARTITION BY shape ORDER BY CASE WHEN low THEN 0 ELSE 1 END, CASE WHEN low THEN y ELSE x + gy + 1 END, CASE WHEN low OR (x + gy + 1) % 2 = 1 THEN x ELSE gy END) - 1 AS place, x, y FROM c""")
def jxl_natural_order(spark, sf_dir):
    """Scan order of the coefficients of six block shapes: the low ones by row, then diagonals in alternate directions."""
    shapes = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(_SHAPES)], "shape int, w int, h int")
    cells = shapes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)))
    at = cells.select("shape", "w", "h", (F.col("cell") % F.col("w")).alias("x"), F.floor(F.col("cell") / F.col("w")).cast("int").alias("y"))
    low = (F.col("x") < F.col("w") / 8) & (F.col("y") < F.col("h") / 8)
    grid = F.col("y") * (F.col("w") / F.col("h")).cast("int")
    diagonal = F.col("x") + grid + 1
    order = [(~low).cast("int"), F.when(low, F.col("y")).otherwise(diagonal), F.when(low | (diagonal % 2 == 1), F.col("x")).otherwise(grid)]
    place = F.row_number().over(Window.partitionBy("shape").orderBy(*order)) - 1
    return at.select(*longs(shape=F.col("shape"), place=place, x=F.col("x"), y=F.col("y")))


@query("""SELECT i AS hf_mul, round(65536.0 / (i * 2025) * pow(0.8, 1), 8) AS hf_scale, round(0.25 * 512 / (2025.0 * i), 8) AS lf_scale FROM range(1, 257) t(i)""")
def jxl_scales(spark, sf_dir):
    """High- and low-frequency steps for each multiplier at one global scale."""
    m = spark.range(1, 257).select(F.col("id").alias("hf_mul"))
    return m.select("hf_mul", F.round(65536.0 / (F.col("hf_mul") * 2025) * math.pow(0.8, 1), 8).alias("hf_scale"), F.round(0.25 * 512 / (2025.0 * F.col("hf_mul")), 8).alias("lf_scale"))


_BANDS = [2560.0, 2560.0 / 1.8, 2560.0 / 1.8 / 1.6, 2560.0 / 1.8 / 1.6 / 1.4]


@query(f"""WITH b AS (SELECT [{", ".join(map(repr, _BANDS))}] AS bands), c AS (SELECT x, y, sqrt((x / 7.0) * (x / 7.0) + (y / 7.0) * (y / 7.0)) * 3 / (sqrt(2) + 1e-6) AS p FROM range(8) s(x), range(8) t(y))
    SELECT x, y, round(bands[CAST(floor(p) AS INT) + 1] * pow(bands[CAST(floor(p) AS INT) + 2] / bands[CAST(floor(p) AS INT) + 1], p - floor(p)), 4) AS weight FROM c, b""")
def jxl_quant_weights(spark, sf_dir):
    """Weights of an 8 by 8 block from bands along the distance to the mean, geometric between them."""
    at = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    bands = F.array(*map(F.lit, _BANDS))
    p = F.sqrt(F.pow(F.col("x") / 7.0, F.lit(2.0)) + F.pow(F.col("y") / 7.0, F.lit(2.0))) * 3 / (math.sqrt(2) + 1e-6)
    at = at.withColumn("p", p).withColumn("i", F.floor("p").cast("int"))
    low, high = F.get(bands, F.col("i")), F.get(bands, F.col("i") + 1)
    return at.select("x", "y", F.round(low * F.pow(high / low, F.col("p") - F.col("i")), 4).alias("weight"))


@query("""SELECT i AS idx, CASE WHEN i < 64 THEN (i % 4) * 255 // 4 + 32 ELSE ((i - 64) % 5) * 255 // 4 END AS r, CASE WHEN i < 64 THEN ((i >> 2) % 4) * 255 // 4 + 32 ELSE ((i - 64) // 5 % 5) * 255 // 4 END AS g,
    CASE WHEN i < 64 THEN ((i >> 4) % 4) * 255 // 4 + 32 ELSE ((i - 64) // 25 % 5) * 255 // 4 END AS b FROM range(189) t(i)""")
def jxl_synthetic_palette(spark, sf_dir):
    """Colours of the indexes beyond a palette."""
    at = spark.range(189).select(F.col("id").alias("idx"))
    return at.select("idx", *longs(**{n: blocks.synthetic_colour(F.col("idx"), c, 8) for c, n in enumerate("rgb")}))


@query("""SELECT i AS step, round(greatest(0, least(1, (log2(i / 8.0) - log2(1.0)) / (log2(4.0) - log2(1.0)))), 6) AS weight FROM range(1, 65) t(i)""")
def gainmap_weight(spark, sf_dir):
    """Share of the gain shown at headrooms of 1/8 to 8 for a capacity of 1 to 4."""
    at = spark.range(1, 65).select(F.col("id").alias("step"))
    return at.select("step", *rounded(weight=integers.clamp(F.log2(F.col("step") / 8.0) / 2.0, F.lit(0.0), F.lit(1.0))))


def _code_rows() -> list[tuple[int, int, int]]:
    counts, symbols = jpeg.AC_LUMA
    sizes = [n for n, c in enumerate(counts, 1) for _ in range(c)]
    return [(i, s, n) for i, (s, n) in enumerate(zip(symbols, sizes, strict=True))]


@query(f"""WITH t AS (SELECT * FROM (VALUES {", ".join(map(str, _code_rows()))}) v(i, symbol, size))
    SELECT symbol, size, CAST(coalesce(sum(pow(2, -size)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2, size) AS BIGINT) AS code FROM t""")
def jpeg_canonical_codes(spark, sf_dir):
    """Canonical codes of a table of 162 symbols: each is the share of the code space that the earlier ones take."""
    t = spark.createDataFrame(_code_rows(), "i int, symbol int, size int")
    before = F.sum(F.pow(F.lit(2.0), -F.col("size"))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return t.select(*longs(symbol=F.col("symbol"), size=F.col("size"), code=F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(2.0), F.col("size"))))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r - g AS v FROM p) SELECT y, v, CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END AS size,
    CASE WHEN v > 0 THEN v WHEN v = 0 THEN 0 ELSE v - 1 + (1 << length(bin(abs(v)))) END AS code FROM q""")
def jpeg_magnitude_bits(spark, sf_dir):
    """Size category and value bits of a difference."""
    px = rasters.plain_items(spark, sf_dir).select("y", (F.col("r") - F.col("g")).alias("v"))
    v, size = F.col("v"), integers.bit_length(F.abs(F.col("v")))
    return px.select("y", "v", *longs(size=size, code=F.when(v >= 0, v).otherwise(v - 1 + F.pow(F.lit(2.0), size))))


@query(f"""WITH {GRAD}, j AS (SELECT y, x, b AS v, lag(b, 128) OVER o AS up, CASE WHEN x > 0 THEN lag(b) OVER o END AS lf, CASE WHEN x > 0 THEN lag(b, 129) OVER o END AS upl FROM px WINDOW o AS (ORDER BY y, x)),
    n AS (SELECT y, x, v, coalesce(up, lf, 0) AS n, coalesce(lf, up, 0) AS w, coalesce(upl, up, lf, 0) AS nw FROM j), e AS (SELECT y, x, v - greatest(least(w, n), least(greatest(w, n), n + w - nw)) AS d FROM n)
    SELECT y, x, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS packed FROM e""")
def jxl_sample_stream(spark, sf_dir):
    """Zigzag codes of samples less their clamped gradient, in raster order."""
    px = neighbours.modular_neighbours(rasters.gradient_raster(spark), "b", 128)
    d = F.col("v") - integers.gradient(F.col("n"), F.col("w"), F.col("nw"))
    return px.select("y", "x", *longs(packed=integers.pack_signed(d)))


@query("""SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1), (3, 16), (4, 32), (5, 16), (6, 32), (7, 32), (8, 32), (9, 256)) t(compression, lines)""")
def exr_block_lines(spark, sf_dir):
    """Scan lines of a block by compression code, as a native choice."""
    c = F.col("compression")
    lines = F.when(c <= 2, 1).when(c.isin(3, 5), 16).when(c == 9, 256).otherwise(32)
    return spark.range(10).select(F.col("id").alias("compression")).select("compression", *longs(lines=lines))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r - g AS v FROM p) SELECT y, v, CASE WHEN v < 0 THEN -(((-v + 7) * 2863311531) >> 36) ELSE ((v + 7) * 2863311531) >> 36 END AS q FROM q""")
def jxr_quant_reciprocal(spark, sf_dir):
    """Division by a step of 24 as a multiplication by its reciprocal."""
    px = rasters.plain_items(spark, sf_dir).select("y", (F.col("r") - F.col("g")).alias("v"))
    return px.select("y", "v", *longs(q=quantize.reciprocal_quantize(F.col("v"), F.lit(7), 24)))
