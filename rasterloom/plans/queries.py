"""Queries over the derived rasters, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, integers, quantize
from ..operators import neighbours, rasters, samples, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The derived rasters in SQL.
ITEM = """px AS (SELECT l_orderkey AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS x, l_partkey % 256 AS r, l_suppkey % 256 AS g,
    (CAST(l_quantity AS BIGINT) * 5) % 256 AS b, CAST(l_linenumber AS BIGINT) AS k FROM lineitem)"""
GRAD = """px AS (SELECT y, x, (3 * x + 2 * y) & 255 AS r, (128 + x - y) & 255 AS g, (x + 3 * y) & 255 AS b
    FROM range(96) a(y), range(128) c(x))"""
VECTORS = """v AS (SELECT vec_id AS y, i - 1 AS x, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000 + 0.5) AS BIGINT) AS s, len(embedding) AS n
    FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding))"""
BYTES = """h AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS s, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS i
    FROM documents WHERE text IS NOT NULL),
  bytes AS (SELECT doc_id, i, CAST(('0x' || s) AS BIGINT) AS v FROM h)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def longs(**columns: Column) -> list[Column]:
    return [c.cast("long").alias(n) for n, c in columns.items()]


def rounded(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read and do not repeat: a generator of one row keeps them apart."""
    out = df.withColumn("_settled", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return out.select(*df.columns, "_settled.*")


def rgbk() -> list[Column]:
    return [F.col(c) for c in "rgbk"]


@query("SELECT l_orderkey AS y, l_partkey % 256 AS r, l_suppkey % 256 AS g, (CAST(l_quantity AS BIGINT) * 5) % 256 AS b, 255 AS a, l_partkey % 256 AS gray, l_linenumber AS gray_alpha FROM lineitem")
def expand_u8_rgba(spark, sf_dir):
    r, g, b, k = rgbk()
    px = rasters.plain_items(spark, sf_dir)
    rgb, gray = color.expand_rgba8([r, g, b], 8), color.expand_rgba8([r, k], 8)
    return px.select("y", *longs(r=rgb["r"], g=rgb["g"], b=rgb["b"], a=rgb["a"], gray=gray["g"], gray_alpha=gray["a"]))


@query("SELECT l_orderkey AS y, ((l_partkey % 65536) * 7 % 65536) >> 8 AS r, ((l_suppkey * 257) % 65536) >> 8 AS g, (CAST(l_quantity AS BIGINT) * 1285) >> 8 AS b, 255 AS a FROM lineitem")
def expand_u16_rgba8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = [(F.col("l_partkey") % 65536) * 7 % 65536, (F.col("l_suppkey") * 257) % 65536, F.col("l_quantity").cast("long") * 1285]
    return rows.select(F.col("l_orderkey").alias("y"), *longs(**color.expand_rgba8(wide, 16)))


@query("""SELECT l_orderkey AS y, round(CAST(CAST((l_partkey % 256) / 255.0 AS FLOAT) AS DOUBLE), 6) AS r, round(CAST(CAST((l_suppkey % 256) / 255.0 AS FLOAT) AS DOUBLE), 6) AS g,
    round(CAST(CAST(((CAST(l_quantity AS BIGINT) * 5) % 256) / 255.0 AS FLOAT) AS DOUBLE), 6) AS b, 1.0 AS a FROM lineitem""")
def expand_u8_float(spark, sf_dir):
    r, g, b, _ = rgbk()
    unit = color.expand_float([r, g, b], 8)
    return rasters.plain_items(spark, sf_dir).select("y", *rounded(**{n: c.cast("double") for n, c in unit.items()}))


@query("""SELECT l_orderkey AS y, round(CAST(CAST(((l_partkey * 13) % 65536) / 65535.0 AS FLOAT) AS DOUBLE), 6) AS r FROM lineitem""")
def expand_u16_float(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    unit = color.expand_float([(F.col("l_partkey") * 13) % 65536], 16)
    return rows.select(F.col("l_orderkey").alias("y"), *rounded(r=unit["r"].cast("double")))


_PLAIN = "p AS (SELECT l_orderkey AS y, l_partkey % 256 AS r, l_suppkey % 256 AS g, (CAST(l_quantity AS BIGINT) * 5) % 256 AS b, CAST(l_linenumber AS BIGINT) AS k FROM lineitem)"


@query(f"""WITH {_PLAIN}, q AS (SELECT *, b - r AS v FROM p), s AS (SELECT *, r + ((v + 1) >> 1) - g AS u FROM q)
    SELECT y AS row_id, u, g + (u >> 1) AS y, v FROM s""")
def ycocg_forward(spark, sf_dir):
    r, g, b, _ = rgbk()
    return rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), *longs(**color.lifted_forward(r, g, b)))


@query(f"WITH {_PLAIN} SELECT y AS row_id, r, g, b FROM p")
def ycocg_inverse(spark, sf_dir):
    """Inverse of the forward lifting: the pixels themselves."""
    r, g, b, _ = rgbk()
    lifted = rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), *longs(**color.lifted_forward(r, g, b)))
    return lifted.select("row_id", *longs(**color.lifted_inverse(F.col("u"), F.col("y"), F.col("v"))))


@query(f"""WITH {_PLAIN}, q AS (SELECT *, b - r AS y1 FROM p), s AS (SELECT *, r + ((y1 + 1) >> 1) - g AS c1 FROM q), t AS (SELECT *, g + (c1 >> 1) - k AS m1 FROM s)
    SELECT y AS row_id, c1 AS c, m1 AS m, y1 AS y, k + ((m1 + 1) >> 1) AS k, r AS c0, g AS m0, b AS y0, k AS k0 FROM t""")
def cmyk_lift(spark, sf_dir):
    r, g, b, k = rgbk()
    px = rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), *longs(**color.cmyk_forward(r, g, b, k)))
    back = color.cmyk_inverse(*(F.col(c) for c in "cmyk"))
    return px.select("row_id", "c", "m", "y", "k", *longs(**{f"{n}0": c for n, c in back.items()}))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r * 1048576 + 524288 AS f, g - 128 AS cb, b - 128 AS cr FROM p)
    SELECT y AS row_id, greatest(0, least(255, (f + cr * 1470208) >> 20)) AS r, greatest(0, least(255, (f - cr * 748800 + ((cb * -360960) & -65536)) >> 20)) AS g,
    greatest(0, least(255, (f + cb * 1858048) >> 20)) AS b FROM q""")
def ycbcr_to_rgb_fixed(spark, sf_dir):
    r, g, b, _ = rgbk()
    return rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), *longs(**color.ycbcr_to_rgb(r, g, b)))


@query(f"WITH {_PLAIN} SELECT y AS row_id, ((r * g + 128) + ((r * g + 128) >> 8)) >> 8 AS product FROM p")
def blinn_mul(spark, sf_dir):
    r, g = F.col("r"), F.col("g")
    return rasters.plain_items(spark, sf_dir).select(F.col("y").alias("row_id"), *longs(product=color.byte_product(r, g)))


@query(f"""WITH {_PLAIN}, t AS (SELECT p.*, kind, kind // 7 AS o, kind % 7 AS f FROM p, range(42) k(kind)),
    s AS (SELECT *, CASE o WHEN 1 THEN g WHEN 2 THEN b WHEN 4 THEN g WHEN 5 THEN b ELSE r END AS d,
        CASE o WHEN 1 THEN b WHEN 2 THEN r WHEN 3 THEN b WHEN 4 THEN r ELSE g END AS e,
        CASE o WHEN 1 THEN r WHEN 2 THEN g WHEN 3 THEN g WHEN 5 THEN r ELSE b END AS h FROM t),
    u AS (SELECT *, h + ((d - h) >> 1) AS m FROM s),
    w AS (SELECT *, CASE WHEN f = 6 THEN m + ((e - m) >> 1) ELSE d END AS c0,
        CASE WHEN f = 6 THEN d - h WHEN f // 2 = 1 THEN e - d WHEN f // 2 = 2 THEN e - ((d + h) >> 1) ELSE e END AS c1,
        CASE WHEN f = 6 THEN e - m WHEN f % 2 = 1 THEN h - d ELSE h END AS c2 FROM u)
    SELECT kind, CAST(sum(c0) AS BIGINT) AS c0, CAST(sum(c1) AS BIGINT) AS c1, CAST(sum(c2) AS BIGINT) AS c2,
        CAST(sum(c0 * 31 + c1 * 17 + c2 * (k + 3)) AS BIGINT) AS mixed, CAST(0 AS BIGINT) AS not_restored FROM w GROUP BY kind""")
def rct_all_types(spark, sf_dir):
    """All 42 reversible transforms: sums of the residuals, and pixels that the inverse does not restore."""
    r, g, b, k = rgbk()
    px = rasters.plain_items(spark, sf_dir).withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(5))))
    px = settled(px, **dict(zip("def", color.in_decoded_order(F.col("order"), [r, g, b]), strict=True)))
    px = px.withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(6))))
    px = settled(px, **dict(zip(("c0", "c1", "c2"), color.reversible_residuals(F.col("form"), F.col("d"), F.col("e"), F.col("f")), strict=True)))
    c = [F.col(f"c{i}") for i in range(3)]
    px = settled(px, **dict(zip(("d0", "e0", "f0"), color.reversible_decoded(F.col("form"), *c), strict=True)))
    back = color.in_shown_order(F.col("order"), [F.col(n) for n in ("d0", "e0", "f0")])
    lost = F.sum(((back[0] != r) | (back[1] != g) | (back[2] != b)).cast("long"))
    kind = (F.col("order") * 7 + F.col("form")).cast("long").alias("kind")
    return px.groupBy(kind).agg(*longs(c0=F.sum(c[0]), c1=F.sum(c[1]), c2=F.sum(c[2]), mixed=F.sum(c[0] * 31 + c[1] * 17 + c[2] * (k + 3)), not_restored=lost))


@query(f"WITH {GRAD} SELECT y, x, CASE WHEN r - g >= 0 THEN 2 * (r - g) ELSE -2 * (r - g) - 1 END AS packed, r - g AS unpacked FROM px")
def zigzag_pack(spark, sf_dir):
    r, g = F.col("r"), F.col("g")
    px = rasters.gradient_raster(spark).withColumn("packed", integers.pack_signed(r - g))
    return px.select(*longs(y=F.col("y"), x=F.col("x"), packed=F.col("packed"), unpacked=integers.unpack_signed(F.col("packed"))))


@query("""WITH p AS (SELECT l_orderkey AS y, l_partkey AS v FROM lineitem), q AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) - 1 END AS n FROM p)
    SELECT y, v, CASE WHEN v < 16 THEN v ELSE 16 + (n - 4) * 8 + ((v >> (n - 2)) & 3) * 2 + (v & 1) END AS token,
    CASE WHEN v < 16 THEN 0 ELSE (v >> 1) & ((1 << (n - 3)) - 1) END AS rest, CASE WHEN v < 16 THEN 0 ELSE n - 3 END AS rest_bits FROM q""")
def hybrid_uint_token(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("y"), F.col("l_partkey").alias("v"))
    return rows.select("y", "v", *longs(**integers.hybrid_token(F.col("v"), 4, 2, 1)))


@query("""SELECT l_orderkey AS y, CASE WHEN l_partkey = 0 THEN 0 ELSE length(bin(l_partkey)) END AS bits FROM lineitem""")
def bit_length_ceil(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("y"), *longs(bits=integers.bit_length(F.col("l_partkey"))))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r / 255.0 AS e FROM p), s AS (SELECT y, e, CASE WHEN e <= 0.04045 THEN e / 12.92 ELSE pow((e + 0.055) / 1.055, 2.4) END AS l FROM q)
    SELECT y, round(l, 6) AS linear, round(CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END, 6) AS encoded FROM s""")
def srgb_eotf(spark, sf_dir):
    r = F.col("r")
    px = rasters.plain_items(spark, sf_dir).select("y", color.srgb_to_linear(r / 255.0).alias("l"))
    return px.select("y", *rounded(linear=F.col("l"), encoded=color.linear_to_srgb(F.col("l"))))


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM p),
    s AS (SELECT y, cbrt(0.30 * r + 0.622 * g + 0.078 * b + 0.0037930732552754493) AS l, cbrt(0.23 * r + 0.692 * g + 0.078 * b + 0.0037930732552754493) AS m,
        cbrt(0.24342268924547819 * r + 0.20476744424496821 * g + 0.55180986650955362 * b + 0.0037930732552754493) AS n, cbrt(-0.0037930732552754493) AS o FROM q)
    SELECT y AS row_id, round((l - m) * 0.5, 6) + 0.0 AS x, round((l + m) * 0.5 + o, 6) AS y, round(n + o, 6) AS b FROM s""")
def xyb_forward(spark, sf_dir):
    r, g, b, _ = rgbk()
    px = rasters.plain_items(spark, sf_dir)
    xyb = color.linear_to_xyb(r / 255.0, g / 255.0, b / 255.0)
    return px.select(F.col("y").alias("row_id"), (F.round(xyb["x"], 6) + 0.0).alias("x"), *rounded(y=xyb["y"], b=xyb["b"]))


@query(f"WITH {_PLAIN} SELECT y AS row_id, round(r / 255.0, 4) AS r, round(g / 255.0, 4) AS g, round(b / 255.0, 4) AS b FROM p")
def xyb_inverse(spark, sf_dir):
    """Linear light through XYB and back."""
    r, g, b, _ = rgbk()
    px = rasters.plain_items(spark, sf_dir)
    xyb = color.linear_to_xyb(r / 255.0, g / 255.0, b / 255.0)
    back = color.xyb_to_linear(xyb["x"], xyb["y"], xyb["b"])
    return px.select(F.col("y").alias("row_id"), *(F.abs(F.round(c, 4)).alias(n) for n, c in back.items()))


@query("""WITH q AS (SELECT i, scaled FROM range(256) a(i), range(2) s(scaled)),
    m AS (SELECT i, scaled, CASE WHEN scaled = 1 THEN CASE WHEN i < 16 THEN i ELSE 16 + i % 16 END
            WHEN i < 32 THEN (i + 3) // 4 WHEN i < 48 THEN (17 + i % 16) // 2 ELSE 16 + i % 16 END AS man,
        CASE WHEN scaled = 1 THEN CASE WHEN i < 16 THEN 1 ELSE i // 16 END WHEN i < 32 THEN 0 WHEN i < 48 THEN i // 16 - 2 ELSE i // 16 - 3 END AS e FROM q)
    SELECT i AS idx, scaled, CASE WHEN i = 0 THEN 1 ELSE man << e END AS step, CASE WHEN i = 0 THEN 0 ELSE man END AS mantissa,
        CASE WHEN i = 0 THEN 0 ELSE ((man << e) * 3 + 1) >> 3 END AS rounding FROM m""")
def jxr_qp_table(spark, sf_dir):
    idx = spark.range(256).select(F.col("id").alias("idx"))
    parts = []
    for scaled in (0, 1):
        q = quantize.qp_step(F.col("idx"), bool(scaled))
        parts.append(idx.select("idx", *longs(scaled=F.lit(scaled), step=q["step"], mantissa=q["mantissa"], rounding=q["offset"])))
    return parts[0].union(parts[1])


@query(f"""WITH {_PLAIN}, q AS (SELECT y, r - g AS v FROM p)
    SELECT y, v, CASE WHEN v < 0 THEN -((-v + 3) >> 3) ELSE (v + 3) >> 3 END AS q, (CASE WHEN v < 0 THEN -((-v + 3) >> 3) ELSE (v + 3) >> 3 END) * 8 AS restored FROM q""")
def jxr_quant_mulless(spark, sf_dir):
    r, g = F.col("r"), F.col("g")
    px = rasters.plain_items(spark, sf_dir).select("y", (r - g).alias("v")).withColumn("q", quantize.shift_quantize(F.col("v"), F.lit(3), 3))
    return px.select("y", "v", *longs(q=F.col("q"), restored=F.col("q") * 8))


@query(f"""WITH {VECTORS}, q AS (SELECT y, x, round_even(s / (12.5 * 3.0), 0) AS q FROM v)
    SELECT y, x, CAST(q AS BIGINT) AS q, round(CASE WHEN abs(q) <= 1 THEN q * (1 - 0.07005449891748593) ELSE q - 0.145 / q END * 37.5, 6) + 0.0 AS restored FROM q""")
def jxl_quantize_hf(spark, sf_dir):
    v = rasters.vectors(spark, sf_dir).select("y", F.posexplode("samples").alias("x", "s"))
    q = v.select("y", F.col("x").cast("long"), quantize.quantize_even(F.col("s"), F.lit(12.5), F.lit(3.0)).alias("q"))
    return q.select("y", "x", *longs(q=F.col("q")), (F.round(quantize.dequantize_biased(F.col("q"), F.lit(12.5), F.lit(3.0), 1), 6) + 0.0).alias("restored"))


def _steps(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


@query(f"""WITH t AS (SELECT q, i, {_steps(quantize.LUMA_STEPS)}[i] AS y, {_steps(quantize.CHROMA_STEPS)}[i] AS c, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS s
        FROM range(1, 101) a(q), range(1, 65) b(i))
    SELECT q AS quality, i - 1 AS coefficient, greatest(1, least(255, (y * s + 50) // 100)) AS luma, greatest(1, least(255, (c * s + 50) // 100)) AS chroma FROM t""")
def jpeg_quant_table(spark, sf_dir):
    at = spark.range(1, 101).select(F.col("id").alias("quality"), F.posexplode(F.array(*(F.struct(F.lit(a).alias("l"), F.lit(c).alias("c")) for a, c in zip(quantize.LUMA_STEPS, quantize.CHROMA_STEPS, strict=True)))).alias("i", "s"))
    step = lambda n: quantize.scaled_step(F.col(f"s.{n}"), F.col("quality"))
    return at.select("quality", *longs(coefficient=F.col("i"), luma=step("l"), chroma=step("c")))


@query("""SELECT i AS step, CAST(greatest(256, least(73728, round_even(exp(CASE
    WHEN i / 10.0 <= 0.5 THEN ln(9080) + (ln(i / 10.0) - ln(0.3)) * (ln(5743) - ln(9080)) / (ln(0.5) - ln(0.3))
    WHEN i / 10.0 <= 0.75 THEN ln(5743) + (ln(i / 10.0) - ln(0.5)) * (ln(2925) - ln(5743)) / (ln(0.75) - ln(0.5))
    WHEN i / 10.0 <= 1.0 THEN ln(2925) + (ln(i / 10.0) - ln(0.75)) * (ln(2025) - ln(2925)) / (ln(1.0) - ln(0.75))
    WHEN i / 10.0 <= 1.5 THEN ln(2025) + (ln(i / 10.0) - ln(1.0)) * (ln(1371) - ln(2025)) / (ln(1.5) - ln(1.0))
    WHEN i / 10.0 <= 2.0 THEN ln(1371) + (ln(i / 10.0) - ln(1.5)) * (ln(1019) - ln(1371)) / (ln(2.0) - ln(1.5))
    WHEN i / 10.0 <= 3.0 THEN ln(1019) + (ln(i / 10.0) - ln(2.0)) * (ln(797) - ln(1019)) / (ln(3.0) - ln(2.0))
    WHEN i / 10.0 <= 4.0 THEN ln(797) + (ln(i / 10.0) - ln(3.0)) * (ln(649) - ln(797)) / (ln(4.0) - ln(3.0))
    ELSE ln(649) + (ln(i / 10.0) - ln(4.0)) * (ln(535) - ln(649)) / (ln(6.0) - ln(4.0)) END), 0))) AS BIGINT) AS global_scale FROM range(1, 121) t(i)""")
def distance_global_scale(spark, sf_dir):
    at = spark.range(1, 121).select(F.col("id").alias("step"))
    return at.select("step", *longs(global_scale=quantize.global_scale(F.col("step") / 10.0)))


_FILTERS = f"""WITH {ITEM}, n AS (SELECT p.y, p.x, p.r AS v, coalesce(l.r, 0) AS a, coalesce(u.r, 0) AS b, coalesce(c.r, 0) AS c FROM px p
    LEFT JOIN px l ON l.y = p.y AND l.x = p.x - 1 LEFT JOIN px u ON u.y = p.y - 1 AND u.x = p.x LEFT JOIN px c ON c.y = p.y - 1 AND c.x = p.x - 1),
  q AS (SELECT *, abs(b - c) AS pa, abs(a - c) AS pb, abs(a + b - 2 * c) AS pc FROM n),
  f AS (SELECT y, x, v AS f0, (v - a + 256) % 256 AS f1, (v - b + 256) % 256 AS f2, (v - (a + b) // 2 + 256) % 256 AS f3,
    (v - (CASE WHEN pa <= pb AND pa <= pc THEN a WHEN pb <= pc THEN b ELSE c END) + 256) % 256 AS f4 FROM q)"""


def _filtered(spark, sf_dir) -> DataFrame:
    px = neighbours.with_neighbours(rasters.items(spark, sf_dir).select("y", "x", F.col("r").alias("v")), "v")
    return px.select("y", "x", *longs(**{f"f{i}": c for i, c in enumerate(neighbours.png_residuals(*(F.col(c) for c in "vabc")))}))


@query(_FILTERS + " SELECT * FROM f")
def png_filter_rows(spark, sf_dir):
    return _filtered(spark, sf_dir)


@query(_FILTERS + """, s AS (SELECT y, CAST(sum(least(f0, 256 - f0)) AS BIGINT) AS cost0, CAST(sum(least(f1, 256 - f1)) AS BIGINT) AS cost1, CAST(sum(least(f2, 256 - f2)) AS BIGINT) AS cost2,
    CAST(sum(least(f3, 256 - f3)) AS BIGINT) AS cost3, CAST(sum(least(f4, 256 - f4)) AS BIGINT) AS cost4 FROM f GROUP BY y)
  SELECT *, CASE least(cost0, cost1, cost2, cost3, cost4) WHEN cost0 THEN 0 WHEN cost1 THEN 1 WHEN cost2 THEN 2 WHEN cost3 THEN 3 ELSE 4 END AS filter FROM s""")
def png_adaptive_pick(spark, sf_dir):
    return neighbours.filter_choice(_filtered(spark, sf_dir), [f"f{i}" for i in range(5)])


@query(f"WITH {ITEM} SELECT y, x, r AS v FROM px")
def png_unfilter_sub(spark, sf_dir):
    """Prefix sums undo the left filter: the samples themselves."""
    r = F.col("r")
    row = Window.partitionBy("y").orderBy("x")
    px = rasters.items(spark, sf_dir)
    left = px.select("y", "x", F.pmod(r - F.coalesce(F.lag("r").over(row), F.lit(0)), F.lit(256)).alias("f"))
    return left.select("y", "x", *longs(v=F.pmod(F.sum("f").over(row), F.lit(256))))


@query(f"""WITH {BYTES}, n AS (SELECT doc_id, count(*) AS n FROM bytes GROUP BY 1),
    t AS (SELECT doc_id, i, n, CASE WHEN i % 2 = 0 THEN i // 2 ELSE (n + 1) // 2 + i // 2 END AS j, v FROM bytes JOIN n USING (doc_id)),
    d AS (SELECT doc_id, j, CASE WHEN j = 0 THEN v ELSE (v - lag(v) OVER (PARTITION BY doc_id ORDER BY j) + 384) % 256 END AS d FROM t)
    SELECT doc_id, count(*) AS n, CAST(sum(d) AS BIGINT) AS total, CAST(sum(d * (j % 1009)) AS BIGINT) AS placed FROM d GROUP BY doc_id""")
def exr_byte_delta(spark, sf_dir):
    return texts.per_text(spark, sf_dir, ["n", "total", "placed"], texts.delta_sums)


@query(f"""WITH {BYTES}, s AS (SELECT doc_id, i, v, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM bytes),
    g AS (SELECT doc_id, v, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), c AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT doc_id, count(*) AS runs, max(n) AS longest, count(*) FILTER (n >= 3) AS coded FROM c GROUP BY doc_id""")
def exr_rle_runs(spark, sf_dir):
    return texts.per_text(spark, sf_dir, ["runs", "longest", "coded"], texts.run_counts)


@query(f"""WITH {BYTES}, u AS (SELECT DISTINCT doc_id, v FROM bytes UNION SELECT DISTINCT doc_id, 0 FROM bytes), l AS (SELECT doc_id, v, dense_rank() OVER (PARTITION BY doc_id ORDER BY v) - 1 AS code FROM u)
    SELECT b.doc_id, CAST(max(code) AS BIGINT) AS top_code, CAST(sum(code) AS BIGINT) AS total FROM bytes b JOIN l ON b.doc_id = l.doc_id AND b.v = l.v GROUP BY b.doc_id""")
def piz_lut(spark, sf_dir):
    """Codes of the byte values in use, zero always among them."""
    return texts.per_text(spark, sf_dir, ["top_code", "total"], texts.code_sums)


_PREDICT = f"""WITH {GRAD}, j AS (SELECT y, x, g AS v, lag(g, 128) OVER o AS up, CASE WHEN x > 0 THEN lag(g) OVER o END AS lf, CASE WHEN x > 0 THEN lag(g, 129) OVER o END AS upl,
    CASE WHEN x < 127 THEN lag(g, 127) OVER o END AS upr, CASE WHEN x < 126 THEN lag(g, 126) OVER o END AS upr2, lag(g, 256) OVER o AS up2, CASE WHEN x > 1 THEN lag(g, 2) OVER o END AS lf2
    FROM px WINDOW o AS (ORDER BY y, x)),
  n AS (SELECT y, x, coalesce(up, lf, 0) AS n, coalesce(lf, up, 0) AS w, coalesce(upl, up, lf, 0) AS nw, coalesce(upr, up, lf, 0) AS ne, coalesce(up2, 0) AS nn,
    coalesce(lf2, lf, up, 0) AS ww, coalesce(upr2, upr, up, lf, 0) AS nee FROM j)
  SELECT y, x, 0 AS p0, w AS p1, n AS p2, (w + n) // 2 AS p3, CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END AS p4, greatest(least(w, n), least(greatest(w, n), n + w - nw)) AS p5,
    ne AS p7, nw AS p8, ww AS p9, (w + nw) // 2 AS p10, (n + nw) // 2 AS p11, (n + ne) // 2 AS p12, CAST(trunc((6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) / 16) AS BIGINT) AS p13 FROM n"""


@query(_PREDICT)
def jxl_predictors(spark, sf_dir):
    px = neighbours.modular_neighbours(rasters.gradient_raster(spark), "g", 128)
    return px.select("y", "x", *longs(**neighbours.modular_predictions()))


@query(f"""WITH {VECTORS}, o AS (SELECT DISTINCT y, n, t.i // 2 AS k, t.i AS c FROM v, range(0, 64, 2) t(i) WHERE t.i + 1 < n)
    SELECT o.y, o.k AS x, (4 * (d1.s + d2.s + d3.s) + 2 * d2.s + d0.s + d4.s + 8) >> 4 AS s FROM o
    JOIN v d2 ON d2.y = o.y AND d2.x = c JOIN v d1 ON d1.y = o.y AND d1.x = CASE WHEN c >= 1 THEN c - 1 ELSE 1 END JOIN v d0 ON d0.y = o.y AND d0.x = CASE WHEN c >= 2 THEN c - 2 ELSE 2 END
    JOIN v d3 ON d3.y = o.y AND d3.x = c + 1 JOIN v d4 ON d4.y = o.y AND d4.x = CASE WHEN c + 2 <= o.n - 1 THEN c + 2 ELSE c END""")
def chroma_downsample_422(spark, sf_dir):
    v = rasters.vectors(spark, sf_dir).select("y", F.posexplode(samples.halved(F.col("samples"))).alias("x", "s"))
    return v.select("y", *longs(x=F.col("x"), s=F.col("s")))


@query(f"""WITH {VECTORS} SELECT p.y, 2 * p.x + h.h AS x, CASE WHEN h.h = 0 THEN CASE WHEN p.x = 0 THEN p.s ELSE (3 * p.s + l.s + 2) >> 2 END ELSE CASE WHEN p.x = p.n - 1 THEN p.s ELSE (3 * p.s + q.s + 2) >> 2 END END AS s
    FROM v p CROSS JOIN range(2) h(h) LEFT JOIN v l ON l.y = p.y AND l.x = p.x - 1 LEFT JOIN v q ON q.y = p.y AND q.x = p.x + 1""")
def jpeg_upsample_h2(spark, sf_dir):
    v = rasters.vectors(spark, sf_dir).select("y", F.posexplode(samples.doubled(F.col("samples"))).alias("x", "s"))
    return v.select("y", *longs(x=F.col("x"), s=F.col("s")))


_GAIN = """lin AS (SELECT y, x, r, CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END AS lr,
    CASE WHEN g / 255.0 <= 0.04045 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END AS lg, CASE WHEN b / 255.0 <= 0.04045 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END AS lb FROM px),
  gain AS (SELECT y, x, log2(((0.2126 * lr + 0.7152 * lg + 0.0722 * lb) * (1 + x / 64.0) + 0.015625) / (0.2126 * lr + 0.7152 * lg + 0.0722 * lb + 0.015625)) AS v FROM lin)"""


def log_gain(px: DataFrame) -> DataFrame:
    """Log gain of a rendition that brightens to the right, over the raster itself."""
    r, g, b, _ = rgbk()
    light = 0.2126 * color.srgb_to_linear(r / 255.0) + 0.7152 * color.srgb_to_linear(g / 255.0) + 0.0722 * color.srgb_to_linear(b / 255.0)
    return px.select("y", "x", F.log2((light * (1 + F.col("x") / 64.0) + 0.015625) / (light + 0.015625)).alias("v"))


@query(f"WITH {GRAD}, {_GAIN} SELECT round(pow(2, min(v)), 6) AS gain_min, round(pow(2, max(v)), 6) AS gain_max, round(greatest(pow(2, max(v)), 1.0625), 6) AS capacity_max FROM gain")
def gainmap_fit(spark, sf_dir):
    fit = log_gain(rasters.gradient_raster(spark)).agg(F.pow(F.lit(2.0), F.min("v")).alias("low"), F.pow(F.lit(2.0), F.max("v")).alias("high"))
    return fit.select(*rounded(gain_min=F.col("low"), gain_max=F.col("high"), capacity_max=F.greatest("high", F.lit(1.0625))))


@query(f"""WITH {GRAD}, {_GAIN}, f AS (SELECT min(v) AS lo, max(v) AS hi FROM gain)
    SELECT y // 4 AS y, x // 4 AS x, CAST(round_even(greatest(0, least(1, (round(avg(v), 9) - any_value(lo)) / (any_value(hi) - any_value(lo)))) * 255, 0) AS BIGINT) AS code FROM gain, f GROUP BY y // 4, x // 4""")
def gainmap_cells(spark, sf_dir):
    """The gain map itself: cell means between the fitted bounds, as bytes."""
    gain = log_gain(rasters.gradient_raster(spark))
    fit = gain.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    cells = gain.groupBy(F.floor(F.col("y") / 4).alias("y"), F.floor(F.col("x") / 4).alias("x")).agg(F.round(F.avg("v"), 9).alias("m"))
    unit = integers.clamp((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0), F.lit(1.0))
    return cells.crossJoin(F.broadcast(fit)).select("y", "x", *longs(code=F.rint(unit * 255)))


_MAP_W, _MAP_H = 32, 24


@query(f"""WITH {GRAD}, lin AS (SELECT y, x, CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END AS l FROM px),
    q AS (SELECT *, greatest(0, least({_MAP_W} - 1, floor((x + 0.5) * {_MAP_W} / 128 - 0.5))) AS x0, (x + 0.5) * {_MAP_W} / 128 - 0.5 AS u, greatest(0, least({_MAP_H} - 1, floor((y + 0.5) * {_MAP_H} / 96 - 0.5))) AS y0, (y + 0.5) * {_MAP_H} / 96 - 0.5 AS v FROM lin),
    w AS (SELECT *, greatest(0, least(1, u - x0)) AS fx, greatest(0, least(1, v - y0)) AS fy, least(x0 + 1, {_MAP_W} - 1) AS x1, least(y0 + 1, {_MAP_H} - 1) AS y1 FROM q),
    c AS (SELECT *, (((x0 * 7 + y0 * 11) % 256) * (1 - fx) + ((x1 * 7 + y0 * 11) % 256) * fx) * (1 - fy) + (((x0 * 7 + y1 * 11) % 256) * (1 - fx) + ((x1 * 7 + y1 * 11) % 256) * fx) * fy AS code FROM w)
    SELECT y, x, round((l + 0.015625) * pow(2, (code / 255.0) * 2 * 0.5) - 0.015625, 6) + 0.0 AS hdr FROM c""")
def gainmap_reconstruct(spark, sf_dir):
    """Bilinear samples of a 32 by 24 map, applied at half its weight to the red samples."""
    r = F.col("r")
    px = rasters.gradient_raster(spark).select("y", "x", color.srgb_to_linear(r / 255.0).alias("l"))

    def axis(at: Column, cells: int, size: int) -> tuple[Column, Column, Column]:
        u = (at + 0.5) * cells / size - 0.5
        low = integers.clamp(F.floor(u), 0, cells - 1)
        return low, F.least(low + 1, F.lit(cells - 1)), integers.clamp(u - low, F.lit(0.0), F.lit(1.0))

    x0, x1, fx = axis(F.col("x"), _MAP_W, 128)
    y0, y1, fy = axis(F.col("y"), _MAP_H, 96)
    cell = lambda y, x: (x * 7 + y * 11) % 256
    code = (cell(y0, x0) * (1 - fx) + cell(y0, x1) * fx) * (1 - fy) + (cell(y1, x0) * (1 - fx) + cell(y1, x1) * fx) * fy
    gain = F.pow(F.lit(2.0), code / 255.0 * 2 * 0.5)
    return px.select("y", "x", (F.round((F.col("l") + 0.015625) * gain - 0.015625, 6) + 0.0).alias("hdr"))


@query("""SELECT l_orderkey AS y, l_linenumber AS idx, (n_nationkey * 10) % 256 AS r, (n_regionkey * 50) % 256 AS g, length(n_name) AS b, CASE WHEN n_nationkey < 4 THEN 64 * n_nationkey ELSE 255 END AS a
    FROM lineitem JOIN nation ON n_nationkey = l_linenumber""")
def palette_lookup(spark, sf_dir):
    """Indexed pixels through a palette with a short alpha list. Up to 256 entries, the bound of the format, are broadcast; more are joined plainly."""
    palette = spark.read.parquet(f"{sf_dir}/nation.parquet")
    entry = palette.select(F.col("n_nationkey").alias("idx"), *longs(r=(F.col("n_nationkey") * 10) % 256, g=(F.col("n_regionkey") * 50) % 256, b=F.length("n_name"), a=F.when(F.col("n_nationkey") < 4, 64 * F.col("n_nationkey")).otherwise(255)))
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("idx"))
    side = F.broadcast(entry) if palette.limit(257).count() <= 256 else entry
    return px.join(side, "idx").select("y", F.col("idx").cast("long"), "r", "g", "b", "a")


@query(f"""WITH {GRAD}, t AS (SELECT t.ty, t.tx, i.iy, i.ix, coalesce(p.r, 0) AS v FROM (SELECT ty, tx FROM range(2) a(ty), range(3) b(tx)) t, (SELECT iy, ix FROM range(64) a(iy), range(48) b(ix)) i LEFT JOIN px p ON p.y = ty * 64 + iy AND p.x = tx * 48 + ix)
    SELECT ty * 3 + tx AS tile, iy AS y, ix AS x, v FROM t""")
def tiff_tiles(spark, sf_dir):
    """Tiles of 48 by 64 samples, zero beyond the edges of the raster."""
    cells = spark.range(6 * 64 * 48).select(F.floor(F.col("id") / 3072).alias("tile"), F.floor(F.col("id") / 48 % 64).alias("iy"), (F.col("id") % 48).alias("ix"))
    at = cells.select("tile", "iy", "ix", (F.floor(F.col("tile") / 3) * 64 + F.col("iy")).alias("y"), (F.col("tile") % 3 * 48 + F.col("ix")).alias("x"))
    px = rasters.gradient_raster(spark).select("y", "x", "r")
    return at.join(px, ["y", "x"], "left").select("tile", F.col("iy").alias("y"), F.col("ix").alias("x"), *longs(v=F.coalesce("r", F.lit(0))))


def _idct_sql(size: int) -> str:
    import math

    if size == 1:
        return "[greatest(0, least(255, floor(s[1] * 0.125 + 128.5)))]"
    basis = [[(math.sqrt(0.5) if u == 0 else 1.0) / 2 * math.cos((2 * p + 1) * u * math.pi / (2 * size)) for p in range(size)] for u in range(size)]
    cells = []
    for p in range(size):
        for q in range(size):
            total = " + ".join(f"{basis[u][p]!r} * {basis[v][q]!r} * s[{8 * u + v + 1}]" for u in range(size) for v in range(size))
            cells.append(f"greatest(0, least(255, floor({total} + 128.5)))")
    return "[" + ", ".join(cells) + "]"


@query(f"""WITH e AS (SELECT vec_id AS y, list_transform(embedding, lambda t: floor(CAST(t AS DOUBLE) * 1000 + 0.5)) AS s FROM embeddings),
    o AS (SELECT y, 4 AS size, unnest({_idct_sql(4)}) AS v, generate_series(1, 16) AS i FROM e UNION ALL SELECT y, 2, unnest({_idct_sql(2)}), NULL FROM e UNION ALL SELECT y, 1, unnest({_idct_sql(1)}), NULL FROM e)
    SELECT y, size, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high FROM o GROUP BY y, size""")
def reduced_idct(spark, sf_dir):
    """Each embedding as one block of coefficients, decoded at a half, a quarter and an eighth."""
    v = rasters.vectors(spark, sf_dir)
    parts = []
    for size in (4, 2, 1):
        block = F.array(*samples.reduced_block(F.col("samples"), size))
        parts.append(v.select("y", *longs(size=F.lit(size)), block.alias("o")))
    every = parts[0].union(parts[1]).union(parts[2])
    total = F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x)
    return every.select("y", "size", *longs(total=total, low=F.array_min("o"), high=F.array_max("o")))


@query("""SELECT l_orderkey AS y, l_linenumber AS k, CASE WHEN l_suppkey % 7 = 0 THEN 0.0 ELSE round(l_partkey / CAST(l_suppkey % 7 AS DOUBLE), 6) END AS value,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (l_partkey % 90 / CAST(l_suppkey % 7 AS DOUBLE) + l_linenumber / 1.0 / 60 + l_quantity / 10.0 / 3600), 6) END AS degrees FROM lineitem""")
def exif_rational(spark, sf_dir):
    """Rationals with zero for a zero denominator, and degrees from three of them, null for one."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    den = F.col("l_suppkey") % 7
    value = F.when(den == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(F.col("l_partkey").cast("double"), den.cast("double")), 6))
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    degrees = F.try_divide((F.col("l_partkey") % 90).cast("double"), den.cast("double")) + F.col("l_linenumber") / 1.0 / 60 + F.col("l_quantity") / 10.0 / 3600
    return rows.select(F.col("l_orderkey").alias("y"), *longs(k=F.col("l_linenumber")), value.alias("value"), F.round(sign * degrees, 6).alias("degrees"))


@query()
def crc32_chunks(spark, sf_dir):
    """Chunk checksums over type and data."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.crc32(F.concat(F.lit(b"tEXt"), F.col("text").cast("binary"))).alias("crc"))
