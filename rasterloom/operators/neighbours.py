"""Neighbour predictors as joins with the row above and windows along a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import clamp, gradient, paeth, truncated_div


def with_neighbours(pixels: DataFrame, value: str) -> DataFrame:
    """Adds ``a`` (left), ``b`` (above) and ``c`` (upper left), zero outside the raster.

    The row above comes by an equality join on row and place, so no window spans
    a whole column of the raster.
    """
    row = Window.partitionBy("y").orderBy("x")
    own = pixels.withColumn("a", F.coalesce(F.lag(value).over(row), F.lit(0)))
    above = own.select((F.col("y") + 1).alias("y"), "x", F.col(value).alias("b"), F.col("a").alias("c"))
    joined = own.join(above, ["y", "x"], "left")
    # A short row above has no pixel here, but may have one to the upper left.
    corner = pixels.select((F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), F.col(value).alias("d"))
    joined = joined.join(corner, ["y", "x"], "left")
    return joined.withColumn("b", F.coalesce("b", F.lit(0))).withColumn("c", F.coalesce("d", F.lit(0))).drop("d")


def png_residuals(v: Column, a: Column, b: Column, c: Column) -> list[Column]:
    """The five filtered bytes of a sample."""
    return [F.pmod(x, F.lit(256)) for x in (v, v - a, v - b, v - F.floor((a + b) / 2), v - paeth(a, b, c))]


def filter_choice(filtered: DataFrame, names: list[str]) -> DataFrame:
    """Per row the cost of each filter, bytes taken as signed, and the cheapest; ties go to the lowest."""
    signed = lambda n: F.sum(F.least(F.col(n), 256 - F.col(n))).alias(n.replace("f", "cost"))
    costs = filtered.groupBy("y").agg(*map(signed, names))
    options = F.array(*(F.struct(F.col(n.replace("f", "cost")).alias("cost"), F.lit(i).alias("filter")) for i, n in enumerate(names)))
    return costs.withColumn("filter", F.array_min(options)["filter"])


def modular_neighbours(pixels: DataFrame, value: str, width: int) -> DataFrame:
    """``n, w, nw, ne, nn, ww, nee`` of each sample of a full raster, with the borders' stand-ins."""
    row = Window.partitionBy("y").orderBy("x")
    own = pixels.select("y", "x", F.col(value).alias("v"), F.lag(value).over(row).alias("l1"), F.lag(value, 2).over(row).alias("l2"), F.lead(value).over(row).alias("r1"), F.lead(value, 2).over(row).alias("r2"))
    one = own.select((F.col("y") + 1).alias("y"), "x", F.col("v").alias("up"), F.col("l1").alias("up_left"), F.col("r1").alias("up_right"), F.col("r2").alias("up_right2"))
    two = own.select((F.col("y") + 2).alias("y"), "x", F.col("v").alias("up2"))
    j = own.join(one, ["y", "x"], "left").join(two, ["y", "x"], "left")
    zero = F.lit(0)
    first = F.coalesce
    n, w = first("up", "l1", zero), first("l1", "up", zero)
    nw = first("up_left", F.when(F.col("up").isNull(), F.col("l1")).otherwise(F.col("up")), zero)
    ne = first("up_right", n)
    j = j.select("y", "x", "v", n.alias("n"), w.alias("w"), nw.alias("nw"), ne.alias("ne"), first("up2", zero).alias("nn"), first("l2", w).alias("ww"), "up_right2")
    return j.withColumn("nee", first("up_right2", "ne")).drop("up_right2")


def modular_predictions() -> dict[str, Column]:
    """The stateless predictors by number, from the columns of ``modular_neighbours``."""
    n, w, nw, ne, nn, ww, nee = map(F.col, ("n", "w", "nw", "ne", "nn", "ww", "nee"))
    half = lambda s: truncated_div(s, 2)
    return {
        "p0": F.lit(0).cast("long"),
        "p1": w,
        "p2": n,
        "p3": half(w + n),
        "p4": F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n),
        "p5": gradient(n, w, nw),
        "p7": ne,
        "p8": nw,
        "p9": ww,
        "p10": half(w + nw),
        "p11": half(n + nw),
        "p12": half(n + ne),
        "p13": truncated_div(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8, 16),
    }


def level(x: Column) -> Column:
    return clamp(x, 0, 255)
