"""Pixel relations derived from the tables, so that every operator has an input at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RGB row of pixels for each order: ``y, x, r, g, b`` and ``k``, the line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)) - 1
    return lines.select(
        F.col("l_orderkey").alias("y"),
        place.cast("long").alias("x"),
        (F.col("l_partkey") % 256).alias("r"),
        (F.col("l_suppkey") % 256).alias("g"),
        ((F.col("l_quantity").cast("long") * 5) % 256).alias("b"),
        F.col("l_linenumber").cast("long").alias("k"),
    )


def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels for operators that look at no neighbour: no window, so no shuffle."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("y"),
        (F.col("l_partkey") % 256).alias("r"),
        (F.col("l_suppkey") % 256).alias("g"),
        ((F.col("l_quantity").cast("long") * 5) % 256).alias("b"),
        F.col("l_linenumber").cast("long").alias("k"),
    )


def gradient_raster(spark: SparkSession, width: int = 128, height: int = 96) -> DataFrame:
    """Closed-form RGB gradient ``y, x, r, g, b``."""
    at = spark.range(width * height).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    low = lambda v: v.bitwiseAND(F.lit(255))
    return at.select("y", "x", low(3 * F.col("x") + 2 * F.col("y")).alias("r"), low(128 + F.col("x") - F.col("y")).alias("g"), low(F.col("x") + 3 * F.col("y")).alias("b"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of integer samples for each embedding: ``y, samples``, each the value times 1000, rounded."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scaled = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000 + 0.5).cast("long"))
    return rows.select(F.col("vec_id").alias("y"), scaled.alias("samples"))
