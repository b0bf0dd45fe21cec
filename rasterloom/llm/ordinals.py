"""Dense positions of rows within keys, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .winnow import unused_name

#: Rows of a key and bucket that one window sorts, about.
ROWS = 50_000


def with_ordinals(df: DataFrame, key: str, order: list[Column], name: str, spread: Column, n_rows: int) -> DataFrame:
    """``df`` with ``name``: the position, from 0, of each row among those of its ``key``.

    A key's rows are split by the leading bits of ``spread``, a uniform long
    that comes first in the order, so a key of any size is sorted by many tasks. Ties
    in ``spread`` and ``order`` are rows that callers can't tell apart.
    """
    hash_, bucket, count, rank, base = (unused_name(df, x) for x in ("hash", "bucket", "count", "rank", "base"))
    buckets = 1
    while buckets * ROWS < n_rows:
        buckets *= 2
    bits = buckets.bit_length() - 1
    placed = df.withColumn(hash_, spread).withColumn(bucket, F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = staged(placed.groupBy(key, bucket).agg(F.count("*").alias(count)), "bucket-sizes")
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # A row for each key and bucket: as many buckets as needed for ROWS rows each.
    bases = sizes.select(key, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(key, bucket).orderBy(hash_, *order)
    ranked = placed.withColumn(rank, F.row_number().over(within) - 1)
    return ranked.join(bases, [key, bucket]).withColumn(name, F.col(base) + F.col(rank)).drop(hash_, bucket, rank, base)
