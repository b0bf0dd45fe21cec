"""Shared plumbing for the training-data operators.

Staged tables go to the folder named by ``spark.checkpoint.dir`` so that every
executor can read them after any other executor is lost.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows and bytes handed to a Python worker at once; bounds its memory on long texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session's Python stages and ships the package to them."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one (tests) gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rasterloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Cuts the lineage: later reads survive lost executors and never recompute.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them is staged itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, size: int, per_task: int) -> None:
    """Lets shuffles of ``size`` bytes start from as many partitions as keep a task at ``per_task``; the runtime joins small ones."""
    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(setting, str(max(n_parts(spark), int(spark.conf.get(setting, None) or 0), size // per_task)))


def digest_of(text: F.Column | str) -> F.Column:
    """The SHA-256 of a text's bytes."""
    return F.unhex(F.sha2(text, 256))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast of a staged table only after counting its rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system.

    A worker idles between stages beside the JVM's heap; without this it holds
    what its largest batch took.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
