"""Operators on the bytes of whole texts: one numpy pass over each, which stays a run of bytes and never an array of numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources import exr


def per_text(spark: SparkSession, sf_dir: str, names: list[str], measure: Callable[[np.ndarray], tuple[int, ...]]) -> DataFrame:
    """``doc_id`` and the longs that ``measure`` makes of each text's UTF-8 bytes; null and empty texts have no row."""
    ship_package(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(np.frombuffer(x.as_buffer(), np.uint8)) for x in b.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    return rows.where(F.octet_length("bytes") > 0).mapInArrow(run, ", ".join(f"{n} long" for n in ["doc_id", *names]))


def delta_sums(data: np.ndarray) -> tuple[int, int, int]:
    """Length, sum and place-weighted sum of the even and odd bytes' differences."""
    d = np.frombuffer(exr.split_delta(data.tobytes()), np.uint8).astype(np.int64)
    return len(d), int(d.sum()), int((d * (np.arange(len(d)) % 1009)).sum())


def run_counts(data: np.ndarray) -> tuple[int, int, int]:
    """Runs of equal bytes, the longest, and those of three or more."""
    starts = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    lengths = np.diff(np.append(starts, len(data)))
    return len(lengths), int(lengths.max()), int((lengths >= 3).sum())


def code_sums(data: np.ndarray) -> tuple[int, int]:
    """Largest and sum of the bytes' codes: ranks among the values in use, zero always among them."""
    seen = np.bincount(data, minlength=256)
    used = seen > 0
    used[0] = True
    code = np.cumsum(used) - 1
    return int(code[data].max()), int((seen * code).sum())
