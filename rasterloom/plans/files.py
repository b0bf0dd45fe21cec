"""Queries that go through encoded files: encode, recognise, decode and compare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import macroblocks
from ..session import ship_package
from ..sources import exr, facade, jpeg, jxl_lossy, jxl_modular, jxr, jxr_image, parts, png, tiff

QUERIES = {}
ORACLES: dict[str, str] = {}
#: Rows of samples of a raster in each file.
ROWS = 16


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, rows``: 16 embeddings with ids side by side as one raster of 64 columns."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == 64)
    held = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))  # ROWS at most for each image
    return rows.groupBy(F.floor(F.col("vec_id") / ROWS).alias("image_id")).agg(held.alias("h")).select("image_id", F.col("h.embedding").alias("rows"))


def bytes_of(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v.astype(np.float64) * 127 + 128), 0, 255).astype(np.uint8)


def encoded(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``image_id, content``: the rasters as files of one format."""
    ship_package(spark)

    def encode(v: np.ndarray) -> bytes:
        if kind == "png":
            return png.write(bytes_of(v)[..., None])
        if kind == "jpeg":
            return jpeg.encode(bytes_of(v)[..., None], 95)
        if kind == "tiff":
            return tiff.write([v[..., None]], rows_per_strip=5)
        if kind == "jxl":
            return jxl_modular.write(np.repeat(bytes_of(v)[..., None], 3, axis=2))
        if kind == "jxr":
            return jxr_image.write(np.repeat(bytes_of(v)[..., None], 3, axis=2), jxr_image.Options(overlap=1, by_frequency=True))
        if kind == "jxl_lossy":
            return jxl_lossy.write(np.repeat(bytes_of(v)[..., None], 3, axis=2), 1.0)
        if kind == "jxr_420":
            return jxr_image.write(np.repeat(bytes_of(v)[..., None], 3, axis=2), jxr_image.Options(overlap=2, color=jxr.YUV420))
        if kind == "jxr_half":
            return jxr_image.write(np.floor(v[..., None] * 512).astype(np.float16), jxr_image.Options(overlap=2, tile_widths=[1, 2]))
        if kind == "jxl_float":
            return jxl_modular.write(v[..., None])
        return exr.write({"Y": v}, exr.ZIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [encode(np.array(rows, dtype=np.float32)) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["image_id", "content"])

    return images(spark, sf_dir).mapInArrow(run, "image_id long, content binary")


def _sums(files: DataFrame) -> DataFrame:
    """Size and sums of the samples of each decoded file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            out = [np.frombuffer(p, {"UInt8": "u1", "UInt16": "<u2", "Float32": "<f4"}[f]).astype(np.float64) for p, f in zip(c["pixels"], c["sample_format"], strict=True)]
            yield pa.RecordBatch.from_pydict({"image_id": pa.array(c["image_id"]), "width": pa.array(c["width"], pa.int64()), "height": pa.array(c["height"], pa.int64()), "total": [float(x.sum()) for x in out], "low": [float(x.min()) for x in out], "high": [float(x.max()) for x in out]})

    rows = facade.decoded(files, "image_id").where("error is null").select("image_id", "width", "height", "pixels", "sample_format")
    found = rows.mapInArrow(run, "image_id long, width long, height long, total double, low double, high double")
    return found.select("image_id", "width", "height", *(F.round(c, 3).alias(c) for c in ("total", "low", "high")))


_FLOATS = f"""WITH v AS (SELECT vec_id // 16 AS image_id, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = 64)
SELECT image_id, CAST(64 AS BIGINT) AS width, count(*) // 64 AS height, round(sum(CAST(v AS DOUBLE)), 3) AS total, round(min(CAST(v AS DOUBLE)), 3) AS low, round(max(CAST(v AS DOUBLE)), 3) AS high FROM v GROUP BY image_id"""


def png_roundtrip(spark, sf_dir):
    return _sums(encoded(spark, sf_dir, "png"))


def tiff_roundtrip(spark, sf_dir):
    return _sums(encoded(spark, sf_dir, "tiff"))


def exr_roundtrip(spark, sf_dir):
    return _sums(encoded(spark, sf_dir, "exr"))


def jxl_roundtrip(spark, sf_dir):
    """RGB with three equal channels, through the reversible colour transform."""
    found = _sums(encoded(spark, sf_dir, "jxl"))
    return found.withColumn("total", F.round(F.col("total") / 3, 3))


def jxr_roundtrip(spark, sf_dir):
    """RGB with three equal channels: overlap between blocks, the bands one after the other."""
    found = _sums(encoded(spark, sf_dir, "jxr"))
    return found.withColumn("total", F.round(F.col("total") / 3, 3))


def jxr_420_roundtrip(spark, sf_dir):
    """RGB with three equal channels, chroma halved both ways: nothing is lost, as there is none."""
    found = _sums(encoded(spark, sf_dir, "jxr_420"))
    return found.withColumn("total", F.round(F.col("total") / 3, 3))


def jxr_half_roundtrip(spark, sf_dir):
    """Grey half floats (512ths, rounded down) in three tiles with two levels of overlap."""
    return _sums(encoded(spark, sf_dir, "jxr_half"))


def jxl_float_roundtrip(spark, sf_dir):
    return _sums(encoded(spark, sf_dir, "jxl_float"))


def jpeg_roundtrip(spark, sf_dir):
    """Lossy: the size, and whether the mean sample is within one of the source's; a test holds the samples against their sources."""
    return _near(spark, sf_dir, "jpeg", 255)  # opaque


def jxl_lossy_roundtrip(spark, sf_dir):
    """The same by the lossy mode at a visual distance of one."""
    return _near(spark, sf_dir, "jxl_lossy", 0)


def _near(spark: SparkSession, sf_dir: str, kind: str, alpha: int) -> DataFrame:
    """Of RGB with equal channels."""
    lossy, exact = _sums(encoded(spark, sf_dir, kind)), _sums(encoded(spark, sf_dir, "png"))
    source = exact.select("image_id", F.col("total").alias("source"))
    area = F.col("width") * F.col("height")
    near = F.abs((F.col("total") - alpha * area) / 3 - F.col("source")) <= area
    return lossy.join(source, "image_id").select("image_id", "width", "height", near.alias("near"))


EVERY = ("png", "jpeg", "tiff", "exr", "jxl", "jxl_float", "jxr")


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(spark, sf_dir, EVERY[0])
    for kind in EVERY[1:]:
        out = out.union(encoded(spark, sf_dir, kind))
    return out


def header_info(spark, sf_dir):
    """Size, channels and samples of files of every format, from their headers alone."""
    return parts.described(_every(spark, sf_dir), "image_id").where("error is null").drop("error")


def file_parts(spark, sf_dir):
    """Chunks, segments, directory entries, attributes, channels and streams: how many of each kind a file has."""
    found = parts.listed(_every(spark, sf_dir), "image_id")
    return found.groupBy("image_id", "format", "kind").agg(F.count_distinct("name").cast("long").alias("names"), F.min("name").alias("first"))


def file_info(spark, sf_dir):
    """Format by native sniffing and the PNG header by native byte expressions, with no decoding."""
    files = encoded(spark, sf_dir, "png").union(encoded(spark, sf_dir, "exr"))
    h = facade.png_header(F.col("content"))
    rows = files.select("image_id", facade.sniffed(F.col("content")).alias("format"), h["width"].alias("width"), h["height"].alias("height"), h["depth"].alias("depth"))
    return rows


def jxr_core_transform(spark, sf_dir):
    """Macroblocks of each stored image through both stages of the core transform and back: how many, and whether all bits return."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept = [], []
            for rows in b.column(1).to_pylist():
                v = bytes_of(np.array(rows, dtype=np.float32))
                p = macroblocks.macroblocks(v)
                back = macroblocks.plane(macroblocks.inverse(macroblocks.forward(p)), *v.shape)
                n.append(p.shape[0] * p.shape[1])
                kept.append(bool((back == v).all()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(kept)], ["image_id", "macroblocks", "restored"])

    return images(spark, sf_dir).mapInArrow(run, "image_id long, macroblocks long, restored boolean")


QUERIES["jxr_core_transform"] = jxr_core_transform
QUERIES |= {f.__name__: f for f in (png_roundtrip, tiff_roundtrip, exr_roundtrip, jpeg_roundtrip, jxl_lossy_roundtrip, jxl_roundtrip, jxl_float_roundtrip, jxr_roundtrip, jxr_420_roundtrip, jxr_half_roundtrip, file_info, header_info, file_parts)}
_PARTS = "('png', 'chunk', 3, 'IDAT'), ('jpeg', 'segment', 4, 'C0'), ('tiff', 'entry', 11, '256'), ('exr', 'attribute', 8, 'channels'), ('exr', 'channel', 1, 'Y'), ('jxl', 'codestream', 1, ''), ('jxr', 'entry', 9, 'BC01')"
ORACLES |= {
    "jxr_core_transform": "SELECT vec_id // 16 AS image_id, CAST(4 * ceil(count(*) / 16) AS BIGINT) AS macroblocks, TRUE AS restored FROM embeddings WHERE len(embedding) = 64 GROUP BY 1",
    "file_parts": f"SELECT DISTINCT vec_id // 16 AS image_id, format, kind, CAST(names AS BIGINT) AS names, first FROM embeddings, (VALUES {_PARTS}) t(format, kind, names, first) WHERE len(embedding) = 64",
    "png_roundtrip": _FLOATS.replace("unnest(embedding) AS v", "greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 127 + 128))) AS v"),
    "tiff_roundtrip": _FLOATS,
    "jxl_roundtrip": _FLOATS.replace("unnest(embedding) AS v", "greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 127 + 128))) AS v"),
    "jxl_float_roundtrip": _FLOATS,
    "jxr_roundtrip": _FLOATS.replace("unnest(embedding) AS v", "greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 127 + 128))) AS v"),
    "jxr_420_roundtrip": _FLOATS.replace("unnest(embedding) AS v", "greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 127 + 128))) AS v"),
    "jxr_half_roundtrip": _FLOATS.replace("unnest(embedding) AS v", "floor(CAST(unnest(embedding) AS DOUBLE) * 512) AS v"),
    "jxl_lossy_roundtrip": f"SELECT image_id, width, height, TRUE AS near FROM ({_FLOATS})",
    "jpeg_roundtrip": f"SELECT image_id, width, height, TRUE AS near FROM ({_FLOATS})",
    "header_info": f"""SELECT image_id, format, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, channels, sample_format FROM ({_FLOATS}),
(VALUES ('png', 1, 'UInt8'), ('jpeg', 4, 'UInt8'), ('tiff', 1, 'Float32'), ('exr', 1, 'Float32'), ('jxl', 3, 'UInt8'), ('jxl', 1, 'Float32'), ('jxr', 3, 'UInt8')) t(format, channels, sample_format)""",
    "exr_roundtrip": _FLOATS,
    "file_info": """WITH i AS (SELECT vec_id // 16 AS image_id, count(*) AS height FROM embeddings WHERE len(embedding) = 64 GROUP BY 1)
SELECT image_id, 'png' AS format, CAST(64 AS BIGINT) AS width, height, CAST(8 AS BIGINT) AS depth FROM i UNION ALL SELECT image_id, 'exr', NULL, NULL, NULL FROM i""",
}


def flagship(spark, sf_dir):
    """Every stored image: format, size, channels and mean display pixel."""
    files = encoded(spark, sf_dir, "png")
    rows = facade.decoded(files, "image_id").where("error is null and sample_format = 'UInt8'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means = [float(np.frombuffer(p.as_py(), np.uint8).mean()) for p in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(means)], names=[*b.schema.names[:5], "mean"])

    narrow = rows.select("image_id", "format", "width", "height", "channels", "pixels")
    out = narrow.mapInArrow(run, "image_id long, format string, width int, height int, channels int, mean double")
    return out.select("image_id", "format", "width", "height", "channels", F.round("mean", 3).alias("mean"))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """WITH v AS (SELECT vec_id // 16 AS image_id, greatest(0, least(255, floor(CAST(unnest(embedding) AS DOUBLE) * 127 + 128))) AS v FROM embeddings WHERE len(embedding) = 64)
SELECT image_id, 'png' AS format, 64 AS width, count(*) // 64 AS height, 1 AS channels, round(avg(v), 3) AS mean FROM v GROUP BY image_id"""
