"""Recognition and decoding of image files: an ordered registry, native sniffing and a data source."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from . import exr, gain_map, jpeg, jxl, jxl_lossy, jxl_modular, jxr, jxr_image, png, tiff
from .raster import SCHEMA, BadImage, Raster


@dataclass(frozen=True)
class Decoder:
    """A format: the prefixes that announce it and what turns bytes into a raster."""

    name: str
    prefixes: tuple[bytes, ...]
    decode: Callable[[bytes], Raster]
    also: Callable[[bytes], bool] | None = None  # what the prefixes can't tell

    def matches(self, data: bytes) -> bool:
        return data.startswith(self.prefixes) and (self.also is None or self.also(data))


def _has_gain_map(data: bytes) -> bool:
    try:
        return gain_map.split(data) is not None
    except BadImage:
        return False


#: In order; the first that matches decodes, and no other is tried if it fails.
REGISTRY: list[Decoder] = [
    Decoder("png", (png.SIGNATURE,), png.raster),
    Decoder("gain_map_jpeg", (b"\xff\xd8\xff",), gain_map.raster, _has_gain_map),
    Decoder("jpeg", (b"\xff\xd8\xff",), jpeg.raster),
    Decoder("tiff", (b"II*\0", b"MM\0*"), tiff.raster),
    Decoder("exr", (exr.MAGIC,), exr.raster),
    Decoder("jxr", (jxr.SIGNATURE,), jxr_image.raster),
    Decoder("jxl", (jxl.CODESTREAM, jxl.CONTAINER), jxl_lossy.raster),
]


def register(decoder: Decoder) -> None:
    """Adds a format behind the others."""
    REGISTRY.append(decoder)


def sniffed(content: Column) -> Column:
    """Name of the first registered format told by its prefix, or null. Native, so filters on it need no decoding."""
    out = F.lit(None).cast("string")
    for d in reversed([d for d in REGISTRY if d.also is None]):
        hit = F.lit(False)
        for p in d.prefixes:
            hit = hit | F.startswith(content, F.lit(p))
        out = F.when(hit, F.lit(d.name)).otherwise(out)
    return out


def png_header(content: Column) -> Column:
    """Struct of width, height, depth and colour type from the header chunk, without decoding."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    fields = F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"), number(25, 1).alias("depth"), number(26, 1).alias("color_type"))
    is_png = F.startswith(content, F.lit(png.SIGNATURE)) & (F.substring(content, 13, 4) == F.lit(b"IHDR")) & (F.octet_length(content) >= 33)
    return F.when(is_png, fields)


def kind_of(data: bytes | None) -> str | None:
    """Name of the first registered format that matches."""
    return next((d.name for d in REGISTRY if d.matches(data)), None) if data else None


def decode(data: bytes | None) -> dict:
    """A row of ``SCHEMA``; errors are in it and never raised."""
    empty = dict.fromkeys(SCHEMA.names)
    for d in REGISTRY if data else ():
        if d.matches(data):
            try:
                return d.decode(data).row(d.name)
            except (BadImage, KeyError, ValueError, IndexError, struct.error, zlib.error) as e:
                return empty | {"format": d.name, "error": str(e) or type(e).__name__}
    return empty | {"error": "no known format"}


def decoded(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``files(key, content)`` as ``key`` and the columns of ``SCHEMA``: one image at a time in each task."""
    ship_package(files.sparkSession)
    schema = files.select(key).schema
    for f in SCHEMA.fields:
        schema = schema.add(f)
    kinds = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                row = decode(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], b.schema.field(0).type), *(pa.array([row[f.name]], f.type) for f in kinds)], names=schema.names)

    return files.select(key, content).mapInArrow(run, schema)


class RasterSource(DataSource):
    """``spark.read.format("raster").load(folder)``: decoded images of a folder on any file system that pyarrow reads."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self):
        from pyspark.sql import types as T

        return T.StructType([T.StructField("path", T.StringType()), *SCHEMA.fields])

    def reader(self, schema):
        return RasterReader(self.options["path"], int(self.options.get("filesPerPartition", "16")))


    def writer(self, schema, overwrite):
        return RasterWriter(self.options["path"], self.options.get("format", "png"), schema, overwrite)


#: What each format that can be written makes of samples.
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "png": png.write,
    "jpeg": lambda v: jpeg.encode(v, 95),
    "tiff": lambda v: tiff.write([v]),
    "exr": lambda v: exr.write(dict(zip("RGBA" if v.shape[2] > 2 else "Y", np.moveaxis(v.astype(np.float32), 2, 0), strict=False))),
    "jxl": jxl_modular.write,
    "jxr": jxr_image.write,
}
_SAMPLES = {"UInt8": "u1", "UInt16": "<u2", "Float32": "<f4"}


class RasterWriter(DataSourceWriter):
    """``df.write.format("raster").option("format", "png").save(folder)``: a file for each row.

    Rows need ``name``, ``width``, ``height``, ``channels``, ``sample_format`` and
    ``pixels``, as decoding gives them. A task writes drafts under names of its own; they get
    their names only when the whole job commits, so repeated tasks leave one file each.
    """

    def __init__(self, path: str, kind: str, schema, overwrite: bool):
        if kind not in ENCODERS:
            raise ValueError(f"{kind} is not written; one of {sorted(ENCODERS)} is")
        missing = {"name", "width", "height", "channels", "sample_format", "pixels"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.path, self.kind, self.overwrite = path, kind, overwrite

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows):
        store, root = self._store()
        store.create_dir(root, recursive=True)
        draft, done = uuid.uuid4().hex, []
        for row in rows:
            v = np.frombuffer(row.pixels, _SAMPLES[row.sample_format]).reshape(row.height, row.width, row.channels)
            to = f"{root}/{row.name}.{self.kind}"
            with store.open_output_stream(f"{root}/.{draft}-{len(done)}") as f:
                f.write(ENCODERS[self.kind](v))
            done.append((f"{root}/.{draft}-{len(done)}", to))
        return Written(done)

    def commit(self, messages):
        store, _ = self._store()
        for m in messages:
            for draft, to in m.files if m else ():
                store.move(draft, to)

    def abort(self, messages):
        store, _ = self._store()
        for m in messages:
            for draft, _ in m.files if m else ():
                store.delete_file(draft)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RasterReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition = path, per_partition

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self):
        from pyarrow import fs

        store, root = self._store()
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith("."))
        n = self.per_partition
        return [InputPartition(files[i : i + n]) for i in range(0, len(files), n)] or [InputPartition([])]

    def read(self, partition):
        store, _ = self._store()
        for path in partition.value:
            with store.open_input_file(path) as f:
                row = decode(f.read())
            color = row["color"]
            yield (path, *(tuple(color.values()) if n == "color" and color else row[n] for n in SCHEMA.names))


def register_source(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(RasterSource)
