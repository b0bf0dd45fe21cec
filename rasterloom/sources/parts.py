"""What files hold besides pixels, as rows: headers and their parts, with no sample decoded."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from . import exif, exr, facade, jpeg, jxl, jxl_modular, jxr, png, tiff
from .raster import BadImage

ERRORS = (BadImage, KeyError, ValueError, IndexError, struct.error)
INFO = "format string, width int, height int, channels int, sample_format string, error string"
PART = "format string, page int, part int, kind string, name string, offset long, length long, detail string"


@dataclass
class Header:
    width: int
    height: int
    channels: int
    sample_format: str


def _png(data: bytes) -> Header:
    found = png.info(data)
    if found is None:
        raise BadImage("no header chunk")
    return Header(*found)


def _jpeg(data: bytes) -> Header:
    w, h, *_ = jpeg.info(data)
    return Header(w, h, 4, "UInt8")  # decoded to RGBA


def _tiff_entries(data: bytes) -> Iterator[tuple[str, int, dict]]:
    """Byte order, place and entries of each directory of the chain."""
    order = tiff.byte_order(data)
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        entries, following = tiff.directory(data, at, order)
        yield order, at, entries
        at = following


def _tiff(data: bytes) -> Header:
    order, _, entries = next(_tiff_entries(data))
    one = lambda tag, default: int(entries[tag].values(order)[0]) if tag in entries else default
    kinds = {(1, 8): "UInt8", (1, 16): "UInt16", (3, 16): "Float32", (3, 32): "Float32"}
    kind = kinds.get((one(tiff.SAMPLE_FORMAT, 1), one(tiff.BITS, 1)))
    if kind is None or one(tiff.WIDTH, 0) <= 0 or one(tiff.HEIGHT, 0) <= 0:
        raise BadImage("no size or samples that are shown")
    return Header(one(tiff.WIDTH, 0), one(tiff.HEIGHT, 0), one(tiff.SAMPLES, 1), kind)


def _exr(data: bytes) -> Header:
    h = exr.header(data)
    return Header(h.width, h.height, len(exr.shown([n for n, _ in h.channels])), "Float32")


def _jxl(data: bytes) -> Header:
    about = jxl_modular.info(data)
    if about.alpha or not about.exponent and about.bits > 16:
        raise BadImage("alpha or integers of over 16 bits")
    return Header(about.width, about.height, about.channels, "Float32" if about.exponent else "UInt8" if about.bits <= 8 else "UInt16")


def _jxr(data: bytes) -> Header:
    f = jxr.read(data)
    return Header(f.width, f.height, *f.layout)


HEADERS: dict[str, Callable[[bytes], Header]] = {"png": _png, "jpeg": _jpeg, "gain_map_jpeg": _jpeg, "tiff": _tiff, "exr": _exr, "jxr": _jxr, "jxl": _jxl}


def info(data: bytes | None) -> tuple:
    """A row of ``INFO``; errors are in it and never raised."""
    kind = facade.kind_of(data)
    if kind is None:
        return (None,) * 5 + ("no known format",)
    try:
        h = HEADERS[kind](data)
        return kind, h.width, h.height, h.channels, h.sample_format, None
    except ERRORS as e:
        return kind, None, None, None, None, str(e) or type(e).__name__


def _jpeg_parts(data: bytes) -> Iterator[tuple]:
    for s in jpeg.segments(data):
        prefix = s.payload.split(b"\0", 1)[0] if 0xE0 <= s.marker < 0xF0 else b""
        yield 0, "segment", f"{s.marker:02X}", s.offset, len(s.payload), prefix.decode("latin-1") if len(prefix) < 64 else ""


def _png_parts(data: bytes) -> Iterator[tuple]:
    at = len(png.SIGNATURE)
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        name = data[at + 4 : at + 8].decode("latin-1")
        yield 0, "chunk", name, at, n, ""
        at += 12 + n
        if name == "IEND":
            return


def _tiff_parts(data: bytes) -> Iterator[tuple]:
    for page, (order, at, entries) in enumerate(_tiff_entries(data)):
        for tag, e in sorted(entries.items()):
            first = e.values(order)[:1] if e.count else ()
            yield page, "entry", str(tag), at, len(e.data), "" if not first else str(first[0])


def _exr_parts(data: bytes) -> Iterator[tuple]:
    h = exr.header(data)
    for name, (kind, body) in h.attributes.items():
        yield 0, "attribute", name, None, len(body), kind
    for name, kind in h.channels:
        yield 0, "channel", name, None, h.width * h.height * kind.itemsize, np.dtype(kind).name


def _jxl_parts(data: bytes) -> Iterator[tuple]:
    if data.startswith(jxl.CONTAINER):
        yield from ((0, "box", kind, at, len(body), "") for kind, at, body in jxl.boxes(data))
    else:
        yield 0, "codestream", "", 0, len(data), ""


def _jxr_parts(data: bytes) -> Iterator[tuple]:
    for tag, kind, count, _ in jxr.directory(data):
        yield 0, "entry", f"{tag:04X}", None, count * {3: 2, 4: 4, 11: 4}.get(kind, 1), ""


PARTS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"png": _png_parts, "jpeg": _jpeg_parts, "gain_map_jpeg": _jpeg_parts, "tiff": _tiff_parts, "exr": _exr_parts, "jxr": _jxr_parts, "jxl": _jxl_parts}


def parts(data: bytes | None) -> Iterator[tuple]:
    """Rows of ``PART``: chunks, segments, directory entries, attributes, channels or boxes, up to the first fault."""
    kind = facade.kind_of(data)
    if kind is None:
        return
    try:
        for k, (page, *rest) in enumerate(PARTS[kind](data)):
            yield kind, page, k, *rest
    except ERRORS:
        return


def tags(data: bytes | None) -> Iterator[tuple[str, str]]:
    """Typed EXIF fields that a file has, as text."""
    try:
        found = exif.read(data) if data else None
    except ERRORS:
        return
    for name, value in vars(found).items() if found else ():
        if name == "raw":
            yield from ((f"tag {tag}", body.hex()) for tag, body in sorted(value.items()))
        elif value is not None:
            yield name, value.isoformat() if hasattr(value, "isoformat") else f"{value[0]}/{value[1]}" if isinstance(value, tuple) else str(value)


def _rows(files: DataFrame, key: str, content: str, schema: str, rows_of: Callable[[bytes | None], Iterator[tuple]]) -> DataFrame:
    """``key`` and the rows that ``rows_of`` makes of each file, one file at a time."""
    ship_package(files.sparkSession)
    spark = files.sparkSession
    full = files.select(key).schema
    for f in spark.createDataFrame([], schema).schema.fields:
        full = full.add(f)
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in full.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                found = list(rows_of(data.as_py()))
                columns = zip(*found, strict=True) if found else [()] * len(kinds)
                own = pa.array([name.as_py()] * len(found), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=full.names)

    return files.select(key, content).mapInArrow(run, full)


def described(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key`` and the columns of ``INFO`` of each file of any registered format, from its headers."""
    return _rows(files, key, content, INFO, lambda data: iter([info(data)]))


def listed(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key`` and the columns of ``PART``, a row for each part of each file."""
    return _rows(files, key, content, PART, parts)


def tagged(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``key, field, value``: a row for each EXIF field of each file."""
    return _rows(files, key, content, "field string, value string", tags)
