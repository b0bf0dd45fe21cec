"""Decoded rasters and the schema of the file tier."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

COLOR = T.StructType([T.StructField("primaries", T.IntegerType()), T.StructField("transfer", T.IntegerType()), T.StructField("full_range", T.BooleanType()), T.StructField("float_semantics", T.StringType())])
SCHEMA = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("channels", T.IntegerType()), T.StructField("sample_format", T.StringType()), T.StructField("pixels", T.BinaryType()), T.StructField("icc", T.BinaryType()),
    T.StructField("color", COLOR), T.StructField("error", T.StringType()),
])
# Code points of the transfer functions.
BT709, SRGB, LINEAR, PQ, HLG = 1, 13, 8, 16, 18
FORMATS = {"uint8": "UInt8", "uint16": "UInt16", "float32": "Float32"}


class BadImage(ValueError):
    """The bytes break the format's rules or use a part of it that is not read here."""


@dataclass
class Color:
    primaries: int = BT709
    transfer: int = SRGB
    full_range: bool = True
    float_semantics: str = "None"


@dataclass
class Raster:
    """Samples as an array of height, width and channels."""

    samples: np.ndarray
    color: Color = field(default_factory=Color)
    icc: bytes | None = None

    def row(self, kind: str, page: int = 0) -> dict:
        h, w, c = self.samples.shape
        little = np.ascontiguousarray(self.samples, dtype=self.samples.dtype.newbyteorder("<"))
        return {"format": kind, "page": page, "width": w, "height": h, "channels": c, "sample_format": FORMATS[self.samples.dtype.name], "pixels": little.tobytes(), "icc": self.icc, "color": self.color.__dict__, "error": None}

    def rgba8(self) -> np.ndarray:
        """Display pixels; 16-bit samples keep their high byte, floats and HDR code values have none."""
        s = self.samples
        if s.dtype == np.float32:
            raise BadImage("float samples have no 8-bit projection")
        if self.color.transfer in (PQ, HLG):
            raise BadImage("HDR code values have no 8-bit projection")
        if s.dtype == np.uint16:
            s = (s >> 8).astype(np.uint8)
        h, w, c = s.shape
        out = np.full((h, w, 4), 255, dtype=np.uint8)
        out[..., :3] = s[..., :3] if c > 2 else s[..., :1]
        if c in (2, 4):
            out[..., 3] = s[..., -1]
        return out

    def floats(self) -> np.ndarray:
        """RGBA in single precision; integers over their largest value."""
        s = self.samples
        if s.dtype != np.float32:
            s = (s / np.float64(np.iinfo(s.dtype).max)).astype(np.float32)
        h, w, c = s.shape
        out = np.ones((h, w, 4), dtype=np.float32)
        out[..., :3] = s[..., :3] if c > 2 else s[..., :1]
        if c in (2, 4):
            out[..., 3] = s[..., -1]
        return out
