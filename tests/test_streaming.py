"""Streams of image files."""

import numpy as np

from rasterloom.sources import exr, png
from rasterloom.streaming.files import decoded_stream, format_counts


def drained(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    return query


def test_new_files_are_decoded(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png.write(np.full((2, 3, 3), 9, np.uint8)))
    (tmp_path / "b.txt").write_bytes(b"text")
    query = drained(decoded_stream(spark, str(tmp_path)), "decoded", "append")
    assert [(r.format, r.width) for r in spark.table("decoded").collect()] == [("png", 3)]
    (tmp_path / "c.exr").write_bytes(exr.write({"Y": np.ones((4, 5), np.float32)}))
    query.processAllAvailable()
    assert sorted((r.format, r.width) for r in spark.table("decoded").collect()) == [("exr", 5), ("png", 3)]
    query.stop()


def test_counts_by_format(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(png.write(np.full((2, 2, 1), i, np.uint8)))
    (tmp_path / "x").write_bytes(b"text")
    query = drained(format_counts(spark, str(tmp_path)), "counts", "complete")
    got = {}
    for r in spark.table("counts").collect():
        got[r.format] = got.get(r.format, 0) + r.files
    assert got == {"png": 3, "unknown": 1}
    query.stop()
