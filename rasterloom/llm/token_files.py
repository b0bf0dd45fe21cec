"""Token ids in binary files of fixed-width packed bits.

A file holds documents in ascending doc_id order. All numbers are little-endian:

    magic "TOKBITS1", uint32 width, uint32 block, uint64 documents, uint64 ids,
    int64 doc_id of each document, uint8 whether it has one,
    uint64 first id of each document and the number of ids,
    uint64 byte offset of each block in the payload and the payload's length,
    payload: ``block`` ids a block, ``width`` bits an id, lowest bit first.

``width`` is the fewest bits that hold the vocabulary. Blocks start on whole
bytes, so any range of ids unpacks from the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh_path, n_parts, staged, trim
from .tokens import word_encoder

MAGIC = b"TOKBITS1"
BLOCK = 4096
#: Ids in a file at most, but for a document that is longer alone.
FILE_IDS = 2 << 20
#: Files that a reading task opens, about.
FILES_PER_TASK = 16
_HEAD = struct.Struct("<8sIIQQ")


def width_of(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each. Eight ids fill ``width`` whole bytes, so the lanes of eight need no scatter."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    padded = np.zeros(-(-len(ids) // 8) * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(-1, 8)
    out = np.zeros((len(lanes), width), dtype=np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n).astype(np.uint32)
    groups = -(-n // 8)
    raw = np.zeros(groups * width, dtype=np.uint8)
    raw[: len(packed)] = np.frombuffer(packed, dtype=np.uint8)[: len(raw)]
    lanes = raw.reshape(groups, width)
    out = np.zeros((groups, 8), dtype=np.uint64)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        for k in range(-(-(shift + width) // 8)):
            out[:, j] |= lanes[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] >>= np.uint64(shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << width) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """A whole file."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    blocks = [pack(flat[i : i + BLOCK], width) for i in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0, *(len(x) for x in ids)]).astype("<u8")
    offsets = np.cumsum([0, *(len(b) for b in blocks)]).astype("<u8")
    names = np.array([x or 0 for x in doc_ids], dtype="<i8")
    named = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    return b"".join([_HEAD.pack(MAGIC, width, BLOCK, len(doc_ids), len(flat)), names.tobytes(), named.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to the bytes of a file."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, n, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at = _HEAD.size
        names = np.frombuffer(data, "<i8", n, at)
        named = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(x) if y else None for x, y in zip(names, named, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, vocabulary: int) -> DataFrame:
    """Writes ``docs(doc_id, text, ...)`` to files in ``folder``; a row ``file, n_docs, n_ids`` each.

    Each text's ids are followed by ``end_id``. Null texts are empty. Rows go in
    ascending doc_id, null first; those of one doc_id in the order of their
    texts' hashes, by which very many of them are split over tasks. A task
    writes under a name of its own and then renames, so a repeated task leaves
    the same files. Other columns are ignored. An empty table leaves none.
    """
    width = width_of(vocabulary)
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder = word_encoder(tokenizer, True)
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = written = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, written
            name = f"part-{task.partitionId():07d}-{written:05d}.tok"
            draft = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(file_bytes(names, ids, width))
            store.move(draft, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(names)], "n_ids": [held]})
            names, ids, held, written = [], [], 0, written + 1
            return row

        for b in batches:
            for name, encoded in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                ids.append(np.append(encoded, end))
                names.append(name)
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield flush()
        if names:
            yield flush()
        trim()

    keys = (F.col("doc_id"), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(ordered.mapInArrow(run, "file string, n_docs long, n_ids long"), "token-files")


def read_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``, unpacked from the packed bits.

    Without files the result is empty.
    """
    # Two levels of sums: one row for each task that wrote, then the files of each.
    part = F.substring("file", 6, 7)
    tasks = files.groupBy(part.alias("part")).agg(F.sum("n_ids").alias("n"))
    bases = tasks.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.withColumn("part", part).withColumn("before", F.coalesce(before, F.lit(0))).join(bases, "part").select("file", (F.col("base") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as raw:
                    f = TokenFile(raw.read())
                ids = f.ids(0, f.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(f.starts[:-1], f.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + base), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                del f, ids
                trim()

    # Only names travel; each task opens its own files.
    spread = placed.repartition(max(n_parts(spark), files.count() // FILES_PER_TASK), F.xxhash64("file"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_bit_packed_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    folder = fresh_path(spark, "tokens")
    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0, vocabulary=50257)
    return read_digests(spark, folder, files)
