"""Benchmark decontamination by winnowed word fingerprints.

A benchmark window has ``WINDOW`` words (an item with fewer is one window of its
own length). Its fingerprint is the smallest hash of its ``GRAM``-word runs.
Equal windows have equal fingerprints, so the join of test and training
fingerprints misses none; each hit is then checked word for word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest_of, documents, staged, text_bytes, trim
from .words import Words, chunks, gram_hashes, sliding_min, split_words

WINDOW = 13
GRAM = 7
#: Benchmark text that is broadcast; a larger benchmark is joined.
BLOCK_BYTES = 16 << 20
#: A document is contaminated if this many times its hit words reach its words.
SHARE = 20

HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_HIT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_FILTER = 1 << 20


def window_fingerprints(words: Words, length: int) -> np.ndarray:
    """The winnowed fingerprint of the window of ``length`` words from each word on."""
    gram = min(GRAM, length)
    return sliding_min(gram_hashes(words.hashes, gram), length - gram + 1)


class Fingerprints:
    """Windows of a small benchmark, by window length."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.windows: dict[int, dict[bytes, set[str]]] = defaultdict(dict)
        self.prints: dict[int, np.ndarray] = {}
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            words = split_words([(text or "").encode()])
            n = len(words.starts)
            if not n:
                continue
            length = min(WINDOW, n)
            prints[length].append(window_fingerprints(words, length))
            for i in range(n - length + 1):
                self.windows[length].setdefault(words.joined(i, length), set()).update([] if item is None else [item])
        for length, found in prints.items():
            self.prints[length] = np.unique(np.concatenate(found))

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: its words, the merged spans of hit words, and the items that hit."""
        words = split_words(texts)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        text_of = words.texts()
        for length, prints in sorted(self.prints.items()):
            found = window_fingerprints(words, length)
            seen = np.zeros(_FILTER, dtype=bool)
            seen[prints & np.uint64(_FILTER - 1)] = True
            maybe = np.flatnonzero(seen[found & np.uint64(_FILTER - 1)])
            at = np.minimum(np.searchsorted(prints, found[maybe]), len(prints) - 1)
            maybe = maybe[prints[at] == found[maybe]]
            for i in maybe[text_of[maybe] == text_of[maybe + length - 1]].tolist():
                hit = self.windows[length].get(words.joined(i, length))
                if hit is not None:
                    k = int(text_of[i])
                    start = i - int(words.bounds[k])
                    items[k] |= hit
                    spans[k].append((start, start + length))
        for k, n in enumerate(words.counts().tolist()):
            yield n, merged(spans[k]), items[k]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def unused_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str]:
    """``docs(text, ...)`` with a struct column of hits, and that column's name.

    The struct has ``n_words``, ``spans`` (starts and ends of hit words, flat) and
    ``items`` (ids, sorted as strings). A benchmark of up to ``BLOCK_BYTES`` is
    broadcast and no row moves; the fingerprints of a larger one are joined. Both
    give the same hits. Null and empty texts have
    no words and no hits; null items have none either, and a null item_id marks
    words but is in no list. Repeated rows and items count once each per row.
    An empty benchmark hits nothing. Other columns pass through unchanged.
    """
    name = unused_name(docs, "hit")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    out = docs.withColumn(name, F.lit(None).cast(HIT))
    if size > BLOCK_BYTES:
        return _by_join(docs, items, name, out.schema), name
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    return out.mapInArrow(_pass(shared, name, docs.columns.index("text")), out.schema), name


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the items with its fingerprint and length."""
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
            words = split_words([text])
            n = len(words.starts)
            if not n:
                continue
            length = min(WINDOW, n)
            prints = window_fingerprints(words, length).view(np.int64)
            windows = [words.joined(i, length) for i in range(len(prints))]
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([length] * len(prints), pa.int32()), pa.array(windows, pa.binary()), pa.array([item] * len(prints), pa.string())], ["print", "length", "window", "item"])


def _text_prints(lengths: list[int]):
    """Distinct fingerprints of each text's windows: some quarter as many as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.unique(b.column(1).to_numpy(zero_copy_only=False), return_index=True)[1]  # copies go once
            b = b.take(pa.array(first))
            keys = b.column(1).to_numpy(zero_copy_only=False)
            for at, part in chunks(text_bytes(b.column(0))):
                words = split_words(part)
                text_of = words.texts()
                for length in lengths:
                    found = window_fingerprints(words, length)
                    inside = np.flatnonzero(text_of[: len(found)] == text_of[length - 1 :])
                    own = np.unique(np.stack([keys[at + text_of[inside]], found[inside].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], ["h", "print"])
            trim()

    return run


def _text_windows(lengths: list[int]):
    """Windows of each text whose fingerprint is among its joined ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text, prints in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2), strict=True):
                words = split_words([text])
                wanted = prints.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for length in lengths:
                    at = np.flatnonzero(np.isin(window_fingerprints(words, length), wanted)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(at), pa.binary()), pa.array(at, pa.int64()), pa.array([length] * len(at), pa.int32()), pa.array([words.joined(i, length) for i in at], pa.binary())], ["digest", "start", "length", "window"])
            trim()

    return run


def _by_join(docs: DataFrame, items: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    """Hits by a join of fingerprints, then of the windows that these leave, word for word.

    Fingerprints of the texts meet those of the items; only texts that share one
    give windows, and these are joined by length and words. Copies of a text are
    looked up once.
    """
    windows = staged(items.select("item", "text").mapInArrow(_item_windows, "print long, length int, window binary, item string").distinct(), "item-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("h"))
    own = texts.mapInArrow(_text_prints(lengths), "h long, print long")
    joined = staged(own.join(windows.select("print").distinct(), "print", "left_semi").distinct(), "joined-prints")
    wanted = joined.groupBy("h").agg(F.collect_list("print").alias("prints"))
    bodies = texts.join(wanted, "h").select(digest_of("text").alias("digest"), "text", "prints").dropDuplicates(["digest"])
    found = bodies.mapInArrow(_text_windows(lengths), "digest binary, start long, length int, window binary")
    exact = found.join(windows.drop("print"), ["length", "window"])
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    hits = staged(exact.groupBy("digest").agg(F.collect_set(span).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")), "joined-hits")
    key = unused_name(docs, "digest")
    keyed = docs.withColumn(key, digest_of(text)).join(hits.select(F.col("digest").alias(key), F.struct("spans", "items").alias(name)), key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), name)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [n for _, part in chunks(text_bytes(b.column(text_at))) for n in split_words(part).counts().tolist()]
            rows = []
            for n, hit in zip(counts, b.column(b.num_columns - 1).to_pylist(), strict=True):
                spans = merged([(x["start"], x["end"]) for x in hit["spans"]]) if hit else []
                rows.append({"n_words": n, "spans": [x for s in spans for x in s], "items": sorted(hit["items"]) if hit else []})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, _HIT)], names=b.schema.names)
            trim()

    return keyed.mapInArrow(run, schema)


def _pass(shared, name: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Fingerprints(shared.value)
        for b in batches:
            texts = text_bytes(b.column(text_at))
            rows = []
            for _, part in chunks(texts):
                for n, spans, items in block.hits(part):
                    rows.append({"n_words": n, "spans": [x for s in spans for x in s], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, _HIT)], names=[*b.schema.names[:-1], name])
            del texts, rows
            trim()

    return run


def n_hit(spans: F.Column) -> F.Column:
    """Hit words: ends minus starts of the flat spans."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hit: F.Column) -> F.Column:
    hits = n_hit(hit["spans"])
    return (hits > 0) & (SHARE * hits >= hit["n_words"])


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans``, from each span's first byte to its last."""
    words = split_words([text])
    parts, at = [], 0
    for a, z in spans:
        parts.append(text[at : int(words.starts[a])])
        at = int(words.ends[z - 1])
    return b"".join([*parts, text[at:]])


def _without_hits(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs``' columns of ``found`` with the hit words cut out; the last column of ``found`` has the hits."""
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [x["spans"] for x in b.column(b.num_columns - 1).to_pylist()]
            texts = [without_words(t, list(zip(s[::2], s[1::2], strict=True))).decode("utf-8", "replace") for t, s in zip(text_bytes(b.column(text_at)), spans, strict=True)]
            columns = list(b.columns[:-1])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at >= 0:
                columns[chars_at] = pa.array([len(t) for t in texts]).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
            trim()

    return found.mapInArrow(run, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, and without the hit words of the others.

    A cut makes neighbours of the words around it; if these are another hit, it
    is cut as well, until none is left. ``n_chars``, if there is one, is set anew
    where text was cut. All columns are kept.
    """
    found, name = with_hits(docs, benchmark)
    found = staged(found.where(~F.coalesce(contaminated(F.col(name)), F.lit(False))), "hits")
    hit = F.coalesce(F.size(F.col(name)["spans"]), F.lit(0)) > 0
    out = found.where(~hit).select(*docs.columns)
    while found.where(hit).limit(1).count():
        # Each round shortens every text that is left, so this ends.
        found = staged(with_hits(_without_hits(found.where(hit), docs), benchmark)[0], "hits")
        out = out.union(found.where(~hit).select(*docs.columns))
    return out


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, name = with_hits(docs, documents(spark, sf_dir, "benchmark"))
    hit = F.col(name)
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        n_hit(hit["spans"]).alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hit["items"]), 256).alias("items_sha256"),
        contaminated(hit).alias("contaminated"),
    )
