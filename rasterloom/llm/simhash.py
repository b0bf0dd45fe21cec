"""SimHash near-duplicates by covering locality-sensitive hashing.

A family of 15 bit masks covers radius 3: bit position ``i`` of the 64 gets a
non-zero vector ``phi(i)`` over GF(2)^4 and mask ``v`` (1 to 15) keeps the bits
with an odd number of common ones in ``phi(i)`` and ``v``. Up to three differing
bits are three linear equations in four unknowns, so some non-zero ``v`` drops
them all: every pair within the radius agrees under that mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, staged, text_bytes, trim
from .components import connected_components
from .jaccard import SHINGLE, similar_links
from .quality import SPACE
from .winnow import unused_name

RADIUS = 3
SEED = 42
#: A masked bucket with more distinct fingerprints than this is masked a second time.
BUCKET = 2048


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions``; any set of up to ``radius`` of them is dropped whole by one mask."""
    span = 1 << (radius + 1)
    phi = {p: 1 + k % (span - 1) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (phi[p] & v).bit_count() & 1) for v in range(1, span)]


MASKS = covering_masks(list(range(64)))


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Unsigned 64-bit SimHash of the ASCII-lower-cased words of a text; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = words_per_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = hashed[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in text_bytes(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bucket_links(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same groups as all pairs of ``values`` within ``radius`` do, at most one fewer than values.

    A breadth-first sweep: each value leaves the rest when it is reached, so
    memory stays linear and no list of pairs is made.
    """
    rest = np.unique(values)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _masked(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and mask: table number and kept bits."""
    tables = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for v, m in enumerate(MASKS)))
    return fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.v", "t.key")


def _masked_again(crowded: DataFrame) -> DataFrame:
    """Crowded buckets split by a second covering family over the bits their first mask drops."""
    per_table = []
    for v, m in enumerate(MASKS):
        free = [p for p in range(64) if not m >> p & 1]
        per_table.append(F.array(*(F.lit(_signed(m | k)) for k in covering_masks(free))))
    masks = F.element_at(F.array(*per_table), F.col("v") + 1)
    return crowded.select("fp", "v", F.posexplode(masks).alias("w", "m")).select("fp", (F.col("v") * 16 + F.col("w") + 16).alias("v"), F.col("fp").bitwiseAND(F.col("m")).alias("key"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``(a, b)`` links over distinct ``fp`` whose components are those of all pairs within the radius.

    Buckets of up to ``BUCKET`` fingerprints are swept at once. A larger one
    is masked again over the bits its table drops; such a bucket keeps some 48
    bits, so it holds a bounded number of fingerprints however large the input is.
    """
    rows = _masked(fps)
    sizes = rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = staged(sizes, "buckets")
    crowded = sizes.where(F.col("n") > BUCKET).select("v", "key")
    quiet = rows.join(sizes.where(F.col("n") <= BUCKET).select("v", "key"), ["v", "key"])
    links = _sweep(quiet)
    if crowded.limit(1).count():
        links = links.union(_sweep(_masked_again(rows.join(crowded, ["v", "key"]))))
    return links.distinct()


def _sweep(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                a, b = bucket_links(members.values.to_numpy(zero_copy_only=False).view(np.uint64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held = rows.groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return held.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """SimHash components of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, fingerprint, component_id``, one row per input row.
    Fingerprints within three bits link; ``component_id`` is the smallest doc_id
    reachable. Null and empty texts share the fingerprint 0 and link like any
    other. Repeated rows share a fingerprint. Rows with a null doc_id get the
    component of their fingerprint. Other columns are ignored. An empty table
    gives an empty result.
    """
    fps = staged(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    # As a table of its own, so that its join can split a component that holds very many fingerprints.
    lows = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = rooted.join(lows, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``texts(id long, text)``, ``a`` the smaller id, that join the ids whose fingerprints link.

    A fingerprint's ids are paired with its smallest, linked fingerprints by their smallest ids.
    """
    fps = staged(fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), SHINGLE).distinct(), "fingerprints")
    lows = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "lows")
    within = fps.join(lows.where("n > 1"), "fp").where("low <> doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    ends = [lows.select(F.col("fp").alias(k), F.col("low").alias(f"low_{k}")) for k in "ab"]
    between = fingerprint_links(lows.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return within.union(between.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))).distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group, with all its columns.

    Texts link if their sets of five-word shingles have a Jaccard similarity of
    0.8 or more; all texts without words link. Pairs come from the covering masks
    of five-word fingerprints and, for the similar ones that these do not reach,
    from the exact join; both are verified. Rows that repeat a doc_id are
    documents side by side if their texts differ; of near-duplicates among them
    the one with the smallest hash stays. Null doc_ids are kept: nothing names them.
    """
    id_, low = unused_name(docs, "id"), unused_name(docs, "low")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(F.translate(text, SPACE, "") == "", F.lit("")).otherwise(text)
    doc = F.col("doc_id").cast("long")
    named = docs.where("doc_id is not null").withColumn(id_, F.xxhash64(text))
    held = named.select(doc.alias("doc"), F.col(id_).alias("id"), F.xxhash64(F.lit(1), text).alias("other"), F.octet_length(text).alias("size"))
    nodes = staged(held.groupBy("id").agg(F.min("doc").alias("low"), ((F.min("other") != F.max("other")) | (F.min("size") != F.max("size"))).alias("clash")), "nodes")
    # Different texts with one hash are left as they are; none is expected.
    clashes = nodes.where("clash").select("id")
    clash = clashes.limit(1).count() > 0
    texts = named.select(F.col(id_).alias("id"), text.alias("text"))
    texts = texts.join(clashes, "id", "left_anti") if clash else texts
    links = similar_links(texts, fingerprint_pairs(texts))
    roots = connected_components(links).withColumnRenamed("node", "id")
    rooted = staged(nodes.where("not clash").join(roots, "id", "left").select(F.coalesce("root", "id").alias("root"), F.struct("low", "id").alias("first")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.low").alias(low), F.col("first.id").alias(id_))
    keyed = named.withColumn(low, doc)
    kept = keyed.join(staged(firsts, "firsts"), [low, id_], "left_semi").dropDuplicates([low, id_]).select(*docs.columns)
    if clash:
        kept = kept.union(named.join(clashes.withColumnRenamed("id", id_), id_, "left_semi").select(*docs.columns))
    return kept.union(docs.where("doc_id is null"))


def op6_simhash_covering(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
