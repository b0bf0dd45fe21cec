"""Toxicity by non-negative positive-unlabelled learning on hashed word features.

Positives are confirmed toxic documents, everything else is unlabelled text.
The classifier is linear over hashed words and word beginnings, trained in numpy
on the class-prior-corrected risk ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``.
When the bracket is negative the step goes against it, which keeps the
classifier from fitting the unlabelled toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix64, text_bytes, trim
from .words import chunks, split_words

#: Training sample: at most so many positives and unlabelled documents, lowest hash of doc_id first.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 5000
FOLDS = 5
BITS = 18
#: Word beginnings, in bytes, that are features besides whole words.
BEGINNINGS = (4, 5, 6)
STEPS = 200
RATE = 0.3
DECAY = 1e-6
#: Entries of the training matrix that a product takes at once.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word and word beginning, and the text that it is in."""
    words = split_words(texts)
    size = words.ends - words.starts
    text_of = words.texts()
    found, where = [words.hashes], [text_of]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        h = np.full(len(long), n, dtype=np.uint64)
        for j in range(n):
            h = (h + words.lowered[words.starts[long] + j]) * _ODD
        found.append(mix64(h))
        where.append(text_of[long])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(where)


@dataclass
class Model:
    weights: np.ndarray  # float32, one per feature
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found, where = features(texts)
        total = np.bincount(where, self.weights[found], minlength=len(texts))
        n = np.bincount(where, minlength=len(texts))
        return sigmoid(self.bias + total / np.sqrt(np.maximum(n, 1)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


def train(rows: list[tuple[bool, bytes]], prior: float) -> Model:
    """Fits the classifier by Adam on the whole sample.

    Rows are ``(positive, features)``: distinct features with their counts, as
    pairs of little-endian int32.
    """
    weights = np.zeros(1 << BITS)
    positive = np.array([p for p, _ in rows], dtype=bool)
    if not positive.any() or positive.all() or not 0 < prior < 1:
        return Model(weights.astype(np.float32), -np.inf if not positive.any() else np.inf)
    # A feature that few positives have says nothing; dropping it keeps the matrix small.
    frequent = np.zeros(1 << BITS, dtype=np.int64)
    for is_positive, f in rows:
        if is_positive:
            frequent[np.frombuffer(f, dtype="<i4")[::2]] += 1
    common = frequent >= max(3, positive.sum() // 200)
    # Every common feature is in some row, so its place among them is its column.
    names = np.flatnonzero(common)
    place = (np.cumsum(common) - 1).astype(np.int32)
    held, values = [], []
    for _, f in rows:
        name, count = np.frombuffer(f, dtype="<i4").reshape(-1, 2).T
        keep = common[name]
        held.append(place[name[keep]])
        values.append(count[keep].astype(np.float32) / np.float32(np.sqrt(max(1, int(count.sum())))))
    matrix = Ragged(np.concatenate(held), np.concatenate(values), np.cumsum([0, *map(len, held)]))
    held.clear()
    values.clear()
    n_p, n_u = positive.sum(), (~positive).sum()
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        p = sigmoid(b + matrix.times(w))
        # Logistic loss: the gradient of -log p is p - 1, that of -log(1 - p) is p.
        loss_minus = -np.log(np.maximum(1 - p, 1e-12))
        bracket = loss_minus[~positive].mean() - prior * loss_minus[positive].mean()
        if bracket >= 0:
            g = np.where(positive, prior * (p - 1) / n_p - prior * p / n_p, p / n_u)
        else:
            g = np.where(positive, prior * p / n_p, -p / n_u)
        grad = np.append(matrix.back(g, len(names)) + DECAY * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        rate = RATE * min(1.0, 2 * (STEPS + 1 - step) / STEPS)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    weights[names] = w
    return Model(weights.astype(np.float32), float(b))


class Ragged:
    """A sparse matrix by rows; products go over some million entries at once, so nothing as large as the matrix is made."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, bounds: np.ndarray):
        self.columns, self.values, self.bounds = columns, values, bounds
        n = len(bounds) - 1
        cuts = sorted({0, n, *(min(int(k), n) for k in np.searchsorted(bounds, np.arange(BLOCK, int(bounds[-1]), BLOCK)))})
        self.blocks = list(zip(cuts, cuts[1:], strict=False))

    def times(self, x: np.ndarray) -> np.ndarray:
        """The product with a value for each column."""
        out, x = np.zeros(len(self.bounds) - 1), x.astype(np.float32)
        for a, z in self.blocks:
            first, last = self.bounds[a], self.bounds[z]
            if first < last:
                rows = a + np.flatnonzero(self.bounds[a + 1 : z + 1] > self.bounds[a:z])
                out[rows] = np.add.reduceat(self.values[first:last] * x[self.columns[first:last]], self.bounds[rows] - first)
        return out

    def back(self, x: np.ndarray, n: int) -> np.ndarray:
        """The product of the turned matrix of ``n`` rows with a value for each of this one's rows."""
        out, x = np.zeros(n), x.astype(np.float32)
        for a, z in self.blocks:
            first, last = self.bounds[a], self.bounds[z]
            each = np.repeat(x[a:z], np.diff(self.bounds[a : z + 1]))
            out += np.bincount(self.columns[first:last], self.values[first:last] * each, minlength=n)
        return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows outside the held-out fold; the class prior is the toxic share of all their labels."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    p = known.where("toxic = 1").select("doc_id").orderBy(*order).limit(MAX_POSITIVE).withColumn("positive", F.lit(True))
    u = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").orderBy(*order).limit(MAX_UNLABELLED).withColumn("positive", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in text_bytes(b.column("text")):
                counted = np.stack(np.unique(features([t])[0], return_counts=True), axis=1)
                out.append(counted.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("positive"), pa.array(out, pa.binary())], ["doc_id", "positive", "features"])

    # At most MAX_POSITIVE + MAX_UNLABELLED ids, so the broadcast is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(p.union(u).distinct()), "doc_id")
    # One row for each id and side, so repeated rows don't multiply; a row has each feature once.
    held = sample.mapInArrow(run, "doc_id long, positive boolean, features binary").groupBy("doc_id", "positive").agg(F.min("features").alias("features"))
    table = held.toArrow()
    order = np.lexsort((table.column("doc_id").to_numpy(), table.column("positive").to_numpy()))
    positive, packed = table.column("positive").to_pylist(), table.column("features")
    # The features stay in the columns that came; nothing is copied.
    model = train([(positive[i], packed[int(i)].as_buffer()) for i in order], float(prior))
    del table, packed
    trim()
    return model


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(text, ...)`` with a column ``score`` appended, or the first unused name like it."""
    from .winnow import unused_name

    name, text_at = unused_name(docs, "score"), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(text_at))
            score = [s for _, part in chunks(texts) for s in shared.value.scores(part).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, name])
            trim()

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("double")).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text, ...)``.

    Scores see the text alone. Null and empty texts have no features and get the
    score of the bias. Repeated rows score alike. Of several labels of a
    document the highest counts; null labels and labels without a document are
    ignored. A doc_id is learnt from once; of several texts one counts. Without a confirmed toxic document every score is 0. Rows with a
    null doc_id are scored and never learnt from. Other columns are ignored.
    """
    model = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more, all columns kept."""
    scored = with_scores(docs, fit(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def op10_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
