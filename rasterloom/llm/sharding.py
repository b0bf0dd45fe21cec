"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into partitions by a hash of their own and of their place in a staged
table, so a recomputed task finds the same rows. Each partition's counts per shard are drawn exactly (multivariate
hypergeometric, from what the shards still need), a random order within the
partition deals its rows out by those counts, and a second random order within
each shard sets the slots. Any arrangement of rows is as likely as another, for
hashes that are.
"""

from __future__ import annotations

from math import e, lgamma, log, log1p, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged
from .ordinals import ROWS, with_ordinals
from .winnow import unused_name

SHARDS = 8
SEED = 20240601
#: Partitions at most: rows of the matrix, which the driver holds.
MAX_PARTITIONS = 1 << 16
#: Numpy draws from urns below this size.
NUMPY_URN = 1_000_000_000


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition ``i`` that go to shard ``j``; shard totals differ by one at most."""
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    need = np.array([n // shards + (j < n % shards) for j in range(shards)], dtype=np.int64)
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, size in enumerate(sizes):
        left = size
        for j in range(shards - 1):
            if not left:
                break
            others = int(need[j + 1 :].sum())
            out[i, j] = _hypergeometric(rng, int(need[j]), others, left)
            left -= out[i, j]
        out[i, shards - 1] = left
        need -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int, limit: int = NUMPY_URN) -> int:
    """One exact draw. Numpy takes urns below a billion; larger ones have a sampler of the same law."""
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, sample))
    return ratio_of_uniforms(rng, good, bad, sample)


def _log_ratio(a: int, b: int) -> float:
    """ln(a! / b!), close to full precision for near arguments of any size."""
    if min(a, b) < 64:
        return lgamma(a + 1) - lgamma(b + 1)
    x, d = float(b + 1), float(a - b)
    # Stirling's series of both, with the large parts cancelled by hand.
    tail = lambda y: 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (x + d - 0.5) * log1p(d / x) + d * (log(x) - 1) + tail(x + d) - tail(x)


def ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw by rejection from a table mountain hat (Stadlober); any size of urn.

    The four factorials of the law are compared with those at its mode; the
    large logarithms cancel among them, so doubles suffice.
    """
    total = good + bad
    if not good or not bad or not sample or sample == total:
        return min(good, sample)
    low, take = min(good, bad), min(sample, total - sample)
    share = low / total
    spread = sqrt((total - take) * take * share * (1 - share) / (total - 1) + 0.5)
    centre, width = take * share + 0.5, 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
    mode = (take + 1) * (low + 1) // (total + 2)
    rest = total - low - take
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        k = int(x // 1)
        if not 0 <= k <= min(low, take):
            continue
        log_law = -(_log_ratio(k, mode) + _log_ratio(low - k, low - mode) + _log_ratio(take - k, take - mode) + _log_ratio(rest + k, rest + mode))
        if 2 * log(u) <= log_law:
            break
    # Back from the smaller colour and the smaller sample.
    if good > bad:
        k = take - k
    return good - k if take < sample else k


def sharded(df: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (from 0, gapless) appended, under the first unused names like these.

    ``identity`` names columns that tell most rows apart; rows that agree in
    all of them are told apart by where they lie in the staged table, so however
    many of them there are, they spread over partitions. Nulls are values like
    others. An empty input gives an empty result.
    """
    part, rank, ends, row, shard, slot = (unused_name(df, n) for n in ("part", "rank", "ends", "row", "shard", "slot"))
    held = staged(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    columns = [F.col(c) for c in (*identity, row)]
    n = held.count()
    parts = 1
    while parts < MAX_PARTITIONS and parts * ROWS < n:
        parts *= 2
    placed = held.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(parts)))
    counted = dict(placed.groupBy(part).agg(F.count("*")).collect())  # MAX_PARTITIONS rows at most
    order = sorted(counted)
    bounds = np.cumsum(communication_matrix([counted[p] for p in order], shards, seed), axis=1)
    matrix = held.sparkSession.createDataFrame([(int(p), [int(x) for x in e]) for p, e in zip(order, bounds, strict=True)], f"`{part}` long, `{ends}` array<long>")
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), *columns), *columns)
    dealt = placed.withColumn(rank, F.row_number().over(local) - 1).join(F.broadcast(matrix), part)
    to = dealt.withColumn(shard, F.size(F.filter(ends, lambda e: e <= F.col(rank))).cast("int"))
    to = staged(to.select(*held.columns, shard), "dealt")
    out = with_ordinals(to, shard, columns, slot, F.xxhash64(F.lit(seed + 2), *columns), n)
    return out.select(*df.columns, shard, slot)


def op7_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """Documents in 8 shards by the law ``rows``. Null texts have size 1 and the checksum of nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharded(docs, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
