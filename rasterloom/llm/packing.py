"""Best-fit packing of token pieces by a linear grouping scheme.

Only the histogram of piece lengths reaches the driver; it has no more entries
than a sequence has tokens, however many documents there are. The plan is made
on counts, as runs of alike sequences:

1. large lengths fall into groups of equally many pieces and are rounded up to
   the largest of their group;
2. configurations of these few sizes are chosen, each the largest size left and
   the fullest complement, and used as often as the counts allow;
3. the real pieces of each group take its slots, longest first, which leaves
   each run the room that rounding had wasted;
4. small lengths go, longest first, where they fit best.

A piece then finds its sequence from its length and its position among the
pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, staged, trim
from .ordinals import with_ordinals
from .tokens import release, word_encoder

SEQUENCE = 4096
END_ID = 1
#: A plan is made for each share of a sequence above which lengths are large, and each number of groups; the shortest counts.
LARGE = (1 / 8, 1 / 4, 1 / 3, 1 / 2)
GROUPS = (8, 16, 32)


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, hold: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each text's ids and ``end_id``, cut only if longer than ``size``."""
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, False)
        for b in batches:
            out = []
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end)
                for k, at in enumerate(range(0, len(ids), size)):
                    cut = ids[at : at + size]
                    out.append((name, k, at, len(cut), zlib.crc32(cut)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if not hold:
            release(tokenizer, False)
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``n`` sequences with the same lengths in the same order: ``(length, how many)``."""

    n: int
    slots: list[tuple[int, int]] = field(default_factory=list)
    room: int = 0


def groups_of(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in up to ``groups`` groups of equally many pieces; a length may be in several."""
    total = sum(histogram.values())
    share = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    left = 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not left:
                out.append([])
                left = share
            take = min(n, left)
            out[-1].append((length, take))
            n, left = n - take, left - take
    return out


def fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How often to take each size, within its count, to fill ``room`` most."""
    reach = np.full(room + 1, -1, dtype=np.int64)  # last size used to reach this fill
    reach[0] = len(sizes)
    states = []
    for k, size in enumerate(sizes):
        states.append(reach.copy())
        have = reach >= 0
        for _ in range(min(counts[k], room // size)):
            moved = np.zeros_like(have)
            moved[size:] = have[:-size]
            new = moved & (reach < 0)
            if not new.any():
                break
            reach[new] = k
            have = new
    out = [0] * len(sizes)
    fill = int(np.flatnonzero(reach >= 0)[-1])
    for k in range(len(sizes) - 1, -1, -1):
        while fill and states[k][fill] < 0:
            out[k] += 1
            fill -= sizes[k]
    return out


def configurations(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, list[int]]]:
    """``(times, how often each size)`` that use up ``counts`` of the rounded sizes, descending."""
    left, out = list(counts), []
    for first in range(len(sizes)):
        while left[first]:
            left[first] -= 1
            rest = fullest(sizes, left, room - sizes[first])
            left[first] += 1
            rest[first] += 1
            times = min(left[k] // c for k, c in enumerate(rest) if c)
            out.append((times, rest))
            left = [n - times * c for n, c in zip(left, rest, strict=True)]
    return out


def substituted(group_list: list[list[tuple[int, int]]], chosen: list[tuple[int, list[int]]], room: int) -> list[Run]:
    """Runs with the real lengths of each group in its slots."""
    queues = [list(reversed(g)) for g in group_list]
    out: list[Run] = []
    for times, config in chosen:
        slots = []
        for k, c in enumerate(config):
            for _ in range(c):
                taken, need = [], times
                while need:
                    length, n = queues[k].pop()
                    use = min(n, need)
                    taken.append((length, use))
                    need -= use
                    if n > use:
                        queues[k].append((length, n - use))
                slots.append(taken)
        # Cut the sequences wherever one of their slots changes its length.
        cuts = sorted({0, times, *(int(x) for s in slots for x in np.cumsum([n for _, n in s]))})
        at = [0] * len(slots)
        ends = [np.cumsum([n for _, n in s]) for s in slots]
        for a, z in zip(cuts, cuts[1:], strict=False):
            lengths = []
            for j, s in enumerate(slots):
                while ends[j][at[j]] <= a:
                    at[j] += 1
                lengths.append(s[at[j]][0])
            out.append(Run(z - a, [(x, 1) for x in lengths], room - sum(lengths)))
    return out


def best_fit(runs: list[Run], small: dict[int, int], room: int) -> list[Run]:
    """Puts small pieces, longest first, where the room left is smallest; opens sequences for the rest."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        by_room[r.room].append(r)
    rooms = sorted(by_room)

    def hold(r: Run) -> None:
        if not by_room[r.room]:
            insort(rooms, r.room)
        by_room[r.room].append(r)

    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = min(left, room // length)
                hold(Run(max(1, left // per), [], room))
                continue
            r = by_room[rooms[at]].pop()
            if not by_room[rooms[at]]:
                rooms.pop(at)
            per = min(left, r.room // length)
            n = min(r.n, left // per)
            if n < r.n:
                hold(Run(r.n - n, list(r.slots), r.room))
            hold(Run(n, [*r.slots, (length, per)], r.room - per * length))
            left -= n * per
    return [r for same in by_room.values() for r in same]


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Run]:
    """Runs of sequences that hold exactly the pieces of ``histogram``: the fewest over the settings tried."""
    whole = Run(histogram.get(size, 0), [(size, 1)])
    rest = {x: n for x, n in histogram.items() if x < size}
    least = -(-sum(x * n for x, n in rest.items()) // size)
    best: list[Run] | None = None
    for share in LARGE:
        for groups in GROUPS:
            runs = grouped_plan(rest, size, share, groups)
            if best is None or sequences(runs) < sequences(best):
                best = runs
            if sequences(best) == least:
                break
    return ([whole] if whole.n else []) + (best or [])


def sequences(runs: list[Run]) -> int:
    return sum(r.n for r in runs)


def grouped_plan(histogram: dict[int, int], size: int, share: float, groups: int) -> list[Run]:
    large = {x: n for x, n in histogram.items() if x > share * size}
    small = {x: n for x, n in histogram.items() if x <= share * size}
    grouped = groups_of(large, groups)
    sizes, counts = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    return best_fit(substituted(grouped, configurations(sizes, counts, size), size), small, size)


@dataclass
class Places:
    """Where the pieces of each length go, by their position among those of that length."""

    first: dict[int, np.ndarray]  # positions at which an entry starts
    entries: dict[int, np.ndarray]  # rows: first position, pieces a sequence, first sequence, offset

    @staticmethod
    def of(runs: list[Run]) -> Places:
        used: dict[int, int] = defaultdict(int)
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        sequence = 0
        for r in runs:
            offset = 0
            for length, per in r.slots:
                rows[length].append((used[length], per, sequence, offset))
                used[length] += r.n * per
                offset += length * per
            sequence += r.n
        entries = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}
        return Places({k: v[:, 0].copy() for k, v in entries.items()}, entries)

    def find(self, lengths: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for length in np.unique(lengths).tolist():
            here = np.flatnonzero(lengths == length)
            at = positions[here]
            e = self.entries[length][np.searchsorted(self.first[length], at, side="right") - 1]
            k = at - e[:, 0]
            sequence[here] = e[:, 2] + k // e[:, 1]
            offset[here] = e[:, 3] + k % e[:, 1] * length
        return sequence, offset


def packed(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, hold: bool = True) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text, ...)`` with its sequence and its place there.

    ``hold`` lets workers keep the words that they know from task to task; turn
    it off where other stages need the memory.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and
    empty texts are the end id alone. Repeated rows are packed each. Rows with a
    null doc_id are packed too. Other columns are ignored. An empty table gives
    an empty result.
    """
    cut = staged(pieces(docs, tokenizer, size, end_id, hold), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` rows at most
    places = Places.of(plan(histogram, size))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    # Where a row lies in the staged table tells repeated rows apart.
    ranked = with_ordinals(cut, "length", order, "position", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), sum(histogram.values()))
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.find(b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, found)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "position")
    return ranked.select(*columns).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
