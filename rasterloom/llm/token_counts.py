"""Token counts of a byte-pair vocabulary by rank-synchronous merging of ragged arrays.

Pieces of the vocabulary start with their word marks only, so a text falls into
pre-tokens (a run of word marks and what follows it) that never share a token.
Many pre-tokens are merged at once: in each round every pre-token applies its
own lowest-ranked pair, the leftmost of equals, as the library does one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .tokens import portions

MARK = "▁"
LIMIT = 4096
CACHE = 1_000_000
KEPT = 48
#: A longer pre-token is merged alone with a heap, as rounds would each pass over all of it.
LONG = 256
_FAR = np.int64(1 << 62)


class Merges:
    """Pair ranks and symbol costs read from a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("a piece spans two words")
        self.symbol: dict[str, int] = {}
        for p in score:
            for s in (p, *p):
                self.symbol.setdefault(s, len(self.symbol))
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, s in score.items():
            for k in range(1, len(p)):
                if p[:k] in self.symbol and p[k:] in self.symbol:
                    pairs[self.symbol[p[:k]], self.symbol[p[k:]]] = (order[s], self.symbol[p])
        self.pairs = pairs
        self.n = len(self.symbol)
        keys = np.array([a * self.n + b for a, b in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[by]
        self.merged = np.array([m for _, m in pairs.values()], dtype=np.int64)[by]
        # Tokens of a symbol: one, or its UTF-8 bytes if it is a character outside the vocabulary.
        self.cost = np.array([1 if s in score else len(s.encode()) for s in self.symbol], dtype=np.int64)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into ranks and merged of each pair, or -1."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), at, -1)

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        ids = self.of_char[points].astype(np.int64)
        unknown = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        return ids, np.where(ids >= 0, self.cost[ids], unknown)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        out = np.zeros(len(tokens), dtype=np.int64)
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.count_long(tokens[i])
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        if not len(short):
            return out
        sizes = sizes[short]
        sym, cost = self._symbols("".join(tokens[i] for i in short))
        starts = np.cumsum(sizes) - sizes
        out[short] = np.add.reduceat(cost, starts)
        owner, place = np.repeat(short, sizes), np.arange(len(sym))
        after = np.append(place[1:], -1)
        after[starts + sizes - 1] = -1
        before = place - 1
        before[starts] = -1
        pair = self.look_up(sym, np.where(after >= 0, sym[after], -1))
        while True:
            # The lowest rank of each sequence, leftmost first.
            key = np.where(pair >= 0, (self.ranks[pair] << 32) | place, _FAR)
            best = np.minimum.reduceat(key, starts)
            live = best < _FAR
            if not live.any():
                return out
            if live.mean() < 0.7:
                # Only sequences that still merge go on, without their merged-away symbols.
                keep = np.repeat(live, np.diff(np.append(starts, len(sym)))) & (sym >= -1)
                moved = np.cumsum(keep) - 1
                links = [np.where(x[keep] >= 0, moved[x[keep]], -1) for x in (after, before)]
                owner, sym, cost, pair = owner[keep], sym[keep], cost[keep], pair[keep]
                after, before = links
                place = np.arange(len(sym))
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                continue
            left = best[live] & 0xFFFFFFFF
            right = after[left]
            out[owner[left]] -= cost[left] + cost[right] - 1
            cost[left] = 1
            sym[left] = self.merged[pair[left]]
            sym[right] = -2
            pair[right] = -1
            after[left] = after[right]
            on = left[after[left] >= 0]
            before[after[on]] = on
            pair[left] = -1
            pair[on] = self.look_up(sym[on], sym[after[on]])
            back = left[before[left] >= 0]
            pair[before[back]] = self.look_up(sym[before[back]], sym[back])

    def count_long(self, token: str) -> int:
        """The same count for one long pre-token with a heap of pairs."""
        ids, costs = self._symbols(token)
        sym, cost = ids.tolist(), costs.tolist()
        after, before = [*range(1, len(sym)), -1], list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.pairs.get((sym[i], sym[after[i]]))):
                heapq.heappush(heap, (found[0], i, sym[i], sym[after[i]]))

        for i in range(len(sym)):
            offer(i)
        total = sum(cost)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            total -= cost[i] + cost[j] - 1
            sym[i], cost[i], sym[j] = self.pairs[a, b][1], 1, -2
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return total


class Counter:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cache: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; each distinct pre-token of a worker is merged once."""
        split = [pre_tokens(t) for t in texts]
        words = set().union(*split)
        missing = words.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = words
        new = list(missing)
        self.cache.update(zip(new, self.merges.counts([MARK + w for w in new]).tolist(), strict=True))
        found = self.cache.__getitem__
        out = [sum(map(found, parts)) for parts in split]
        for w in new:
            if len(w) > KEPT:
                del self.cache[w]
        return out


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first word mark; the text has one put before it unless it is empty."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, marks = [], ""
    for p in parts[:-1]:
        if p:
            out.append(marks + p)
            marks = ""
        else:
            marks += MARK
    return [*out, marks + parts[-1]]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process and model."""
    return Counter(path)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no token. Repeated rows count alike; null doc_ids
    stay null. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for b in batches:
            n = [x for part in portions(b.column(1).to_pylist()) for x in count(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
