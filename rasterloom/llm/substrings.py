"""Exact removal of byte strings that also start in a document with a smaller doc_id.

1. Every ``WIDTH``-byte window has an anchor: the run of ``GRAM`` bytes in it with the
   smallest hash. Equal windows have equal anchors, so only anchors that two
   different texts hold can be in a repeated window.
2. Windows of a shared anchor are cut out as segments and go to a shard by the
   anchor's hash. Each shard orders its windows by a suffix array and compares
   neighbours by Kasai's prefixes: windows that share ``WIDTH`` bytes are one group
   with one smallest document.
3. An anchor that very many texts hold would fill its shard. Its windows are
   grouped within each batch of texts, cut into ranges of their hashes and merged
   across batches: each batch finds its windows in the merged range by binary search.
   Hashes only deal and order these windows; their bytes are compared.
4. A document that repeats the whole text of a smaller one, told by its SHA-256, is
   removed at once and takes no part in the above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_of, discard, documents, mix64, n_parts, staged, tasks_for, text_bytes, trim
from .suffix_array import window_order
from .winnow import unused_name
from .words import sliding_min

WIDTH = 50
GRAM = 20
#: Texts that hold an anchor before it counts as crowded; in one batch of texts so many suffice.
CROWDED = 2000
CROWDED_BATCH = 50
#: Anchors of a bucket, segment bytes of a shard and windows of a range, about.
BUCKET_ANCHORS = 700_000
SHARD_BYTES = 2 << 20
RANGE_WINDOWS = 150_000
#: Windows of crowded anchors that are cut out at once.
SLICE = 1 << 16
#: A text longer than this is walked in overlapping parts.
PART = 1 << 19
#: Text that a task of a join reads, about.
TASK_BYTES = 8 << 20
_OCCURRENCE = np.dtype([("segment", "<u4"), ("start", "<u4"), ("doc", "<i8"), ("tag", "<i8")])
_WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("body", "u1", (WIDTH,))])
_PLACE = np.dtype([("window", "<u4"), ("start", "<u4"), ("row", "<u4")])
_ROW = np.dtype([("doc", "<i8"), ("tag", "<i8")])


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(cell: pa.Scalar) -> bytes:
    packed = cell.as_py()
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view("<u8").ravel()


def anchor_runs(data: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: ``(hash of the anchor, first window, last window)``; no window leaves its text."""
    n = len(data) - WIDTH + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), none, none
    eight = _eights(data)
    m = len(data) - GRAM + 1
    h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + m]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    h = mix64(h + eight[GRAM - 8 : GRAM - 8 + m])
    low = np.uint64((1 << 24) - 1)
    at = (sliding_min((h & ~low) | np.arange(m, dtype=np.uint64), WIDTH - GRAM + 1) & low).astype(np.int64)
    windows = np.flatnonzero(text_of[:n] == text_of[WIDTH - 1 :])
    if not len(windows):
        return np.zeros(0, dtype=np.uint64), none, none
    at = at[windows]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    return h[at[new]], windows[new], windows[np.append(new[1:], len(windows)) - 1]


class Joined:
    """Parts of texts side by side: their bytes, the part of each byte, and where a byte lies in its text."""

    def __init__(self, held: list[tuple[int, int, bytes]]):
        self.raw = b"".join(p for _, _, p in held)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        # Windows must not run from one part into the next, even of one text, so parts are numbered.
        self.part_of = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
        self.texts = np.array([i for i, _, _ in held])
        self.shift = np.array([a for _, a, _ in held]) - (np.cumsum(sizes) - sizes)

    def text(self, at: np.ndarray) -> np.ndarray:
        return self.texts[self.part_of[at]]

    def place(self, at: np.ndarray) -> np.ndarray:
        return at + self.shift[self.part_of[at]]


def _parts(texts: list[bytes]) -> Iterator[Joined]:
    """Texts joined to about ``PART`` bytes.

    A longer text comes in parts that overlap by a window less one byte.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - WIDTH + 1, 0), PART):
            piece = t[at : at + PART + WIDTH - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= PART:
                yield Joined(held)
                held, size = [], 0
    if held:
        yield Joined(held)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _dest(texts: np.ndarray, dests: int) -> np.ndarray:
    """Range of texts that a text's replies go to."""
    return ((texts.view(np.uint64) >> np.uint64(32)) * np.uint64(dests)) >> np.uint64(32)


def _firsts_of(texts: list[bytes], keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct texts with their keys."""
    first: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    return list(first), keys[list(first.values())]


def _anchors(buckets: int):
    """Per batch and bucket of hashes: which texts hold which anchors.

    ``kind`` 0 goes to the anchors' bucket. An anchor that many texts of this
    batch hold is crowded for certain: its bucket only gets its name, and its texts
    hear of it by rows of ``kind`` 1, whose key is the texts' range. So no anchor fills its bucket.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("texts", pa.binary()), ("counts", pa.binary()), ("anchors", pa.binary()), ("crowded", pa.binary())])

    def row(kind: int, key: int, *parts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = _firsts_of(text_bytes(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
            found, owners = [], []
            for joined in _parts(texts):
                h, first, _ = anchor_runs(joined.data, joined.part_of)
                found.append(h)
                owners.append(joined.text(first))
            if not found:
                continue
            h, owner = np.concatenate(found), np.concatenate(owners)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            loud = np.zeros(len(h), dtype=bool)
            ordered = np.sort(h)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            often = ordered[first[np.diff(np.append(first, len(h))) > CROWDED_BATCH]]
            if len(often):
                near = np.flatnonzero(_among(h, often))
                of = np.searchsorted(often, h[near])
                pairs = _distinct(of * len(keys) + owner[near])
                many = np.bincount(pairs // len(keys), minlength=len(often)) > CROWDED_BATCH
                loud[near] = many[of]
                told = pairs[many[pairs // len(keys)]]
                text, anchor = keys[told % len(keys)].astype("<i8"), often[told // len(keys)].astype("<u4")
                to = _dest(text, buckets)
                for d in np.unique(to).tolist():
                    own = to == d
                    yield row(1, int(d), text[own], np.zeros(0, "<u4"), anchor[own], np.ones(int(own.sum()), np.uint8))
                named = often[many]
                named_bucket = ((named >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                for k in np.unique(named_bucket).tolist():
                    yield row(0, int(k), np.zeros(0, "<i8"), np.zeros(0, "<u4"), np.zeros(0, "<u4"), named[named_bucket == k].astype("<u4"))
            h, owner, bucket = h[~loud], owner[~loud], bucket[~loud]
            order = np.argsort(bucket, kind="stable")  # texts stay in order
            h, owner, bucket = h[order].astype("<u4"), owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=buckets + 1, append=buckets + 1)) if len(bucket) else np.zeros(1, dtype=np.int64)
            for a, z in zip(cuts, cuts[1:], strict=False):
                first = np.flatnonzero(np.diff(owner[a:z], prepend=-1))
                who, counts = owner[a:z][first], np.diff(np.append(first, z - a)).astype("<u4")
                yield row(0, int(bucket[a]), keys[who].astype("<i8"), counts, h[a:z], np.zeros(0, "<u4"))
            del found, owners, h, owner, bucket, order
            trim()

    return run


def _shared(dests: int):
    """Of one bucket: anchors that two texts hold, with their texts, a row for each range of texts.

    Rows of ``kind`` 1 share the buckets' numbers and pass through.
    """

    def run(every: pa.Table) -> pa.Table:
        direct = pc.equal(every.column("kind"), 1)
        told = every.filter(direct).select(["key", "texts", "anchors", "crowded"])
        table = every.filter(pc.invert(direct))
        if not table.num_rows:
            return told
        keys = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("texts")])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        anchors = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("anchors")])
        named = _distinct(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("crowded")]))
        names, of = np.unique(keys, return_inverse=True)
        pairs = _distinct((anchors.astype(np.uint64) << np.uint64(32)) | np.repeat(of, counts).astype(np.uint64))
        anchor, text = (pairs >> np.uint64(32)).astype("<u4"), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, dtype=np.int64)
        holders = np.repeat(np.diff(np.append(starts, len(anchor))), np.diff(np.append(starts, len(anchor))))
        holders[np.isin(anchor, named)] = CROWDED + 2
        keep = np.flatnonzero(holders > 1)
        anchor, text, crowded = anchor[keep], names[text[keep]], (holders[keep] > CROWDED).astype(np.uint8)
        dest = _dest(text, dests)
        order = np.argsort(dest, kind="stable")
        anchor, text, crowded, dest = anchor[order], text[order].astype("<i8"), crowded[order], dest[order]
        cuts = np.flatnonzero(np.diff(dest, prepend=dests + 1, append=dests + 1)) if len(dest) else np.zeros(1, dtype=np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        del keys, counts, anchors, of, pairs, holders, keep, order
        trim()
        found = pa.table({
            "key": pa.array([int(dest[a]) for a, _ in spans], pa.int64()),
            "texts": pa.array([text[a:z].tobytes() for a, z in spans], pa.binary()),
            "anchors": pa.array([anchor[a:z].tobytes() for a, z in spans], pa.binary()),
            "crowded": pa.array([crowded[a:z].tobytes() for a, z in spans], pa.binary()),
        })
        return pa.concat_tables([found, told])

    return run


def _by_text(table: pa.Table) -> pa.Table:
    """Of one range of texts: each text's shared anchors, the crowded ones apart."""
    text, anchor, crowded = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(n)]) for n, t in (("texts", "<i8"), ("anchors", "<u4"), ("crowded", "u1")))
    order = np.lexsort((anchor, crowded, text))
    text, anchor, crowded = text[order], anchor[order], crowded[order]
    # Batches that hold copies of a text each tell it of its crowded anchors.
    once = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (crowded[1:] != crowded[:-1])])
    text, anchor, crowded = text[once], anchor[once], crowded[once]
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    last = np.append(first[1:], len(text))
    middle = last - np.add.reduceat(crowded.astype(np.int64), first)
    cut = lambda a, z: pa.array([anchor[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())
    out = pa.table({"h1": pa.array(text[first]), "quiet": cut(first, middle), "loud": cut(middle, last)})
    del text, anchor, crowded, order
    trim()
    return out


def _segments(shards: int, ranges: int):
    """Cuts the windows of shared anchors out of texts.

    ``kind`` 0: segments for a shard. 1: sorted windows of crowded anchors of
    this batch, a row for each range. 2: where this batch holds them. A batch is
    named by its task, which writes a table, and its number there.
    """

    def row(kind: int, key: int, batch: int, a: bytes, b: bytes, c: bytes) -> pa.RecordBatch:
        packed = {k: pa.array([squeezed(x)], pa.binary()) for k, x in (("a", a), ("b", b), ("c", c))}
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "key": pa.array([key], pa.int64()), "batch": pa.array([batch], pa.int64()), **packed})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            docs = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.sort(np.unique(np.stack([docs, tags]), axis=1, return_index=True)[1])
            if len(once) < len(docs):  # rows that repeat a document
                b, docs, tags = b.take(pa.array(once)), docs[once], tags[once]
            texts = text_bytes(b.column(0))
            wanted = [_wanted(b.column(k)) for k in (3, 4)]
            batch = task << 32 | number
            sets: dict[int, tuple[dict[bytes, int], list]] = {}
            loud_windows, loud_places = [], []
            for joined in _parts(texts):
                h, first, last = anchor_runs(joined.data, joined.part_of)
                text = joined.text(first)
                key = (text.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                at = np.flatnonzero(_among(key, wanted[0]))
                columns = (h[at] % np.uint64(shards), first[at], last[at] + WIDTH, joined.place(first[at]), docs[text[at]], tags[text[at]])
                for shard, a, z, place, doc, tag in zip(*(c.tolist() for c in columns), strict=True):
                    held, places = sets.setdefault(shard, ({}, []))
                    places.append((held.setdefault(joined.raw[a:z], len(held)), place, doc, tag))
                loud = np.flatnonzero(_among(key, wanted[1]))
                if len(loud):
                    n = last[loud] - first[loud] + 1
                    every = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[loud], n)
                for k in range(0, len(every) if len(loud) else 0, SLICE):
                    at = every[k : k + SLICE]
                    places = np.zeros(len(at), dtype=_PLACE)
                    places["start"], places["row"] = joined.place(at), joined.text(at)
                    windows = np.zeros(len(at), dtype=_WINDOW)
                    windows["hash"], windows["doc"] = _window_hashes(joined.data, at), docs[places["row"]]
                    windows["body"] = np.lib.stride_tricks.sliding_window_view(joined.data, WIDTH)[at]
                    windows, of = _grouped(windows)
                    places["window"] = of + sum(map(len, loud_windows))
                    loud_windows.append(windows)
                    loud_places.append(places)
            for shard, (held, places) in sets.items():
                sizes = np.array([len(s) for s in held], dtype="<u4")
                yield row(0, shard, batch, b"".join(held), sizes.tobytes(), np.array(places, dtype=_OCCURRENCE).tobytes())
            if loud_windows:
                places = np.concatenate(loud_places)
                sorted_, of = _grouped(np.concatenate(loud_windows))
                places["window"] = of[places["window"]]
                rows = np.zeros(len(docs), dtype=_ROW)
                rows["doc"], rows["tag"] = docs, tags
                yield row(2, 0, batch, places.tobytes(), rows.tobytes(), b"")
                # The sorted windows are cut at even hash bounds, found by binary search.
                bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
                cuts = [0, *np.searchsorted(sorted_["hash"], bounds).tolist(), len(sorted_)]
                for r, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if a < z:
                        yield row(1, r, batch, sorted_[a:z].tobytes(), b"", b"")
            del texts, wanted, sets, loud_windows, loud_places
            trim()

    return run


def _wanted(column: pa.Array) -> np.ndarray:
    """Sorted ``text << 32 | anchor`` of packed anchors."""
    out = [np.zeros(0, dtype=np.uint64)]
    for i, packed in enumerate(column.to_pylist()):
        out.append(np.frombuffer(packed, "<u4").astype(np.uint64) | np.uint64(i << 32))
    return np.sort(np.concatenate(out))


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each position."""
    eight = _eights(data)
    h = np.ones(len(at), dtype=np.uint64)
    for step in [*range(0, WIDTH - 8, 8), WIDTH - 8]:
        h = mix64((h ^ eight[at + step]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _grouped(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows by hash and then bytes, each with its smallest document, and which of them each window is."""
    order = np.argsort(windows["hash"], kind="stable")
    for ties in (False, True):
        if ties:  # different windows with one hash
            order = np.lexsort((*windows["body"].T[::-1], windows["hash"]))
        ordered = windows[order]
        alike = ordered["hash"][1:] == ordered["hash"][:-1]
        same = alike.copy()
        near = np.flatnonzero(alike)
        same[near] = (ordered["body"][near] == ordered["body"][near + 1]).all(axis=1)
        if (same == alike).all():
            break
    new = np.concatenate([[True], ~same])
    first = np.flatnonzero(new)
    out = ordered[first]
    out["doc"] = np.minimum.reduceat(ordered["doc"], first)
    of = np.empty(len(windows), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return out, of


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows to remove as spans, joined where they touch."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order].astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + WIDTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tag[first].astype(np.int64)), pa.array(start[first]), pa.array(start[last] + WIDTH)], ["doc", "tag", "start", "end"])


def _shard_spans(table: pa.Table) -> pa.Table:
    """Spans that one shard's suffix array finds."""
    names: dict[bytes, int] = {}
    places = []
    for a, b, c in zip(table.column("a"), table.column("b"), table.column("c"), strict=True):
        body, at, own = unsqueezed(a), 0, []
        for n in np.frombuffer(unsqueezed(b), "<u4").tolist():
            own.append(names.setdefault(body[at : at + n], len(names)))
            at += n
        p = np.frombuffer(unsqueezed(c), _OCCURRENCE).copy()
        p["segment"] = np.array(own, dtype="<u4")[p["segment"]]
        places.append(p)
    place = np.concatenate(places)
    sizes = np.array([len(s) for s in names], dtype=np.int64)
    data = np.frombuffer(b"".join(names), dtype=np.uint8)
    del names
    ends = np.cumsum(sizes)
    order, shared = window_order(data, ends, WIDTH)
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, place["segment"], place["doc"])
    segment_of = np.repeat(np.arange(len(sizes)), sizes)
    groups = np.flatnonzero(np.concatenate([[True], shared[1:] < WIDTH]))
    low = np.minimum.reduceat(least[segment_of[order]], groups)
    smallest = np.full(len(data), np.iinfo(np.int64).max)
    smallest[order] = np.repeat(low, np.diff(np.append(groups, len(order))))
    # Each place takes the windows of its segment that a smaller document has.
    windows = sizes[place["segment"]] - WIDTH + 1
    owner = np.repeat(np.arange(len(place)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.flatnonzero(smallest[(ends - sizes)[place["segment"][owner]] + step] < place["doc"][owner])
    owner = owner[hit]
    del order, shared, least, segment_of, groups, smallest, windows
    trim()
    return pa.Table.from_batches([_spans(place["doc"][owner], place["tag"][owner], place["start"][owner] + step[hit])])


def _merged_range(table: pa.Table) -> pa.Table:
    """Smallest document of each window of a range, returned to every batch in the order of its windows."""
    runs = [np.frombuffer(unsqueezed(x), _WINDOW) for x in table.column("a")]
    merged = _grouped(np.concatenate(runs))[0]
    answers = []
    for r in runs:
        at = np.searchsorted(merged["hash"], r["hash"])
        while (wrong := np.flatnonzero((merged["body"][at] != r["body"]).any(axis=1))).size:  # other windows with this hash
            at[wrong] += 1
        answers.append(squeezed(np.ascontiguousarray(merged["doc"][at]).tobytes()))
    return pa.table({"batch": table.column("batch"), "range": table.column("key"), "docs": pa.array(answers, pa.binary())})


def _crowded_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw, names, answers in zip(b.column(0), b.column(1), b.column(2), strict=True):
            place, rows = np.frombuffer(unsqueezed(raw), _PLACE), np.frombuffer(unsqueezed(names), _ROW)
            held = answers.values
            order = np.argsort(held.field("range").to_numpy(zero_copy_only=False))
            low = np.concatenate([np.frombuffer(unsqueezed(held.field("docs")[int(k)]), "<i8") for k in order])
            own = rows[place["row"]]
            hit = low[place["window"]] < own["doc"]
            yield _spans(own["doc"][hit], own["tag"][hit], place["start"][hit])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document of ``docs(doc_id, text, ...)``: ``doc, digest, copy, spans``; rows that repeat one have one.

    ``digest`` is the SHA-256 of the text (null as empty). ``copy`` says that a smaller
    document has the same text; else ``spans`` lists spans to remove, which may
    touch or overlap (empty or null if there are none). A null doc_id counts as
    larger than all others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(doc.alias("doc"), text.alias("text"))
    known = staged(rows.select("doc", F.xxhash64("text").alias("h1"), digest_of("text").alias("digest"), F.octet_length("text").cast("long").alias("n")), "texts")
    # As a table of its own its join with the texts can split a text that very many rows repeat.
    firsts = staged(known.groupBy("h1", "digest", "n").agg(F.min("doc").alias("first")), "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    tasks_for(spark, known.agg(F.sum("n")).first()[0] or 0, TASK_BYTES)
    buckets = max(n_parts(spark) // 2, 1 + total // (15 * BUCKET_ANCHORS))
    anchored = rows.where(F.octet_length("text") >= WIDTH).select("text", F.xxhash64("text").alias("h1"))
    held = anchored.mapInArrow(_anchors(buckets), "kind int, key long, texts binary, counts binary, anchors binary, crowded binary")
    shared = held.groupBy("key").applyInArrow(_shared(buckets), "key long, texts binary, anchors binary, crowded binary")
    wanted = staged(shared.groupBy("key").applyInArrow(_by_text, "h1 long, quiet binary, loud binary"), "shared-anchors")
    sums = wanted.agg(F.sum(F.octet_length("quiet")), F.sum(F.octet_length("loud"))).first()
    quiet, loud = (sums[0] or 0) // 4, (sums[1] or 0) // 4
    # The smallest document of each distinct text, and only if it shares an anchor.
    chosen = firsts.where(F.col("n") >= WIDTH).select(F.col("first").alias("doc"), "digest", "h1").join(wanted, "h1")
    bodies = rows.where(F.octet_length("text") >= WIDTH).withColumn("digest", digest_of("text"))
    to_cut = bodies.join(chosen, ["doc", "digest"]).select("text", "doc", "h1", "quiet", "loud")
    shards, ranges = 1 + quiet * 66 // SHARD_BYTES, 1 + loud * 16 // RANGE_WINDOWS
    cut = to_cut.mapInArrow(_segments(max(shards, n_parts(spark)), ranges), "kind int, key long, batch long, a binary, b binary, c binary")
    cut = staged(cut, "segments")
    spans = cut.where("kind = 0").groupBy("key").applyInArrow(_shard_spans, "doc long, tag long, start long, end long")
    if loud:
        ranged = cut.where("kind = 1").select("key", "batch", "a").groupBy("key").applyInArrow(_merged_range, "batch long, range long, docs binary")
        answers = ranged.groupBy("batch").agg(F.collect_list(F.struct("range", "docs")).alias("answers"))
        places = cut.where("kind = 2").select("batch", F.col("a").alias("places"), F.col("b").alias("names"))
        spans = spans.union(places.join(answers, "batch").select("places", "names", "answers").mapInArrow(_crowded_spans, "doc long, tag long, start long, end long"))
    by_doc = spans.groupBy("doc", F.col("tag").alias("h1")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    named = known.join(firsts, ["h1", "digest", "n"]).select("doc", "h1", "digest", (F.col("doc") > F.col("first")).alias("copy")).distinct()
    out = staged(named.join(by_doc, ["doc", "h1"], "left").select("doc", "digest", "copy", "spans"), "spans")
    discard(known, firsts, wanted, cut)
    return out


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of what ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def within_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover in part."""
    out = []
    for a, z in spans:
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def _removals(b: pa.RecordBatch, text_at: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each text and what to remove; the last two columns are ``copy`` and ``spans``."""
    copies, spans = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
    for t, copy, found in zip(text_bytes(b.column(text_at)), copies, spans, strict=True):
        if copy:
            yield t, [(0, len(t))] if len(t) >= WIDTH else []
        else:
            yield t, union_of([(x["start"], x["end"]) for x in found or []])


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``copy`` and ``spans`` last, under unused names."""
    found = repeated_spans(docs)
    names = [unused_name(docs, n) for n in ("copy", "spans", "doc", "digest")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({names[2]: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), names[3]: digest_of(text)})
    found = found.select(F.col("doc").alias(names[2]), F.col("digest").alias(names[3]), F.col("copy").alias(names[0]), F.col("spans").alias(names[1]))
    return keyed.join(found, names[2:]).select(*(keyed[f"`{c}`"] for c in docs.columns), names[0], names[1])


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, whole characters only, and ``n_chars`` set anew if there is one.

    All rows and columns stay; a null text becomes empty, a text that is all
    repeated becomes empty too.
    """
    schema = docs.schema
    text_at, text_name = docs.columns.index("text"), "text"
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, spans in _removals(b, text_at):
                for a, z in reversed(within_characters(t, spans)):
                    t = t[:a] + t[z:]
                kept.append(t.decode("utf-8", "replace"))
            columns = list(b.columns[:-2])
            columns[text_at] = pa.array(kept, pa.string())
            if chars_at >= 0:
                columns[chars_at] = pa.array([len(t) for t in kept]).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])
            del kept, columns
            trim()

    return _with_spans(docs).mapInArrow(run, schema)


def span_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs(doc_id, text, ...)``.

    Null texts are empty; texts below the window's width lose nothing. Rows
    with one doc_id are documents side by side: neither is smaller. A null
    doc_id is larger than all others. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in _removals(b, 1):
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(t[at:a])
                    at = z
                digest.update(t[at:])
                out.append((len(t), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(rows).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_array_spans(spark, sf_dir: str) -> DataFrame:
    return span_digests(documents(spark, sf_dir))
