"""Near-duplicate components and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from rasterloom.llm import simhash, substrings
from rasterloom.llm.suffix_array import window_order


def brute_components(fps):
    """Smallest id reachable over links of up to three bits."""
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_masks_cover_the_radius():
    rng = random.Random(1)
    for positions in (list(range(64)), [p for p in range(64) if not simhash.MASKS[3] >> p & 1]):
        masks = simhash.covering_masks(positions)
        assert len(masks) == 15
        for _ in range(2000):
            diff = sum(1 << p for p in rng.sample(positions, 3))
            assert any(not m & diff for m in masks)


def test_components_match_brute_force(docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: int(f, 16) for i, (f, _) in got.items()}
    for r in docs.collect():
        assert fps[r.doc_id] == simhash.fingerprint((r.text or "").encode(), 3)
    assert brute_components(fps) == {i: c for i, (_, c) in got.items()}
    assert simhash.near_duplicates(docs).count() == docs.count()


@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(30)}
    rows = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = simhash.connected_components(simhash.fingerprint_links(rows)).collect()
    expect = brute_components({simhash._signed(x): x for x in fps})
    found = {r.node: r.root for r in roots}
    assert {i: found.get(i, i) for i in expect} == expect


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}


def test_representatives_keep_all_columns(docs, no_docs):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) < docs.count()
    assert simhash.representatives(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("width", [10, 17, 50])
def test_window_order(width):
    for seed in range(40):
        rng = random.Random(seed)
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(width, width + 30))) for _ in range(rng.randint(1, 12))]
        segments += [segments[0][: width + 3], segments[-1]]
        data = np.frombuffer(b"".join(segments), np.uint8)
        order, shared = window_order(data, np.cumsum([len(s) for s in segments]), width)
        windows = [data[p : p + width].tobytes() for p in order]
        assert windows == sorted(windows)
        for k in range(1, len(windows)):
            n = 0
            while n < width and windows[k][n] == windows[k - 1][n]:
                n += 1
            assert n == shared[k]


def brute_spans(rows):
    """What each row loses, from every window of every smaller document."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, 1 << 62), (1 << 62) - 1 if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < ((1 << 62) - 1 if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("crowded", "batch", "part"), [(2000, 50, 1 << 19), (2, 50, 1 << 19), (3, 2, 700), (2000, 1, 700)])
def test_repeated_strings_match_brute_force(docs, spark, monkeypatch, crowded, batch, part):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 300)
    monkeypatch.setattr(substrings, "CROWDED_BATCH", batch)
    twice = spark.createDataFrame([(3, "one of two texts that share an id and this long passage as well"), (3, "another of two texts that share an id and this long passage as well"), (None, "text without an id that shares an id and this long passage as well")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(twice)
    got = sorted((tuple(r) for r in substrings.span_digests(rows).collect()), key=str)
    assert got == sorted(brute_spans([tuple(r) for r in rows.collect()]), key=str)


def test_deduplicated_texts(docs, no_docs):
    out = substrings.deduplicated(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert substrings.deduplicated(no_docs).count() == 0
    assert substrings.span_digests(no_docs).count() == 0


def test_spans_keep_whole_characters():
    text = "aéb".encode()
    assert substrings.within_characters(text, [(2, 4)]) == [(3, 4)]
    assert substrings.within_characters(text, [(0, 2)]) == [(0, 1)]
    assert substrings.union_of([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]


def test_rows_that_repeat_one_document(spark, monkeypatch):
    """One row fills several batches, and very many documents share one text."""
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 300)
    rng = random.Random(9)
    text_of = lambda rng, n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    shared = "a passage that three documents share and that is well over fifty bytes long, as told"
    body = text_of(rng, 60) + shared + text_of(rng, 50)
    copies = [(20_000 + i, "one text that very many documents hold, whole, which makes copies of all but one") for i in range(5000)]
    rows = spark.createDataFrame([(1, text_of(rng, 40) + shared), *[(2, body)] * 2500, (9000, "x" + shared), *copies], "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in substrings.span_digests(rows).collect()}
    assert substrings.span_digests(rows).count() == 7502
    assert got == set(brute_spans(list({tuple(r) for r in rows.collect()})))


def test_windows_with_one_hash_are_told_by_their_bytes():
    rows = np.zeros(6, dtype=substrings._WINDOW)
    rows["body"][:, 49] = [3, 1, 3, 2, 1, 3]
    rows["doc"] = [9, 8, 7, 6, 5, 4]
    names, of = substrings._grouped(rows)
    assert names["body"][:, 49].tolist() == [1, 2, 3] and names["doc"].tolist() == [5, 6, 4]
    assert of.tolist() == [2, 0, 2, 1, 0, 2]
