"""Near-duplicates by exact similarity against all pairs."""

import random

import numpy as np
import pytest

from rasterloom.llm import jaccard, simhash


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(len(a | b), 1)


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(words)


def brute_groups(texts, near=lambda a, b: likeness(a, b) >= 0.8):
    """Smallest index reachable over near pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near(texts[i], texts[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.fixture(scope="module")
def texts():
    """Bases of 6 to 400 words with copies of 0 to 8 edits, and one large group; all end in one passage."""
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(n)) for n in (6, 40, 100, 150, 200, 300, 400)]
    out = [edited(rng, b, rng.randint(0, min(8, len(b.split()) // 20))) for b in base for _ in range(8)]
    out += [edited(rng, base[4], rng.randint(1, 5)) for _ in range(25)]
    return [f"{t} this passage of seven words ends it" for t in out]


def test_sets(texts):
    for t, got in zip([*texts, "", "one two"], jaccard.shingle_sets([t.encode() for t in [*texts, "", "one two"]]), strict=True):
        assert len(got) == len(shingles(t)) and (np.diff(got.astype(object)) > 0).all()


@pytest.mark.parametrize("crowded", [4, 32])
def test_similar_links_match_all_pairs(spark, texts, monkeypatch, crowded):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    links = jaccard.similar_links(rows)
    assert all(likeness(texts[r.a], texts[r.b]) >= 0.8 for r in links.collect())
    found = {r.node: r.root for r in jaccard.connected_components(links).collect()}
    expect = brute_groups(texts)
    assert len(set(expect)) < len(expect)
    assert [found.get(i, i) for i in range(len(texts))] == expect


def test_representatives_find_every_similar_pair(spark, texts):
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not [i for i, low in enumerate(brute_groups(texts)) if low != i and i in kept]


def test_representatives_keep_texts_below_the_threshold(spark):
    """Texts whose fingerprints are within three bits though their similarity is below 0.8."""
    rng = random.Random(8)
    pairs = []
    while len(pairs) < 2:
        text = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60))
        other = edited(rng, text, 2)
        prints = [[simhash.fingerprint(t.encode(), n) for t in (text, other)] for n in (5, 3)]
        if likeness(text, other) < 0.8 and any((a ^ b).bit_count() <= 3 for a, b in prints):
            pairs += [text, other]
    rows = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(rows).collect()) == [0, 1]


def test_representatives_keep_different_texts_of_one_doc_id(spark):
    rng = random.Random(9)
    one, two = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(50)) for _ in range(2))
    rows = [(1, one), (1, two), (1, one), (2, two), (3, None), (4, " \n"), (5, "word"), (None, one)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, one), (1, two), (3, ""), (5, "word"), (0, one)])


def test_sketches_rule_out_nothing_similar():
    rng = np.random.default_rng(2)
    for n in (1, 5, 90, 3000, 20_000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, max(1, n // 10)).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            bits = [np.frombuffer(jaccard.sketch(x), dtype=np.uint64) for x in (a, b)]
            assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= apart


def test_lists_lose_only_sets_that_can_go_on_with_none():
    rng = np.random.default_rng(4)
    every = np.zeros(4000, dtype=jaccard._ENTRY)
    every["token"], every["id"], every["n"] = rng.integers(0, 120, 4000), np.arange(4000), rng.integers(1, 300, 4000)
    every["at"] = rng.random(4000) * (every["n"] // 5 + 1)
    every = every[np.lexsort((every["id"], every["n"], every["token"]))]
    kept = set(jaccard._useful(every)["id"].tolist())
    assert len(kept) < 4000
    for token in range(120):
        held = every[every["token"] == token]
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(held)), np.arange(len(held))))
        good = jaccard._possible(held[a], held[b])
        assert set(held["id"][a[good]].tolist()) <= kept
    assert not len(jaccard._useful(every[:0])) and not len(jaccard._useful(every[:1]))


def test_crowded_lists_carry_no_set_without_a_partner(spark, monkeypatch):
    """Texts of a hundred common shingles and fewer own ones than a prefix holds: common lists are long, but no two sets in them can be similar."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(104))
    texts = [" ".join([passage, *(f"w{rng.randint(0, 10**9)}" for _ in range(14 + k % 6))]) for k in range(40)]
    texts += [texts[20] + " more", texts[30] + " more"]
    carried, stage = [], jaccard.staged

    def counted(df, label):
        out = stage(df, label)
        if label == "lists":
            carried.append(out.where("b is null").count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    links = jaccard.similar_links(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert sorted((r.a, r.b) for r in links.distinct().collect()) == [(20, 40), (30, 41)]
    assert carried == [0]


def test_representatives_try_the_pairs_of_fingerprints(spark, texts, monkeypatch):
    """The covering masks give pairs that join all fingerprints within the radius, and the stage verifies them."""
    given, links = [], jaccard.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda texts, *tried: given.append((texts.collect(), *(t.collect() for t in tried))) or links(texts, *tried))
    rows = [*enumerate([*texts, f"{texts[60]} ", texts[40].upper()])]
    simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    (held, tried), = given
    held = sorted({(r.id, r.text) for r in held})
    prints = [simhash.fingerprint(t.encode(), 5) for _, t in held]
    expect = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(set(expect)) < len(expect)
    assert all(r.a < r.b for r in tried)
    pairs = {(r.a, r.b) for r in tried}
    ids = [i for i, _ in held]
    assert brute_groups(ids, lambda a, b: (min(a, b), max(a, b)) in pairs) == expect
