"""Quality rules, url rules, decontamination, toxicity and shards."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import quality, sharding, toxicity, urls, winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


@pytest.mark.parametrize("bits", [24, 4])
def test_quality_counts(docs, monkeypatch, bits):
    monkeypatch.setattr(quality, "_POSITION_BITS", bits)  # few bits force the path for clashing hashes
    got = quality.base_counts(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, *brute_counts(r.text)) for r in docs.collect())


def test_binomial_tail(spark):
    cases = [(3, 1000, 0.01), (0, 300, 0.01), (400, 50_000, 0.01), (9, 700, 0.02), (20, 1000, 0.01)]
    got = spark.range(1).select(*(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias(f"c{i}") for i, (k, n, p) in enumerate(cases))).first()
    for (k, n, p), x in zip(cases, got, strict=True):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert x == pytest.approx(exact if k < n * p else 1.0, rel=1e-6)


def test_quality_verdicts(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels prove no cutoff
    assert quality.judged(no_docs, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).count() == docs.count()


def test_quality_cutoffs_reject_bad_and_spare_good(spark):
    ratios = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.when(F.col("id") % 10 == 0, 0.9).otherwise(0.001).alias("symbol_ratio"), F.lit(0.0).alias("dup_line_ratio"), F.lit(0.0).alias("repeat_ratio"), F.lit(5.0).alias("word_length"))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    row = quality.cutoffs(ratios, labels, "stratum").first()
    assert 0.001 < row.max_symbol_ratio < 0.9 and row.max_dup_line_ratio is None
    # As many good as bad documents beyond every cutoff: none is safe.
    mixed = labels.withColumn("quality", F.lit(1))
    assert quality.cutoffs(ratios, mixed, "stratum").first() is None


PAGES = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://b.net/", "b.net", "/", "net/", "block"), ("https://b.net", "b.net", "", None, "allow"),
    ("x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("x://y.org/fr/#z", "y.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://ÄB/é\n/é?", "Äb", "/é\n/é", None, "allow"), ("http://h#f://g.net/", "h", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, p[0], "h") for i, p in enumerate(PAGES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, urls.judged_urls(pages, labels).collect()))
    assert got == [(i, *p[1:]) for i, p in enumerate(PAGES)]
    assert urls.judged_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_need_all_their_tokens(spark):
    rows = [(i, f"http://shop{i % 3}.example.com/{'pills/cheap' if i % 2 else 'pills' if i % 4 else 'cheap'}/{i}") for i in range(400)]
    pages = spark.createDataFrame([*rows, (1000, "http://new.example.com/cheap/pills/1"), (1001, "http://new.example.com/pills/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judged_urls(pages, labels).collect()}
    assert got[1000] == "block" and got[1001] == "allow"
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))


def brute_hits(text, windows):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for m in {len(k) for k in windows}:
        for i in range(len(w) - m + 1):
            if (found := windows.get(tuple(w[i : i + m]))) is not None:
                items |= found
                hit.update(range(i, i + m))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_winnowing_matches_brute_force(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(winnow, "BLOCK_BYTES", block)
    long = max((r.text or "" for r in docs.collect()), key=len)
    texts = ["passage of well over fifty bytes is in several documents of the corpus", " ".join(long.split()[100:140]), "alpha beta", "word", "", None, "... ", " ".join(long.split()[500:520]) + " other words", "kappa iota kappa"]
    items = [(f"i{k}", t) for k, t in enumerate(texts)] + [("i2", "alpha beta"), (None, "eta. zeta, eta.")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).update([i] if i else [])
    found, name = winnow.with_hits(docs, benchmark)
    assert name == "_hit" and found.columns[:-1] == docs.columns
    for r in found.select("text", F.col(name).alias("h"), winnow.n_hit(F.col(name)["spans"]).alias("n")).collect():
        assert (r.h.n_words, r.n, r.h["items"]) == brute_hits(r.text, windows)
    kept = winnow.clean_documents(docs, benchmark)
    assert kept.schema == docs.schema and kept.count() < docs.count()
    assert winnow.clean_documents(no_docs, benchmark).count() == 0
    assert winnow.clean_documents(docs, benchmark.limit(0)).count() == docs.count()


def test_toxicity_learns_and_spares(spark, no_docs):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [f"w{rng.integers(60)}" for _ in range(60)] + ["vileness", "vilest"] * 2 * bad
        rows.append((i, " ".join(rng.permutation(words)), 0.1))
        if i // 6 % 3:
            labels.append((i, int(bad), 1))
    rows += [(None, "vilest vileness vile words", 0.0), (5000, None, 0.0), (5001, "", 0.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (77777, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001))
    kept = toxicity.accepted(docs, known)
    assert kept.schema == docs.schema and kept.count() < len(rows)
    assert toxicity.toxicity(no_docs, known).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, known.limit(0)).collect()} == {0.0}


def test_shards(spark, docs, no_docs):
    out = sharding.sharded(docs, ["doc_id", "text"]).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(8)) and len(out) == docs.count()
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert sharding.sharded(no_docs, ["doc_id"]).count() == 0


def test_shards_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 20)
    rows = spark.range(1003).select(F.col("id").alias("doc_id"))
    out = sharding.sharded(rows, ["doc_id"]).toPandas()
    assert out.groupby("shard").size().isin([125, 126]).all()
    assert (out.sort_values(["shard", "slot"]).groupby("shard").slot.apply(lambda s: (s.to_numpy() == np.arange(len(s))).all())).all()


def test_communication_matrix():
    m = sharding.communication_matrix([100, 0, 57, 1], 8, 3)
    assert m.sum(axis=1).tolist() == [100, 0, 57, 1] and m.min() >= 0
    assert sorted(m.sum(axis=0).tolist()) == [19] * 2 + [20] * 6




@pytest.mark.parametrize(("good", "bad", "sample"), [(30, 50, 20), (50, 30, 70), (400, 3000, 900), (7, 9, 8), (100, 100, 1)])
def test_large_urns_follow_the_exact_law(good, bad, sample):
    rng = np.random.default_rng(4)
    n = 20_000
    seen = np.bincount([sharding._hypergeometric(rng, good, bad, sample, limit=0) for _ in range(n)], minlength=good + 1)
    law = np.array([math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) if k <= sample and sample - k <= bad else 0.0 for k in range(good + 1)])
    assert not seen[law == 0].any()
    often = n * law >= 5
    chi = ((seen - n * law)[often] ** 2 / (n * law)[often]).sum()
    assert chi < often.sum() + 5 * math.sqrt(2 * often.sum()) + 5


def test_huge_urns():
    rng = np.random.default_rng(5)
    good, bad, sample = 3 * 10**12, 7 * 10**12, 10**9
    draws = np.array([sharding._hypergeometric(rng, good, bad, sample) for _ in range(3000)], dtype=np.float64)
    spread = math.sqrt(sample * 0.21 * (1 - sample / (good + bad)))
    assert abs(draws.mean() - 0.3 * sample) < 5 * spread / math.sqrt(3000)
    assert 0.95 < draws.std() / spread < 1.05
    assert {sharding._hypergeometric(rng, 2 * 10**9, 0, 5), sharding._hypergeometric(rng, 0, 2 * 10**9, 5)} == {0, 5}


def test_shuffles_are_uniform(spark):
    """Every row is about equally often in every shard, whatever its partition and size of group."""
    rows = spark.createDataFrame([(i,) for i in range(24)], "doc_id long")
    seen = np.zeros((24, 8))
    for seed in range(25):
        for r in sharding.sharded(rows, ["doc_id"], seed=1000 + 7 * seed).collect():
            seen[r.doc_id, r.shard] += 1
    chi = ((seen - 25 / 8) ** 2 / (25 / 8)).sum()
    assert chi < 24 * 7 + 6 * math.sqrt(2 * 24 * 7)


def test_shards_of_clashing_names_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 50)
    rows = spark.createDataFrame([(1, "x", 5, 6, 7)] * 700 + [(None, None, 1, 2, 3)] * 100, "doc_id long, text string, shard int, part int, hash int")
    out = sharding.sharded(rows, ["doc_id", "text"])
    assert out.columns == [*rows.columns, "_shard", "slot"]
    got = out.collect()
    slots = {}
    for r in got:
        slots.setdefault(r["_shard"], []).append(r.slot)
    assert {len(v) for v in slots.values()} == {100} and all(sorted(v) == list(range(100)) for v in slots.values())


def test_cutoffs_count_a_text_once(spark):
    """Copies and repeated rows prove nothing: 600 distinct good texts are too few, 1,200 are enough."""
    for n, proven in ((600, False), (1200, True)):
        labels = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
        ratios = spark.range(12_000).select(
            F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.when(F.col("id") % 10 == 0, -F.col("id")).otherwise(F.col("id") % n).alias("text_hash"),
            F.when(F.col("id") % 10 == 0, 0.9).otherwise(0.001).alias("symbol_ratio"), *(F.lit(0.0).alias(r) for r in ("dup_line_ratio", "repeat_ratio", "word_length")),
        )
        found = quality.cutoffs(ratios.union(ratios), labels, "stratum").first()
        assert (found is not None and found.max_symbol_ratio is not None) == proven


def brute_rules(rows):
    """Urls that some combination of tokens condemns, from all subsets of their tokens."""
    from itertools import combinations

    tokens = [frozenset(t) for t, _ in rows]
    base = sum(b for _, b in rows) / len(rows)
    seen = {}
    for t, bad in rows:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                n, m = seen.get(c, (0, 0))
                seen[c] = (n + 1, m + bad)
    z = urls.ERRORS
    found = []
    for c, (n, m) in seen.items():
        p = m / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if m >= urls.MIN_COUNT and p >= urls.MIN_CONFIDENCE and low >= urls.MIN_LIFT * base:
            found.append(frozenset(c))
    return {i for i, t in enumerate(tokens) if any(c <= t for c in found)}


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_match_all_combinations(spark, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        t = sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))})
        bad = rng.random() < (0.85 if {"a", "b"} <= set(t) or "h" in t and "c" not in t else 0.15)
        rows.append((t, bad))
    labelled = spark.createDataFrame([(t, b, str(i)) for i, (t, b) in enumerate(rows)], "tokens array<string>, bad boolean, url string")
    mined = urls.mined_rules(labelled.select("tokens", "bad"))
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    got = {int(r.url) for r in urls.blocked_urls(labelled.select("url", "tokens"), mined, counts).collect()}
    assert got == brute_rules(rows) and got


def test_held_out_urls_are_caught(spark):
    hosts = [("www.spam-farm.example.com", 0.9), ("spam-farm.example.net", 0.9), ("m.news.example.org", 0.1), ("blog.example.com", 0.1)]
    rows = [(i, f"https://{hosts[i % 4][0]}/en/{i}", 0 if (i * 37 % 100) / 100 < hosts[i % 4][1] else 1) for i in range(1200)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(5000, "http://old.spam-farm.example.org/de/1"), (5001, "http://farm.example.org/de/1")], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 800], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judged_urls(pages, labels, rules=[]).collect()}
    held = [i for i in range(800, 1200)]
    assert all(got[i] == ("block" if i % 4 < 2 else "allow") for i in held)
    assert got[5000] == "block" and got[5001] in ("allow", "block")


def test_risk_matches_a_plain_computation():
    """Weights after training lower the class-prior-corrected risk, computed feature by feature."""
    rng = np.random.default_rng(1)
    rows, dense = [], []
    for i in range(300):
        positive = i < 100
        toxic = positive or i % 10 == 0
        name = np.unique(rng.integers(0, 40, 12) + (40 if toxic else 0))
        count = rng.integers(1, 4, len(name))
        rows.append((positive, np.stack([name, count], axis=1).astype("<i4").tobytes()))
        x = np.zeros(80)
        x[name] = count / math.sqrt(count.sum())
        dense.append(x)
    model = toxicity.train(rows, 0.1)
    assert not model.weights[80:].any()

    def risk(w, b):
        p = [1 / (1 + math.exp(-(b + float(x @ w)))) for x in dense]
        plus = sum(-math.log(max(q, 1e-12)) for q in p[:100]) / 100
        minus_p = sum(-math.log(max(1 - q, 1e-12)) for q in p[:100]) / 100
        minus_u = sum(-math.log(max(1 - q, 1e-12)) for q in p[100:]) / 200
        return 0.1 * plus + max(0.0, minus_u - 0.1 * minus_p)

    w = model.weights[:80].astype(float)
    assert risk(w, model.bias) < 0.5 * risk(np.zeros(80), 0.0)
    scores = [model.bias + float(x @ w) for x in dense]
    assert min(scores[:100]) > max(s for i, s in enumerate(scores) if i >= 100 and i % 10)


def test_toxicity_learns_from_an_id_once(spark):
    rows = [(i, "vile awful words" if i % 4 == 0 else f"fine plain words {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = once.union(once.where("doc_id < 40")).union(once.where("doc_id = 4"))
    plain, repeated = toxicity.fit(once, labels), toxicity.fit(many, labels)
    assert plain.bias == repeated.bias and (plain.weights == repeated.weights).all()
