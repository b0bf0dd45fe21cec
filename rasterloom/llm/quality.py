"""Quality rules with risk-controlled thresholds, all in native expressions.

Each document gets ratios (symbols, repeated lines, repeated words, word length).
For every stratum and ratio, the cutoffs of a fixed grid are tested in order, from
the loosest on, on the labelled good documents: one passes if so few of them
exceed it that, were more than its share of ``MAX_FALSE`` good documents rejected
in truth, so few would be seen with a probability below ``ERROR`` divided by the
number of strata and ratios; the first that fails ends the order. (A fixed order
needs no division by the grid's size; as a stricter cutoff never rejects fewer, the
cutoffs before one that passes pass too.) Of the passing cutoffs the one that
rejects most labelled bad documents counts, if it rejects ``GAIN`` times as large a
share of them as of the good ones. So with probability 1 - ERROR no stratum loses
more than ``MAX_FALSE`` of its good documents to the cutoffs. With four strata
and four ratios that takes 1,150 good labels of a stratum, none of them rejected.

A trial is a distinct labelled text: copies under other ids and repeated rows
count once, so they make no bound look better than it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, staged

SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Share of a stratum's good documents that all cutoffs together may reject.
MAX_FALSE = 0.02
#: Probability that this fails anywhere.
ERROR = 0.05
#: A cutoff has to reject bad documents this many times as often as good ones.
GAIN = 5
RATIOS = {
    "symbol_ratio": [0.01 * 1.15**k for k in range(36)],
    "dup_line_ratio": [0.02 * k for k in range(1, 50)],
    "repeat_ratio": [0.02 * k for k in range(1, 50)],
    "word_length": [6.0 * 1.06**k for k in range(48)],
}
#: Strata whose cutoffs are broadcast; beyond, a plain join.
MAX_BROADCAST = 10_000
_POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array, each word once.

    Window hashes and positions are packed into longs and sorted, so equal
    windows are neighbours. If two different windows share the 40 hash bits that
    fit (or positions don't fit), whole hashes are sorted with their positions.
    """
    low = (1 << _POSITION_BITS) - 1

    def covered(positions: Column) -> Column:
        # Of sorted window starts, each adds the words up to the next start, three at most.
        gaps = F.transform(positions, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - x, F.lit(3))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def neighbours(s: Column, same: Callable[[Column, Column], Column], position: Callable[[Column], Column]) -> Column:
        found = F.transform(s, lambda x, i: F.when(F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)), position(x)).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(found, lambda p: p >= 0))

    def whole(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(neighbours(s, lambda a, b: a["h"] == b["h"], lambda x: x["i"]), covered))

    def packed(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        return let(keys, lambda s: F.when(clash(hashes, s), whole(hashes)).otherwise(let(neighbours(s, lambda a, b: F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS), lambda x: x.bitwiseAND(F.lit(low)).cast("int")), covered)))

    def clash(hashes: Column, s: Column) -> Column:
        at = lambda x: F.get(hashes, x.bitwiseAND(F.lit(low)).cast("int"))
        return (F.size(hashes) > low) | F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))),
            lambda i: F.coalesce((F.shiftright(F.get(s, i), _POSITION_BITS) == F.shiftright(F.get(s, i - 1), _POSITION_BITS)) & (at(F.get(s, i)) != at(F.get(s, i - 1))), F.lit(False)),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows, packed))


def base_counts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The ``carried`` columns and the word, symbol, line and repetition counts of ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    by_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        *carried,
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_words.alias("_w"),
        by_lines.alias("_l"),
    ).select(*carried, "word_chars", "n_symbols", "_w.*", "_l.*")


def with_ratios(counts: DataFrame) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counts.withColumns({
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "word_length": ratio("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series after a shift by eight."""
    shifted = x + 8
    r = 1 / shifted
    series = r / 12 - F.pow(r, 3) / 360 + F.pow(r, 5) / 1260 - F.pow(r, 7) / 1680
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + k)
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.9189385332046727 + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Upper bound, tight to rounding, of the probability of at most ``k`` among ``n`` at rate ``p``; 1 if ``k`` is not below the mean.

    Sums the terms down from ``k``. They fall at least as fast as the first
    ratio, so the terms after the last one summed are bounded by a geometric series.
    """
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    terms = F.least(k, F.ceil(40 * F.sqrt(nd * p + 1)).cast("long"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, i: Column) -> Column:
        j = kd - i + 1
        term = a["term"] * j * (1 - p) / ((nd - j + 1) * p)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    summed = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), start, step)
    ratio = kd * (1 - p) / ((nd - kd + 1) * p)
    total = let(summed, lambda s: first * (s["sum"] + F.when(terms < k, s["term"] * ratio / (1 - ratio)).otherwise(0.0)))
    return F.when(kd < nd * p, F.least(total, F.lit(1.0))).otherwise(1.0)


def cutoffs(ratios: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """``stratum`` and a cutoff for each ratio, null where none is safe.

    ``ratios`` has doc_id, the stratum, the ratio columns and may have ``text_hash``, which tells
    copies (else each doc_id is a text of its own); ``labels`` has doc_id and quality.
    Rows of one doc_id with different texts are one trial, by their largest ratios.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("_good"))
    largest = [F.max(r).alias(r) for r in RATIOS]
    each = ratios.join(known, "doc_id").groupBy(stratum, "doc_id", "_good").agg(F.min("text_hash" if "text_hash" in ratios.columns else "doc_id").alias("text_hash"), *largest)
    held = each.groupBy(stratum, "text_hash").agg(F.max("_good").alias("_good"), *largest)

    def exceeded(r: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, RATIOS[r])), lambda c: c < F.col(r)))

    # ``above`` cutoffs of the grid are exceeded: a row for each stratum, ratio and number.
    ranks = [F.struct(F.lit(r).alias("ratio"), exceeded(r).alias("above")) for r in RATIOS]
    seen = held.select(stratum, "_good", F.explode(F.array(*ranks)).alias("x")).groupBy(stratum, "x.ratio", "x.above")
    seen = staged(seen.agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")), "exceeded")
    tests = max(1, seen.select(stratum).distinct().count()) * len(RATIOS)
    totals = seen.groupBy(stratum, "ratio").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    # A document that exceeds ``above`` cutoffs is rejected by each of them.
    each = seen.where("above > 0").select(stratum, "ratio", F.explode(F.sequence(F.lit(1), "above")).alias("at"), "good", "bad")
    levels = each.groupBy(stratum, "ratio", "at").agg(F.sum("good").alias("k"), F.sum("bad").alias("k_bad")).join(totals, [stratum, "ratio"])
    passing = levels.where((F.col("n") > 0) & (F.col("k_bad") > 0)).where(binomial_tail(F.col("k"), F.col("n"), MAX_FALSE / len(RATIOS)) <= ERROR / tests)
    worth = passing.where(F.col("k_bad") * F.col("n") >= GAIN * F.col("k") * F.col("n_bad"))
    chosen = worth.groupBy(stratum, "ratio").agg(F.max_by("at", F.struct("k_bad", -F.col("k"), "at")).alias("at"))
    grids = F.create_map(*(x for r, g in RATIOS.items() for x in (F.lit(r), F.array(*map(F.lit, g)))))
    named = chosen.select(stratum, "ratio", F.get(F.element_at(grids, F.col("ratio")), F.col("at") - 1).alias("cutoff"))
    return named.groupBy(stratum).agg(*(F.max(F.when(F.col("ratio") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RATIOS))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of each row of ``docs(doc_id, text, <stratum>, ...)``.

    Null and empty texts have no words and fail the base rule. A null stratum is
    a stratum of its own. A stratum without good labelled documents, or with too
    few to prove a cutoff safe, has none and keeps what passes the base rule.
    Repeated rows are judged alike; null doc_ids are judged and never labelled.
    Of several labels of a document the best counts. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    counted = base_counts(rows, ["doc_id", "stratum", "text_hash"])
    held = staged(with_ratios(counted), "quality")
    limits = broadcast_if_small(staged(cutoffs(held, labels, "stratum"), "cutoffs"), MAX_BROADCAST)
    over = F.lit(False)
    for r in RATIOS:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return held.join(limits, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
