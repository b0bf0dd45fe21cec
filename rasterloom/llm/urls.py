"""URL filtering by fixed rules and by association rules mined from labels.

Spark's FP-growth finds token combinations of labelled urls that go with a bad
label. A combination is a rule if enough bad urls hold it, most urls that hold it
are bad, and this lies so far above the share of bad urls that a lower confidence
bound says so too. Rules that a shorter rule covers are dropped. The rest match
new urls through an inverted index: a rule is listed under its rarest token, and
a url is tested only against the rules listed under its own tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, n_parts, staged

BAD = "label=bad"
MIN_SUPPORT = 0.002
#: Bad urls that a combination needs at least, however few there are.
MIN_COUNT = 20
#: Share of the labelled urls with a combination that are bad, at least.
MIN_CONFIDENCE = 0.6
#: The lower bound of that share, at this many standard errors, is at least so many times the share of all labelled urls.
MIN_LIFT = 1.5
ERRORS = 2.33
#: Index entries that are broadcast; beyond, a plain join.
MAX_BROADCAST = 50_000
#: Given rules: host and path, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest rule that fits and its verdict, or null. The rules are a short parameter."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        own_host, own_path = rule[:at], rule[at:]
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the scheme, the registered domain, labels of the host and their words, words of the path, and keys and pairs of the query."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(lowered, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(lowered, r"(?s)\?([^#]*)", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), scheme)),
        F.array(F.concat(F.lit("site:"), F.regexp_extract(host_of(lowered), r"([^.]+\.[^.]+)$", 1))),
        F.transform(F.split(host_of(lowered), r"\."), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.split(host_of(lowered), r"[.-]"), lambda x: F.concat(F.lit("word:"), x)),
        F.transform(F.split(path_of(lowered), r"[/._-]"), lambda x: F.concat(F.lit("path:"), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.split(x, "=")[0])),
    )
    return F.array_distinct(F.filter(parts, lambda x: ~x.endswith(":")))


def lower_bound(share: Column, n: Column) -> Column:
    """Wilson's lower bound of a share of ``n`` seen, ``ERRORS`` standard errors away."""
    z = ERRORS
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mined_rules(labelled: DataFrame) -> DataFrame:
    """``tokens, confidence`` of combinations that predict a bad label; ``labelled`` has ``tokens`` and ``bad``.

    Tokens that always come together are one to the miner, so a url repeated in
    very many rows adds one combination and not every subset of its tokens.
    """
    rows = staged(labelled.select("tokens", "bad", F.xxhash64(F.monotonically_increasing_id()).alias("row")), "labelled-urls")
    n = rows.count()
    least = max(MIN_COUNT, int(MIN_SUPPORT * n))
    each = rows.select("row", F.explode("tokens").alias("token"))
    # The sum of row hashes tells which rows have a token; decimals keep it from overflowing.
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(20,0)")).alias("rows")).where(F.col("n") >= least)
    classes = seen.groupBy("n", "rows").agg(F.min("token").alias("token")).select("token")
    kept = broadcast_if_small(staged(classes, "url-tokens"), MAX_BROADCAST)
    items = each.join(kept, "token").groupBy("row").agg(F.collect_set("token").alias("items"))
    baskets = rows.select("row", "bad").join(items, "row").select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    baskets = staged(baskets, "baskets")
    if not n or not baskets.where(F.array_contains("items", BAD)).limit(1).count():
        return rows.select(F.col("tokens"), F.lit(0.0).alias("confidence")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=MIN_CONFIDENCE, numPartitions=n_parts(labelled.sparkSession)).fit(baskets)
    base = rows.agg(F.avg(F.col("bad").cast("double"))).first()[0]
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    found = found.where(lower_bound(F.col("confidence"), F.round(F.col("support") * n / F.col("confidence"))) >= MIN_LIFT * base)
    rules = staged(found.select(F.sort_array("antecedent").alias("tokens"), "confidence"), "rules")
    # A rule whose tokens less one are a rule as well adds nothing.
    shorter = rules.select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("less"))
    known = rules.select(F.col("tokens").alias("less"))
    redundant = shorter.join(known, "less").select("tokens").distinct()
    return rules.join(redundant, "tokens", "left_anti").where(F.size("tokens") > 0)


def blocked_urls(urls: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls(url, tokens)`` that hold all tokens of a rule."""
    tokens = rules.withColumn("rule", F.xxhash64("tokens")).select("rule", "tokens", F.explode("tokens").alias("token"))
    rarest = tokens.join(counts, "token", "left").groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"), F.first("tokens").alias("needs"))
    index = broadcast_if_small(staged(rarest.select("token", "needs"), "rule-index"), MAX_BROADCAST)
    own = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    return own.join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0).select("url").distinct()


def judged_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url, ...)``.

    A given rule decides where one fits; else a url that a mined rule matches is
    blocked and any other allowed. A page is bad if its document's label has
    quality 0 or toxic 1 (the worst of several). Null urls and urls without
    ``://`` have empty hosts and paths, and are allowed unless mined tokens match.
    Repeated rows are judged alike, null page_ids are judged and never labelled.
    Without labels nothing is mined. Other columns are ignored.
    """
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    labelled = rows.where("url is not null").join(known, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    mined = staged(mined_rules(labelled), "mined")
    urls = staged(rows.where("url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("tokens")), "urls")
    wanted = mined.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(broadcast_if_small(staged(wanted, "rule-tokens"), MAX_BROADCAST), "token").groupBy("token").agg(F.count("*").alias("n"))
    blocked = staged(blocked_urls(urls, mined, counts), "blocked").withColumn("mined", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.join(broadcast_if_small(blocked, MAX_BROADCAST), "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined")
    fit = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return fit.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return judged_urls(documents(spark, sf_dir, "pages"), documents(spark, sf_dir, "labels"))
