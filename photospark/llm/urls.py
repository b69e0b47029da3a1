"""URL filter: listed host/path rules, then association rules mined with FP-growth and matched through their anchors."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.llm.stage import Stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "=block"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def tokens_of(url: Column) -> Column:
    """Distinct marked tokens: host labels, path segments and ending (digit runs as #), query keys."""
    parts = F.split(host_of(url), r"\.")
    segments = F.split(F.regexp_replace(F.lower(path_of(url)), "[0-9]+", "#"), "/")
    ending = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)/?$", 1)
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda q: F.regexp_extract(q, "^([^=]*)", 1))

    def marked(mark: str, xs: Column) -> Column:
        return F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    found = F.concat(marked("h:", parts), marked("p:", segments), marked("x:", F.array(F.lower(ending))), marked("q:", keys))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (verdict, host, path) rule that fits the host or a parent of it and starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mine_rules(urls: DataFrame, stage: Stage, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.6, min_lift: float = 2.0) -> DataFrame:
    """(items, confidence, support, anchor): token combinations that imply ``blocked``, from (url, blocked) rows.

    FP-growth runs over all labelled rows and all tokens that are in enough blocked rows; no other token can be in a
    rule that reaches the support. Rules below the support, confidence or lift are pruned; the anchor is a rule's
    rarest token. Their number grows with the combinations of frequent tokens inside one url.
    """
    baskets = stage.write(urls.where("url IS NOT NULL AND blocked IS NOT NULL").select(tokens_of(F.col("url")).alias("items"), "blocked"), "baskets")
    total = baskets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    support = max(min_support, min_count / max(n, 1))
    counts = stage.write(baskets.select(F.explode("items").alias("t"), "blocked").groupBy("t").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("blocked").cast("int")).alias("b")).where(F.col("b") >= support * n), "tokens")
    # at most the tokens of a url divided by the support
    frequent = [r["t"] for r in counts.select("t").collect()]
    empty = "items array<string>, confidence double, support double, anchor string"
    if not frequent or not bad:
        return urls.sparkSession.createDataFrame([], empty)
    marked = baskets.select(F.concat(F.array_intersect("items", F.lit(frequent)), F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(marked)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED) & (F.col("lift") >= min_lift))
    parts = rules.select(F.col("antecedent").alias("items"), "confidence", "support", F.explode("antecedent").alias("t")).join(counts, "t")
    return parts.groupBy("items", "confidence", "support").agg(F.min(F.struct("c", "t"))["t"].alias("anchor"))


def prune(rules: DataFrame) -> DataFrame:
    """Rules without those that hold no more than a rule of fewer of their tokens does; found through the anchors."""
    large = rules.select(F.col("items").alias("own"), F.col("confidence").alias("c"), F.explode("items").alias("anchor"))
    worse = large.join(rules, "anchor").where((F.size("items") < F.size("own")) & (F.col("confidence") >= F.col("c")) & (F.size(F.array_except("items", "own")) == 0))
    return rules.join(worse.select(F.col("own").alias("items")).distinct(), "items", "left_anti")


def fitting(pages: DataFrame, rules: DataFrame, *more: str) -> DataFrame:
    """Pairs of a url and a rule whose tokens are all in it; a rule is joined to the urls that have its anchor."""
    tokens = pages.select("url", *more, tokens_of(F.col("url")).alias("tokens"))
    return tokens.select("url", *more, "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor").where(F.forall("items", lambda i: F.array_contains("tokens", i)))


def held_out(rules: DataFrame, urls: DataFrame, error: float = 0.05) -> DataFrame:
    """The rules with ``n`` and ``bad`` on (url, blocked) rows they weren't mined from, ``low``, ``base`` and ``holds``.

    ``low`` is Wilson's lower bound of a rule's rate at ``error`` divided by the number of rules; a rule holds if it is above
    the share ``base`` of all these rows. A rule that fits none of them doesn't hold.
    """
    known = urls.where("url IS NOT NULL AND blocked IS NOT NULL")
    base = known.agg(F.coalesce(F.avg(F.col("blocked").cast("int")), F.lit(0.0)).alias("base")).first()["base"]
    z = NormalDist().inv_cdf(1 - error / max(1, rules.count()))
    seen = fitting(known, rules, "blocked").groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad"))
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    low = (rate + z * z / (2 * n) - z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return rules.join(seen, "items", "left").withColumns({"low": low, "base": F.lit(base)}).withColumn("holds", F.coalesce(F.col("low") > F.col("base"), F.lit(False)))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, best): the strongest rule (confidence, items) whose tokens are all in a url; only urls that have one."""
    return fitting(pages, rules).groupBy("url").agg(F.max(F.struct("confidence", "items")).alias("best"))


def learn_rules(taught: DataFrame, stage: Stage, fold: int | None = None, **limits) -> DataFrame:
    """The rules that decide, from (url, blocked) rows: all mined ones, or with ``fold`` those that hold on other urls.

    Urls are dealt to ``fold`` parts by hash; rules are mined from all but one part, pruned, and tested on it.
    """
    if fold is None:
        return stage.write(mine_rules(taught, stage, **limits), "rules")
    part = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(fold)) == 0
    mined = stage.write(prune(mine_rules(taught.where(~part), stage, **limits)), "mined")
    return stage.write(held_out(mined, taught.where(part)), "rules").where("holds")


def filter_urls(pages: DataFrame, labels: DataFrame, lists: list[tuple[str, str, str]], stage: Stage, fold: int | None = None, **limits) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    ``labels`` (page_id, blocked) teach the mined rules; ``fold`` and the limits are those of ``learn_rules``. A null url or one without ``://`` has empty host and path,
    no tokens, and is allowed; repeated rows and ids stay; without labels or frequent tokens nothing is mined and
    the lists alone decide; other columns are ignored.
    """
    taught = pages.select("page_id", "url").join(labels.select("page_id", "blocked"), "page_id")
    rules = learn_rules(taught, stage, fold, **limits)
    matches = stage.write(match_rules(pages, rules), "matches")
    base = pages.select("page_id", "url").join(matches, "url", "left").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "best")
    rule, verdict = listed(F.col("host"), F.col("path"), lists)
    best = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_list"), "best")
    mined = F.when(F.col("best").isNull(), "allow").otherwise("block")
    return best.select(
        "page_id", "host", "path", "rule", F.coalesce("by_list", mined).alias("verdict"),
        F.array_join(F.array_sort("best.items"), " ").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
