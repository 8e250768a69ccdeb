"""URL filter by association rules.

A URL is a set of tokens: host labels and their hyphenated parts, host suffixes, path
directories, extension and query keys.  FP-growth over labelled URLs finds frequent token
combinations; a combination predicts its label if enough URLs bear it out.  Rules that a
shorter rule with the same or more confidence implies are pruned.  Matching inverts the
rules: each rule is listed under its rarest token, a URL's tokens are looked up, and a rule
fires for a URL that has all the rule's tokens.  Explicit rules on
host and path go first; the longest one that fits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import UPPER, LOWER, cut_lineage, look_up

#: An index of rules is broadcast if it is counted to have at most so many, of some 200 bytes each.
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the path's start; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The URL's distinct tokens; page numbers and other all-digit parts carry nothing and go."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>")))), lambda x: x != "")
    dirs = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^\d+(\.\w+)?$"))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    ext = F.regexp_extract(path, r"\.(\w{1,5})$", 1)
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    return F.array_distinct(F.concat(
        tagged("h:", F.filter(labels, lambda x: x != "")), tagged("p:", parts), tagged("d:", dirs), keys,
        F.when(ext != "", F.array(F.concat(F.lit("x:"), ext))).otherwise(F.array().cast("array<string>")),
    ))


def mine_rules(urls: DataFrame, labels: DataFrame, *, min_support: float = 0.001, min_rows: int = 8, min_confidence: float = 0.5, lift: float = 2.0, longest: int = 3, most_tokens: int = 16) -> DataFrame:
    """Rules ``(rule_id, items, confidence, bad)`` that predict a bad URL.

    ``urls`` has ``id`` and ``url``; ``labels`` has ``id`` and ``bad`` (boolean).  A rule
    needs support by ``min_rows`` URLs and a share ``min_support`` of all labelled ones, a
    confidence of ``min_confidence`` and of ``lift`` times the base rate, or half way from
    the base rate to 1 if that is less, and more confidence
    than every rule made of some of its tokens.  ``frequent_sets`` gives the bad URLs' frequent
    sets; each set's share of bad URLs is counted over all labelled URLs.  The number of
    rules is bounded by the supports: each URL backs at most the sets of ``longest`` tokens
    among its own.
    """
    known = cut_lineage(urls.select("id", F.array_sort(url_tokens(F.col("url"))).alias("items")).join(labels.where(F.col("bad").isNotNull()).select("id", "bad"), "id").where(F.size("items") > 0))
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    empty = urls.sparkSession.createDataFrame([], "rule_id long, items array<string>, confidence double, bad long")
    if not total["bad"]:
        return empty
    floor = max(min_rows, total["n"] * min_support)
    bad_sets = cut_lineage(frequent_sets(known.where("bad").select("items"), total["bad"], floor, longest, most_tokens).withColumn("rule_id", F.xxhash64("items")))
    # URLs alike in their tokens are one row with its number.
    alike = known.groupBy("items").agg(F.count(F.lit(1)).alias("id_n")).withColumn("id", F.struct(F.xxhash64("items"), F.col("id_n").alias("n")))
    every = matches(alike.select("id", "items"), bad_sets.select("rule_id", "items")).groupBy("rule_id").agg(F.sum("id.n").alias("n"))
    base = total["bad"] / total["n"]
    scored = cut_lineage(bad_sets.join(every, "rule_id").withColumn("confidence", F.col("bad") / F.col("n")).where(F.col("confidence") >= max(min_confidence, min(lift * base, base + (1 - base) / 2))))
    # A rule goes if a proper part of it is a rule at least as sure: parts are found through the same index.
    parts = matches(scored.select(F.col("rule_id").alias("id"), "items"), scored.select("rule_id", "items")).where(F.col("id") != F.col("rule_id"))
    surer = parts.join(scored.select("rule_id", F.col("confidence").alias("of_part")), "rule_id").groupBy(F.col("id").alias("rule_id")).agg(F.max("of_part").alias("of_part"))
    return scored.join(surer, "rule_id", "left").where(F.col("of_part").isNull() | (F.col("of_part") < F.col("confidence"))).select("rule_id", "items", "confidence", "bad")


def frequent_sets(rows: DataFrame, total: int, floor: float, longest: int, most_tokens: int) -> DataFrame:
    """``(items, bad)``: sets of at most ``longest`` items that at least ``floor`` of the ``total`` rows have, and how many have them.

    FP-growth finds sets of all sizes, 2^k for k items that enough rows have in common.  So
    where a row has more than ``most_tokens`` frequent items, sets of up to ``longest`` are
    counted size by size instead, from rows alike in their items; the result is the same.
    """
    from pyspark.ml.fpm import FPGrowth

    alike = rows.groupBy("items").agg(F.count(F.lit(1)).alias("n"))
    # At least ``floor`` rows have each, so there are fewer than 1 / min_support times the items of a row.
    often = alike.select("n", F.explode_outer("items").alias("item")).groupBy("item").agg(F.sum("n").alias("often")).where(F.col("often") >= floor).select("item")
    listed = alike.select(F.xxhash64("items").alias("id"), "items", "n", F.explode_outer("items").alias("item")).join(F.broadcast(often), "item", "left_semi")
    kept = cut_lineage(listed.groupBy("id", "items", "n").agg(F.array_sort(F.collect_list("item")).alias("own")).groupBy("own").agg(F.sum("n").alias("n")))
    if (kept.agg(F.max(F.size("own"))).first()[0] or 0) <= most_tokens:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, floor / total), minConfidence=0.0).fit(rows).freqItemsets
        return found.where(F.size("items") <= longest).select(F.array_sort("items").alias("items"), F.col("freq").alias("bad"))
    sets, out = kept.select("own", "n", F.explode_outer(F.transform("own", lambda x: F.array(x))).alias("items")), None
    for size in range(1, longest + 1):
        if size > 1:
            longer = F.transform(F.filter("own", lambda x: x > F.element_at("items", -1)), lambda x: F.concat("items", F.array(x)))
            sets = sets.select("own", "n", F.explode(longer).alias("items"))
        counted = sets.groupBy("items").agg(F.sum("n").alias("bad")).where(F.col("bad") >= floor)
        out = counted if out is None else out.unionByName(counted)
    return out


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``(id, rule_id)`` where all of the rule's items are among the row's.

    An inverted index: each rule is listed once, under the one of its items that fewest rows
    have, so a row meets only rules that share their rarest item with it; those are then
    compared in full.
    """
    posted = rows.select("id", "items", F.explode_outer(F.array_distinct("items")).alias("item")).where(F.col("item").isNotNull())
    often = posted.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    listed = rules.select("rule_id", F.col("items").alias("need"), F.explode_outer("items").alias("item")).join(often, "item", "left")
    index = cut_lineage(listed.groupBy("rule_id", "need").agg(F.min_by("item", F.struct(F.coalesce("often", F.lit(0)), "item")).alias("item")))
    index = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    return posted.join(index, "item").where(F.size(F.array_except("need", "items")) == 0).select("id", "rule_id")


def judge(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, **limits) -> DataFrame:
    """``(id, host, path, rule, verdict, confidence)`` per row of ``pages``.

    Where no explicit rule fits, a URL is blocked if a mined rule fires for it, with that
    rule's confidence (the highest, if several), else allowed.  URLs are matched once per
    distinct token set.  Null, empty and malformed URLs have an empty host and path, no
    tokens, and are allowed.  Repeated rows have a row each; an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    mined = cut_lineage(mine_rules(own, labels, **limits))
    name, verdict = explicit(F.col("host"), F.col("path"), rules)
    judged = own.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.array_sort(url_tokens(F.col("url"))).alias("items")).withColumns({"rule": name, "verdict": verdict})
    if mined.isEmpty():
        return judged.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    judged = judged.withColumn("set_id", F.when(F.col("verdict").isNull(), F.concat_ws("\n", "items")))
    sets = cut_lineage(judged.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("items").alias("items"), F.count(F.lit(1)).alias("n")))
    fired = matches(sets.select(F.col("set_id").alias("id"), "items"), mined.select("rule_id", "items")).join(mined.select("rule_id", "confidence"), "rule_id").groupBy(F.col("id").alias("set_id")).agg(F.max("confidence").alias("confidence"))
    out = look_up(judged.select("id", "host", "path", "rule", "verdict", "set_id"), cut_lineage(fired.join(sets.select("set_id", "n"), "set_id")), ["set_id"], "n")
    by_method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), "confidence")


def verdict_digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; a page is bad if the document of its id is labelled quality 0."""
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality")).select("id", (F.col("quality") == 0).alias("bad"))
    out = judge(pages.select("page_id", "url"), marked)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence")
