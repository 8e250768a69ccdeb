"""One crawl: from the catalogue's feeds to ingested articles, with networks as injected callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import url_hash
from corpusloom.operators.articles import ingest
from corpusloom.sources import feeds
from corpusloom.sources.storage import cut_lineage


def discovered(sources: DataFrame, get: Callable, *, only: list[str] | None = None, **manners) -> DataFrame:
    """Candidates ``(source_id, feed, item_pos, title, url, category, published_at)`` of the enabled sources' feeds, as many per feed as its source allows."""
    asked = feeds.enabled_sources(sources, only).select("source_id", "max_items", F.explode_outer("rss").alias("feed")).where(F.col("feed").isNotNull())
    got = cut_lineage(feeds.fetch(asked, get, url_col="feed", **manners))
    items = feeds.candidates(feeds.parse_feeds(got.where("status = 200").select("source_id", "feed", F.col("body").alias("xml"))))
    capped = items.join(got.select("source_id", "feed", "max_items"), ["source_id", "feed"])
    # Positions count all items of the feed, as they do where none is left out.
    return capped.where(F.coalesce(F.col("max_items"), F.lit(0)) < 1).unionByName(capped.where(F.col("item_pos") < F.col("max_items"))).drop("max_items")


def crawl(sources: DataFrame, stored: DataFrame, robots: DataFrame, get: Callable, *, now: Column, batch: int, only: list[str] | None = None, known: Callable[[DataFrame], DataFrame] | None = None, **manners) -> tuple[DataFrame, DataFrame]:
    """(outcomes as ``ingest`` gives them, robots rows to keep) of one crawl.

    ``known`` is as for ``ingest``; ``stored`` is what earlier crawls inserted, ``robots`` what ``refresh_robots`` gave last.
    URLs that are stored, and those that robots rules close, are never fetched.  Ids follow
    source, feed and position, and ``batch`` keeps them apart from other crawls'.
    """
    found = discovered(sources, get, only=only, **manners)
    order = F.monotonically_increasing_id() + F.lit(batch << 44)
    numbered = cut_lineage(found.orderBy("source_id", "feed", "item_pos").withColumn("id", order))
    hashed = numbered.withColumn("url_hash", url_hash(F.col("url")))
    seen = stored.select("url_hash").distinct() if known is None else known(hashed.select("url_hash")).withColumnRenamed("key", "url_hash")
    unseen = hashed.join(seen, "url_hash", "left_anti")
    rules = cut_lineage(feeds.refresh_robots(unseen, robots, get, now=now, **manners))
    judged = feeds.robots_allow(unseen.dropDuplicates(["url_hash"]).select("url_hash", "url"), rules)
    pages = cut_lineage(feeds.fetch(judged.where("allowed"), get, **manners).select("url_hash", F.when(F.col("status") == 200, F.col("body")).alias("html"), F.lit(True).alias("_fetched")))
    found_pages = judged.select("url_hash", "allowed").join(pages, "url_hash", "left")
    rows = hashed.join(found_pages, "url_hash", "left")
    whole = rows.select("id", "source_id", "url", "title", "category", "published_at", now.cast("timestamp").alias("fetched_at"), F.coalesce("allowed", F.lit(True)).alias("allowed"), "html")
    return ingest(whole, stored, as_of=now, known=known), rules
