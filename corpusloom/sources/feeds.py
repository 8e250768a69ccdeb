"""Source catalogue, feeds, robots rules and fetching.

Networks are adapters: a fetcher is a callable that the caller gives.
"""

from __future__ import annotations

import html
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import first_date
from corpusloom.functions.urls import url_category, url_host

CATALOGUE = "source_id string, name string, domain string, enabled boolean, rss array<string>, max_items int"
FEED_ITEM = "source_id string, feed string, item_pos int, title string, link string, category string, published string, updated string, pubDate string, dc_date string"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The YAML list of sources as a small DataFrame; missing fields get their defaults."""
    import yaml

    with open(path, encoding="utf-8") as text:
        raw = yaml.safe_load(text) or {}
    cap = (raw.get("defaults") or {}).get("max_items_per_feed")
    rows = [(s["source_id"], s.get("name", s["source_id"]), s.get("domain", ""), bool(s.get("enabled", True)), list(s.get("rss") or []), s.get("max_items_per_feed", cap)) for s in raw.get("sources") or []]
    return spark.createDataFrame(rows, CATALOGUE)


def enabled_sources(sources: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Enabled sources, of an allow-list if there is one; an empty list restricts nothing."""
    wanted = F.col("enabled")
    return sources.where(wanted & F.col("source_id").isin(only) if only else wanted)


_ITEM = re.compile(r"<(item|entry)\b[^>]*>(.*?)(?=</\1\s*>|<\1\b|\Z)", re.S | re.I)
_FIELD = re.compile(r"<([\w:]+)\b([^>]*?)(?:/>|>(.*?)</\1\s*>)", re.S)
_ATTRIBUTE = re.compile(r"""(href|term)\s*=\s*["']([^"']*)["']""")


def _loose_items(text: str) -> list[list[tuple[str, str | None]]]:
    """(name, value) pairs of each item of a document that no XML parser takes: tags as they stand, CDATA unwrapped."""
    out = []
    for _, inside in _ITEM.findall(text):
        pairs = []
        for name, attributes, value in _FIELD.findall(inside):
            given = dict(_ATTRIBUTE.findall(attributes))
            name = name.rsplit(":", 1)[-1]
            plain = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1]), value, flags=re.S)
            chosen = given.get({"link": "href", "category": "term"}.get(name, "")) or re.sub(r"<[^>]*>", "", plain)
            pairs.append((name, html.unescape(chosen)))
        out.append(pairs)
    return out


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Items of RSS and Atom documents in ``feeds(source_id, feed, xml)``.

    A document that is no well-formed XML is read loosely, tag by tag; null documents, and
    those without items, give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        local = lambda e: e.tag.rsplit("}", 1)[-1]
        named = {"link": "href", "category": "term"}

        def items_of(text: str) -> list[list[tuple[str, str | None]]]:
            try:
                items = [e for e in ET.fromstring(text).iter() if local(e) in ("item", "entry")]
            except ET.ParseError:
                return _loose_items(text)
            return [[(local(c), c.get(named.get(local(c), "")) or c.text) for c in item] for item in items]

        for batch in batches:
            out = []
            for source, feed, text in zip(batch["source_id"], batch["feed"], batch["xml"], strict=True):
                for pos, pairs in enumerate(items_of(text or "")):
                    got: dict[str, str] = {}
                    for name, value in pairs:
                        if value and value.strip():
                            got.setdefault("dc_date" if name == "date" else name, value.strip())
                    out.append((source, feed, pos, *(got.get(k) for k in ("title", "link", "category", "published", "updated", "pubDate", "dc_date"))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEED_ITEM.split(", ")])

    return feeds.select("source_id", "feed", "xml").mapInPandas(run, FEED_ITEM)


def candidates(items: DataFrame) -> DataFrame:
    """Items with a link and a title; the first tag else the URL's section as category, the first date that is given."""
    named = items.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    return named.select("source_id", "feed", "item_pos", F.trim("title").alias("title"), F.col("link").alias("url"), F.coalesce(F.nullif("category", F.lit("")), url_category(F.col("link"))).alias("category"), first_date(*(F.col(c) for c in ("published", "updated", "pubDate", "dc_date"))).alias("published_at"))


RULES = "array<struct<allow:boolean,path:string>>"


def unquoted(text: Column) -> Column:
    """Percent signs decoded; a text with broken ones stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _bare(path: Column) -> Column:
    """Without a question mark or a hash that nothing follows."""
    return F.regexp_replace(F.regexp_replace(path, r"#$", ""), r"\?(?=#|$)", "")


def robots_rules(robots: DataFrame, *, agent: str = "*") -> DataFrame:
    """``(host, rules)``: of each host's robots text the rules of the first group for ``agent``, else of the first for all, in their order.

    ``robots`` has host, body and status; only bodies of status 200 are read, others give
    null.  Groups begin with lines of agents and end at an empty line or at the next agent
    after a rule; comments, unknown fields, and rules before any agent are passed over.  An
    agent's name is found if a group's is part of it, whatever the case.  A rule
    without a path allows all.
    """
    name = agent.split("/", 1)[0].lower()
    line = lambda x: F.trim(F.regexp_replace(F.split_part(x, F.lit("#"), F.lit(1)), r"\s", " "))
    field = lambda x: F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda x: unquoted(F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)))
    read = F.transform(F.split("body", "\r\n|\r|\n", -1), lambda x: F.struct((x == "").alias("empty"), F.when(F.contains(line(x), F.lit(":")), field(line(x))).otherwise(F.lit("")).alias("field"), value(line(x)).alias("value")))
    # Only these lines change anything; an empty one closes a group.
    known = F.filter(read, lambda x: x["empty"] | x["field"].isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate"))
    none = F.lit(None).cast(RULES)
    empty = F.array().cast(RULES)
    # state: 0 outside groups, 1 after agents, 2 after rules; mine and all are set once.
    start = F.struct(F.lit(0).alias("state"), F.lit(False).alias("named"), F.lit(False).alias("star"), empty.alias("rules"), none.alias("mine"), none.alias("all"))

    def then(acc: Column, x: Column) -> Column:
        agent_line, rule = x["field"] == "user-agent", x["field"].isin("allow", "disallow")
        over = (acc["state"] == 2) & (x["empty"] | agent_line)
        fresh = over | (x["empty"] & (acc["state"] == 1))
        inside = acc["state"] > 0
        path = _bare(x["value"])
        is_star = (x["value"] == "*") & agent_line
        is_named = agent_line & (x["value"] != "*") & F.contains(F.lit(name), F.lower(x["value"]))
        return F.struct(
            F.when(x["empty"], F.lit(0)).when(agent_line, F.lit(1)).when(inside, F.lit(2)).otherwise(acc["state"]).alias("state"),
            (F.when(fresh, F.lit(False)).otherwise(acc["named"]) | is_named).alias("named"),
            (F.when(fresh, F.lit(False)).otherwise(acc["star"]) | is_star).alias("star"),
            F.when(fresh, empty).when(rule & inside, F.array_append(acc["rules"], F.struct(((x["field"] == "allow") | (path == "")).alias("allow"), path.alias("path")))).otherwise(acc["rules"]).alias("rules"),
            F.when(over & ~acc["star"] & acc["named"], F.coalesce(acc["mine"], acc["rules"])).otherwise(acc["mine"]).alias("mine"),
            F.when(over & acc["star"], F.coalesce(acc["all"], acc["rules"])).otherwise(acc["all"]).alias("all"),
        )

    # One more empty line closes the last group.
    closed = F.array_append(known, F.struct(F.lit(True).alias("empty"), F.lit("").alias("field"), F.lit("").alias("value")))
    found = F.aggregate(closed, start, then, lambda acc: F.coalesce(acc["mine"], acc["all"], empty))
    return robots.select("host", F.when((F.col("status") == 200) & F.col("body").isNotNull(), found).alias("rules"))


def robots_path(url: Column) -> Column:
    """What robots rules are held against: all that follows the host, decoded; a slash if nothing does."""
    rest = _bare(F.regexp_extract(unquoted(url), r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1))
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def _glob(path: Column) -> Column:
    """A rule's path as a regular expression: a star is anything, a dollar at its end the end."""
    quoted = F.regexp_replace(path, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\\\$$", "\\$"))


def robots_allow(urls: DataFrame, robots: DataFrame, *, url_col: str = "url", agent: str = "*", longest: bool = False) -> DataFrame:
    """``urls`` with ``allowed``: by the host's robots text in ``robots(host, body, status)``.

    The first rule whose path begins the URL's decides; with ``longest`` the longest one
    does (of equally long ones one that allows), and stars and a final dollar are read as
    patterns.  A host without a row, with another status than 200, or without a rule that fits allows
    all; a URL without a host is not allowed.  Rules are read once for each host, and a host
    that many URLs share is a skewed join, which Spark splits.
    """
    rules = robots_rules(robots, agent=agent).select(F.col("host").alias("_host"), F.col("rules").alias("_rules"))
    path = robots_path(F.col(url_col))
    if longest:
        fits = F.filter("_rules", lambda r: F.when(r["path"].rlike("[*]|[$]$"), F.regexp_like(F.col("_path"), _glob(r["path"]))).otherwise(F.startswith(F.col("_path"), r["path"])))
        chosen = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))["allow"]
    else:
        chosen = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"])), 0)["allow"]
    host = F.coalesce(url_host(F.col(url_col)), F.lit(""))
    joined = urls.withColumn("_h", host).join(rules, F.col("_h") == F.col("_host"), "left").withColumn("_path", path)
    return joined.withColumn("allowed", (F.col("_h") != "") & F.coalesce(chosen, F.lit(True))).drop("_h", "_host", "_rules", "_path")


class Polite:
    """Calls that keep ``interval`` seconds, and up to ``jitter`` more, between two of one host, and try again what may pass.

    A call that raises, or answers 429 or 5xx, is tried ``tries`` times in all, after
    ``wait`` seconds, then twice as many, and so on, ``most_wait`` at most.
    """

    def __init__(self, get: Callable, *, tries: int = 3, interval: float = 0.0, jitter: float = 0.0, wait: float = 0.0, most_wait: float = 15.0, headers: dict[str, str] | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.get, self.tries, self.interval, self.jitter, self.wait, self.most_wait, self.headers = get, tries, interval, jitter, wait, most_wait, headers
        self.clock, self.sleep, self.last = clock, sleep, {}

    def __call__(self, url: str, host: str) -> tuple[int | None, str | None, str | None]:
        """(status, body, error)."""
        answer = (None, None, "not tried")
        for attempt in range(self.tries):
            if attempt and self.wait:
                self.sleep(min(self.most_wait, self.wait * 2 ** (attempt - 1)))
            if self.interval and host in self.last:
                left = self.interval - (self.clock() - self.last[host])
                if left > 0:
                    self.sleep(left + random.uniform(0, self.jitter))
            self.last[host] = self.clock()
            try:
                status, body = self.get(url) if self.headers is None else self.get(url, self.headers)
            except Exception as problem:  # noqa: BLE001  the adapter's errors are data
                answer = (None, None, f"{type(problem).__name__}: {problem}")
                continue
            answer = (status, body, None if status < 429 else f"status {status}")
            if status != 429 and status < 500:
                break
        return answer


def fetch(urls: DataFrame, get: Callable, *, url_col: str = "url", **manners) -> DataFrame:
    """``urls`` with ``status``, ``body`` and ``error`` from the given callable, called as ``Polite`` says (``manners``).

    One host's URLs go to one task, so the interval between its calls is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = Polite(get, **manners)
        for batch in batches:
            answers = [call(url, host) for url, host in zip(batch[url_col], batch["_host"], strict=True)]
            yield batch.drop(columns="_host").assign(status=pd.array([a[0] for a in answers], dtype="Int32"), body=[a[1] for a in answers], error=[a[2] for a in answers])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    hosted = urls.withColumn("_host", F.coalesce(url_host(F.col(url_col)), F.lit("")))
    return hosted.repartition("_host").mapInPandas(run, f"{fields}, status int, body string, error string")


ROBOTS = "host string, body string, status int, checked_at timestamp"


def refresh_robots(urls: DataFrame, known: DataFrame, get: Callable, *, now: Column, ttl_seconds: int = 3600, url_col: str = "url", scheme: str = "https", **manners) -> DataFrame:
    """``(host, body, status, checked_at)`` for the hosts of ``urls``: rows of ``known`` younger than the TTL, others fetched anew.

    A host whose robots text cannot be fetched has status 0, which allows all, until the TTL ends.
    """
    hosts = urls.select(url_host(F.col(url_col)).alias("host")).where(F.coalesce("host", F.lit("")) != "").distinct()
    fresh = known.where(F.col("checked_at") >= now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))).select("host", "body", "status", "checked_at").join(hosts, "host", "left_semi")
    wanted = hosts.join(fresh, "host", "left_anti").withColumn("url", F.concat(F.lit(f"{scheme}://"), "host", F.lit("/robots.txt")))
    fetched = fetch(wanted, get, **manners).select("host", "body", F.coalesce("status", F.lit(0)).alias("status"), now.cast("timestamp").alias("checked_at"))
    return fresh.unionByName(fetched)
