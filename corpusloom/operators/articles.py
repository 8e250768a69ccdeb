"""From fetched pages to stored articles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.hashing import simhash64
from corpusloom.functions.urls import canonical_category, canonical_url, url_category, url_hash
from corpusloom.operators.dedupe import first_seen, keep_first, near_stored
from corpusloom.sources.storage import cut_lineage

MIN_WORDS = 50
ARTICLE = "struct<title:string,author:string,published:string,text:string>"
_SKIPPED = frozenset("script style noscript template svg nav header footer aside form iframe button select head".split())
_BLOCKS = frozenset("p div br li h1 h2 h3 h4 h5 h6 article section main ul ol blockquote pre figure figcaption td tr table".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Text of paragraphs and headings outside skipped elements, apart for what stands inside an article."""

    skipped_names = _SKIPPED

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title, self.inside, self.whole = [], [], []
        self.skipped, self.article, self.in_title = 0, 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            found = dict(attrs)
            if found.get("content"):
                self.meta.setdefault((found.get("property") or found.get("name") or "").lower(), found["content"])
        self.in_title |= tag == "title"
        if tag not in _VOID:
            self.skipped += tag in self.skipped_names
            self.article += tag == "article"
        if tag in _BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag):
        self.in_title &= tag != "title"
        if tag in self.skipped_names:
            self.skipped = max(0, self.skipped - 1)
        self.article = max(0, self.article - (tag == "article"))
        if tag in _BLOCKS:
            self._add("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        else:
            self._add(data)

    def _add(self, data: str) -> None:
        if not self.skipped:
            self.whole.append(data)
            if self.article:
                self.inside.append(data)


class _LooseReader(_Reader):
    """For pages whose story stands where the first reader does not look: only scripts, styles and the head are skipped."""

    skipped_names = frozenset("script style noscript template svg head button select".split())


#: Parts of class names and ids of what stands beside a story.
_BESIDE = re.compile(r"(?i)(?:^|[\s_-])(?:nav|menu|sidebar|footer|header|breadcrumbs?|comments?|related|recommend\w*|share|social|promo\w*|advert\w*|ads?|banner|cookie\w*|newsletter|subscribe|popup|widget|toolbar|pagination)(?:$|[\s_-])")
_CONTAINERS = frozenset("html body div section article main ul ol dl table tbody tr td th blockquote center figure".split())
_STORY = frozenset(("article", "main"))


class _Tree(_Reader):
    """The page as containers with blocks of text; the container whose blocks hold most text outside links is the story's.

    A block counts by its letters less three times those in links, and little if it is short
    and ends like no sentence.  A container counts what its own blocks do and nine tenths of what the
    containers in it do, so it wins over one of them only if others add to it.
    """

    def __init__(self) -> None:
        super().__init__()
        #: Of each container: the one around it, and whether it is an article or in one.
        self.around, self.in_story = [0], [False]
        #: (container, text, letters in links)
        self.blocks: list[tuple[int, str, int]] = []
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.held, self.linked, self.link = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID or tag == "title":
            super().handle_starttag(tag, attrs)
            return
        if tag == "a":
            self.link += 1
        if tag in _BLOCKS:
            self._close()
        if tag in _CONTAINERS or tag in _SKIPPED:
            _, node, hidden = self.open[-1]
            named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            # What names the whole page says nothing of it.
            hidden = hidden or tag in _SKIPPED or (tag not in ("html", "body", *_STORY) and bool(_BESIDE.search(named)))
            self.around.append(node)
            self.in_story.append(self.in_story[node] or tag in _STORY)
            self.open.append((tag, len(self.around) - 1, hidden))

    def handle_endtag(self, tag):
        self.in_title &= tag != "title"
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in _BLOCKS or tag in _SKIPPED:
            self._close()
        if any(tag == name for name, *_ in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def _add(self, data: str) -> None:
        if data == "\n" or not self.open[-1][2]:
            self.held.append(data)
            self.linked += len(data.strip()) if self.link else 0

    def _close(self) -> None:
        text = "".join(self.held)
        if text.strip():
            self.blocks.append((self.open[-1][1], text, self.linked))
        self.held, self.linked, self.link = [], 0, 0

    def story(self) -> str:
        self._close()
        total = [0.0] * len(self.around)
        for node, text, linked in self.blocks:
            n = len(text.strip())
            total[node] += max(0.0, n - 3.0 * linked) * (1.0 if n >= 40 or text.rstrip()[-1] in ".!?…:;”\"" else 0.2)
        for node in range(len(total) - 1, 0, -1):
            total[self.around[node]] += 0.9 * total[node]
        wanted = [k for k, inside in enumerate(self.in_story) if inside] or range(len(total))
        top = max(wanted, key=lambda k: (total[k], -k))
        if not total[top]:
            return ""
        within = [k == top for k in range(len(total))]
        for node in range(1, len(total)):
            within[node] |= within[self.around[node]]
        return "\n".join(text for node, text, linked in self.blocks if within[node] and 2 * linked <= len(text.strip()))


def read_article(html: str | None, min_words: int = 0) -> tuple | None:
    """(title, author, published, text) of a page, None where nothing can be read.

    The text is that of the container with the most text outside links, of an article or
    main element if there is one.  If it has fewer than ``min_words`` words, all text
    outside menus and the like takes its place where that has more, and then a looser reading where that has enough.
    """
    if not html:
        return None
    found = _read(html, _Tree())
    if len(found[3].split()) < min_words:
        plain = _read(html, _Reader())
        found = plain if len(plain[3].split()) > len(found[3].split()) else found
    if len(found[3].split()) < min_words:
        loose = _read(html, _LooseReader())
        found = loose if len(loose[3].split()) >= min_words else found
    return found


def _read(html: str, reader: _Reader) -> tuple:
    reader.feed(html)
    reader.close()
    text = reader.story() if isinstance(reader, _Tree) else "".join(reader.inside if "".join(reader.inside).strip() and not isinstance(reader, _LooseReader) else reader.whole)
    lines = [" ".join(x.split()) for x in text.split("\n")]
    meta = reader.meta
    return (
        meta.get("og:title") or " ".join("".join(reader.title).split()) or None, meta.get("author") or meta.get("article:author"),
        meta.get("article:published_time") or meta.get("pubdate"), re.sub(r"\n{2,}", "\n", "\n".join(x for x in lines if x)),
    )


def extracted(pages: DataFrame, *, html_col: str = "html", min_words: int = MIN_WORDS) -> DataFrame:
    """``pages`` with ``article`` (title, author, published, text), null if its normalised text has fewer words than ``min_words``."""

    @F.pandas_udf(ARTICLE)
    def read(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in sources:
            rows = [read_article(h, min_words) or (None, None, None, None) for h in batch]
            yield pd.DataFrame(rows, columns=["title", "author", "published", "text"])

    got = pages.withColumn("_a", read(F.col(html_col)))
    enough = T.word_count(T.normalized(F.col("_a.text"))) >= min_words
    return got.withColumn("article", F.when(enough, F.col("_a"))).drop("_a")


def recent(stored: DataFrame, as_of: Column | None, within_days: float) -> DataFrame:
    """Stored rows that can be near duplicates of rows fetched at ``as_of`` or later; by whole days where the table is kept by ``day``."""
    if as_of is None:
        return stored
    first = as_of - F.make_dt_interval(secs=F.lit(within_days * 86_400))
    found = stored.where(F.col("fetched_at") >= first)
    return found.where(F.col("day") >= F.to_date(first)) if "day" in stored.columns else found


def or_else(first: Column, *others: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (first, *others)))


def ingest(candidates: DataFrame, stored: DataFrame, *, as_of: Column | None = None, known: Callable[[DataFrame], DataFrame] | None = None, within_days: float = 2.0, threshold: int = 3) -> DataFrame:
    """Each candidate with its ``outcome`` and, if it is inserted, its article's columns; candidates have different ids.

    ``candidates`` has id, source_id, url, title, category, published_at, fetched_at, allowed and html
    (null: the fetch failed), in order of id.  ``stored`` has id, url_hash, simhash and
    fetched_at.  Cheap checks go first: a URL seen earlier in the batch or stored, robots,
    fetch, extraction; then near duplicates of stored rows, fetched later ones included, and
    of rows of the batch that are kept and were fetched earlier, within the window.  A near
    duplicate is not stored.  ``as_of``, the earliest time of the batch, keeps older stored
    rows from being read but for their URLs; with ``known``, which gives those of some URL
    hashes (``url_hash``) that are stored (as ``key``), even these are not.
    """
    keyed = candidates.withColumns({"canonical": canonical_url(F.col("url")), "url_hash": url_hash(F.col("url"))})
    once = first_seen(keyed, "canonical", F.col("id"))
    before = stored.select("url_hash").distinct() if known is None else known(once.select("url_hash")).withColumnRenamed("key", "url_hash")
    seen = once.join(before.withColumn("_seen", F.lit(True)), "url_hash", "left")
    early = F.when(F.col("_seen"), F.lit("skipped_seen")).when(~F.coalesce("allowed", F.lit(True)), F.lit("skipped_robots")).when(F.col("html").isNull(), F.lit("fetch_failed"))
    marked = seen.withColumn("_early", early)
    read = extracted(marked.withColumn("html", F.when(F.col("_early").isNull(), F.col("html"))))
    full = read.withColumn("content_text", T.normalized(F.col("article.text"))).withColumn("early", F.coalesce("_early", F.when(F.col("article").isNull(), F.lit("extract_failed"))))
    rows = cut_lineage(full.withColumns({
        "simhash": F.when(F.col("early").isNull(), simhash64(F.col("content_text"))), "word_count": T.word_count(F.col("content_text")),
        "title": T.normalized(or_else(F.col("article.title"), F.col("title"))), "author": or_else(F.col("article.author")),
        "published_at": F.coalesce(T.to_utc(F.col("article.published")), F.col("published_at")),
        "category": F.coalesce(canonical_category(F.col("category")), F.col("category"), url_category(F.col("url"))),
    }).drop("html", "article", "_early", "_seen"))
    fresh = rows.where(F.col("early").isNull()).select("id", "simhash", "fetched_at")
    gone = near_stored(fresh, recent(stored, as_of, within_days), within_days=within_days, threshold=threshold)
    left = cut_lineage(fresh.join(gone, "id", "left_anti"))
    kept = keep_first(left, within_days=within_days, threshold=threshold)
    out = rows.join(kept.select("id", "kept"), "id", "left")
    return out.withColumn("outcome", F.coalesce("early", F.when(F.col("kept"), F.lit("inserted")).otherwise(F.lit("skipped_dupe")))).drop("early", "kept")
