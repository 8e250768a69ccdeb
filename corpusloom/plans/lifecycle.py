"""Queries of discovery, ingestion, storage, labelling and evaluation, and their DuckDB equivalents; they join the catalogue's."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import articles, dataset, dedupe, labelling, quality, scoring, summaries
from corpusloom.plans import domain
from corpusloom.plans.catalog import ASCII, BITS, CANON, CHECKED, DATASET, HASHES, HOST, LIMITS, NORMALIZED, WORDS, _dataset, _pairs, _timed, query
from corpusloom.plans.domain import WITH
from corpusloom.sources import feed_stream, feeds, storage
from corpusloom.sources.keys import KeyStore
from corpusloom.sources.storage import table
from corpusloom.sources.versions import Table
from corpusloom.streaming import incremental, near_state

# Discovery


def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Pages as feed items: title, link and date follow from page_id and url."""
    pages = table(spark, d, "pages").select("page_id", "url").where(F.coalesce("url", F.lit("")) != "")
    return pages.withColumn("host", F.coalesce(U.url_host(F.col("url")), F.lit("")))


def _xml(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


FEED_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce({HOST}, '') AS source_id FROM pages WHERE coalesce(url, '') <> '')
SELECT source_id, source_id || '/' || (page_id // 100) AS feed, (row_number() OVER (PARTITION BY source_id, page_id // 100 ORDER BY page_id) - 1)::INT AS item_pos, 'Page ' || page_id AS title, trim(url, ' ' || chr(9) || chr(10) || chr(13)) AS url,
 CASE WHEN page_id % 3 = 0 THEN 'tag' || (page_id % 5) ELSE nullif(replace(lower(regexp_extract(url, '^[^/]*//[^/]*/([\\w-]+)/', 1)), '-', '_'), '') END AS category,
 CASE WHEN page_id % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 05:00:00' + to_minutes(page_id) END AS published_at FROM p
"""


def _rss(spark: SparkSession, d: str) -> DataFrame:
    """``(source_id, feed, xml)``: pages as RSS feeds of at most 100 items each."""
    # Of a fixed hour, so that only the zone has to be read right.
    at = F.date_format(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(12), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=F.col("page_id").cast("int")), "EEE, dd MMM yyyy HH:mm:ss")
    date = F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<pubDate>"), at, F.lit(" +0700</pubDate>")))
    tag = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<category>tag"), (F.col("page_id") % 5).cast("string"), F.lit("</category>"))).otherwise(F.lit(""))
    item = F.concat(F.lit("<item><title> Page "), F.col("page_id").cast("string"), F.lit("\n</title><link>"), _xml(F.col("url")), F.lit("</link>"), tag, date, F.lit("</item>"))
    feed = F.concat("host", F.lit("/"), F.floor(F.col("page_id") / 100).cast("string"))
    made = _stories(spark, d).select(F.col("host").alias("source_id"), feed.alias("feed"), "page_id", item.alias("item")).groupBy("source_id", "feed").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("items"))
    return made.select("source_id", "feed", F.concat(F.lit("<rss><channel>"), F.array_join(F.col("items.item"), ""), F.lit("</channel></rss>")).alias("xml"))


@query(FEED_SQL)
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Feeds are written as RSS, parsed, and read as candidates."""
    found = feeds.candidates(feeds.parse_feeds(_rss(spark, d)))
    return found.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(f"SELECT source_id, item_pos, title, url, category, published_at FROM ({FEED_SQL})")
def feed_stream_items(spark: SparkSession, d: str) -> DataFrame:
    """The same feeds, stored as documents that a stream polls for one round."""
    folder = f"{storage.shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = storage.cut_lineage(_rss(spark, d).withColumn("bucket", F.pmod(F.xxhash64("feed"), F.lit(parts)).cast("int")))
    stored.repartition(parts, "bucket").select(F.col("feed").alias("name"), F.col("xml").alias("text"), "bucket").write.partitionBy("bucket").parquet(f"{folder}/documents")
    address = F.concat(F.lit(f"{folder}/documents/bucket="), "bucket", F.lit("#"), "feed")
    stored.select("source_id", address.alias("feed"), "bucket").repartition(parts, "bucket").sortWithinPartitions("bucket").drop("bucket").write.parquet(f"{folder}/catalogue")
    feed_stream.register(spark)
    polled = spark.readStream.format("feeds").options(feeds=f"{folder}/catalogue", fetch="corpusloom.sources.feed_stream:stored", interval="1000000000", since="0").load()
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/round={number}")
    running = polled.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").start()
    running.processAllAvailable()
    running.stop()
    got = spark.read.schema(feed_stream.FEEDS).parquet(f"{folder}/round=*")
    return feeds.candidates(feeds.parse_feeds(got)).drop("feed").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(f"SELECT page_id, host FROM (SELECT page_id, coalesce({HOST}, '') AS host FROM pages WHERE coalesce(url, '') <> '') QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3")
def feed_caps(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.cap_items(_stories(spark, d).select("page_id", "host"), 3, by=["host"], order="page_id")


@query(f"WITH {WITH} SELECT id, source_id FROM src WHERE id % 3 <> 0 AND source_id IN ('src1', 'src3', 'src4', 'src7')")
def sources_enabled(spark: SparkSession, d: str) -> DataFrame:
    known = domain.sources(spark, d).withColumn("enabled", F.col("id") % 3 != 0)
    return feeds.enabled_sources(known, ["src1", "src3", "src4", "src7"]).select("id", "source_id")


DATES = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss '+0700'", "yyyy-MM-dd HH:mm:ss", "'not a date'")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 7 HOUR WHEN 2 THEN date_trunc('second', ts) END AS at FROM events")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Times written as ISO-8601, RFC-822, without a zone, as nonsense and as null, and read back."""
    text = F.coalesce(*(F.when(F.col("event_id") % 5 == k, F.date_format("ts", f)) for k, f in enumerate(DATES)))
    return table(spark, d, "events").select("event_id", T.to_utc(text).cast("timestamp_ntz").alias("at"))


# Ingestion


STORY_TEXT = "regexp_replace(coalesce(text, ''), '[<>&]', ' ', 'g')"
INGEST_SQL = rf"""
WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id AS id, 'https://example.org/' || doc_id % 900 AS url, doc_id % 17 <> 0 AS allowed, doc_id % 13 = 0 AS failed, TIMESTAMP '2024-01-01' + to_hours((doc_id * 7919) % 240) AS t, {NORMALIZED.replace('coalesce(text', 'coalesce(' + STORY_TEXT)} AS x FROM documents),
 stored AS MATERIALIZED (SELECT * FROM c WHERE id % 10 = 0),
 once AS (SELECT * FROM c WHERE id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
 early AS MATERIALIZED (SELECT *, CASE WHEN url IN (SELECT url FROM stored) THEN 'skipped_seen' WHEN NOT allowed THEN 'skipped_robots' WHEN failed THEN 'fetch_failed' WHEN len({WORDS.replace('@', 'x')}) < 50 THEN 'extract_failed' END AS early FROM once),
 j AS (SELECT id, array_to_string(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]+'), '') AS j FROM c),
 g AS (SELECT id AS doc_id, unnest(CASE WHEN length(j) < 4 THEN [j] ELSE list_transform(range(1, length(j) - 2), lambda i: substr(j, i, 4)) END) AS g FROM j WHERE j <> ''),
 h AS MATERIALIZED (SELECT doc_id, {BITS} AS h FROM (SELECT doc_id, least(count(*), 50) AS w, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h FROM g GROUP BY doc_id, g) GROUP BY doc_id),
 s AS MATERIALIZED (SELECT coalesce(h.h, 0::UBIGINT) AS h, t FROM stored LEFT JOIN h ON h.doc_id = stored.id),
 f AS MATERIALIZED (SELECT e.id, e.t, coalesce(h.h, 0::UBIGINT) AS h FROM early e LEFT JOIN h ON h.doc_id = e.id WHERE early IS NULL),
 free AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, id) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE bit_count(xor(s.h, f.h)) <= 3 AND s.t >= f.t - INTERVAL 2 DAY)),
 r AS (SELECT 0::BIGINT AS k, -1::BIGINT AS id, false AS keep, []::STRUCT(h UBIGINT, t TIMESTAMP)[] AS kept
       UNION ALL SELECT o.k, o.id, NOT o.dup, CASE WHEN o.dup THEN o.kept ELSE list_append(o.kept, {{'h': o.h, 't': o.t}}) END FROM (SELECT free.k, free.id, free.h, free.t, r.kept, len(list_filter(r.kept, lambda y: bit_count(xor(y.h, free.h)) <= 3 AND y.t >= free.t - INTERVAL 2 DAY)) > 0 AS dup FROM r JOIN free ON free.k = r.k + 1) o)
SELECT e.id, coalesce(e.early, CASE WHEN r.keep THEN 'inserted' ELSE 'skipped_dupe' END) AS outcome FROM early e LEFT JOIN r ON r.id = e.id
"""


@query(INGEST_SQL)
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as fetched pages: a tenth of them is stored already, the others come in one batch."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ").alias("body"))
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(hours=((F.col("id") * 7919) % 240).cast("int"))
    rows = docs.select(
        "id", F.lit("src").alias("source_id"), F.concat(F.lit("https://example.org/"), (F.col("id") % 900).cast("string")).alias("url"), F.lit("title").alias("title"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("timestamp").alias("published_at"), at.cast("timestamp").alias("fetched_at"), (F.col("id") % 17 != 0).alias("allowed"), F.when(F.col("id") % 13 != 0, F.concat(F.lit("<article><p>"), "body", F.lit("</p></article>"))).alias("html"), "body",
    )
    known = rows.where("id % 10 = 0").select("id", U.url_hash(F.col("url")).alias("url_hash"), articles.simhash64(T.normalized(F.col("body"))).alias("simhash"), "fetched_at")
    return articles.ingest(rows.where("id % 10 <> 0").drop("body"), storage.cut_lineage(known)).select("id", "outcome")


KEEP_SQL = f"""
WITH RECURSIVE h AS MATERIALIZED ({HASHES}), t AS MATERIALIZED (SELECT h.doc_id AS id, h.h, e.ts AS t, row_number() OVER (ORDER BY e.ts, h.doc_id) AS k FROM h JOIN events e ON e.event_id = h.doc_id),
 r AS (SELECT 0::BIGINT AS k, -1::BIGINT AS id, false AS keep, []::STRUCT(h UBIGINT, t TIMESTAMP)[] AS kept
       UNION ALL SELECT o.k, o.id, NOT o.dup, CASE WHEN o.dup THEN o.kept ELSE list_append(o.kept, {{'h': o.h, 't': o.t}}) END FROM (SELECT t.k, t.id, t.h, t.t, r.kept, len(list_filter(r.kept, lambda y: bit_count(xor(y.h, t.h)) <= 3 AND y.t >= t.t - INTERVAL 2 DAY)) > 0 AS dup FROM r JOIN t ON t.k = r.k + 1) o)
SELECT id, keep AS kept FROM r WHERE k > 0
"""


@query(KEEP_SQL)
def near_dup_keep(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_first(_timed(spark, d))


@query(KEEP_SQL)
def streaming_near_keep(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream: the middle third of the time comes first, then the first, then the last, and a beat far ahead that lets the rest go."""
    folder = f"{storage.shared_dir(spark)}/near-{uuid.uuid4().hex}"
    rows = _timed(spark, d)
    low, high = rows.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    if low is None:
        return rows.select("id", F.lit(True).alias("kept"))
    span = high - low + dt.timedelta(seconds=1)
    put = lambda part, name: part.write.parquet(f"{folder}/in/{name}")
    third = lambda k: rows.where((F.col("fetched_at") >= F.lit(low + k * span / 3)) & (F.col("fetched_at") < F.lit(low + (k + 1) * span / 3)))
    put(third(1), "1")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    running = near_state.near_keep_stream(stream, folder, f"{folder}/state", late=f"{int(span.total_seconds() * 2 / 3) + 1} seconds")
    for k in (0, 2):
        running.processAllAvailable()
        put(third(k), str(k))
    running.processAllAvailable()
    put(spark.createDataFrame([(-1, 0, high + dt.timedelta(days=1000))], rows.schema), "beat")
    near_state.settle(running)
    return spark.read.schema("id long, kept boolean").parquet(f"{folder}/decided").where("id >= 0").select("id", "kept")


@query(f"WITH {WITH} SELECT id, CASE WHEN id % 11 = 0 THEN 'unknown status' WHEN id % 7 = 0 THEN 'word_count is negative' END AS violation FROM art")
def article_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.articles(spark, d).withColumns({"url_hash": U.url_hash(F.col("url")), "status": F.when(F.col("id") % 11 == 0, F.lit("lost")).otherwise(F.col("status")), "word_count": F.when(F.col("id") % 7 == 0, F.lit(-1)).otherwise(F.lit(1))})
    return schemas.violations(rows).select("id", "violation")


# Storage


@query("SELECT coalesce(n.k, o.k) AS k, o.name AS name, CASE WHEN n.k IS NOT NULL THEN n.balance ELSE o.balance END AS balance FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, -1.0::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 0) n ON n.k = o.k")
def sources_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return storage.upsert(rows.where("k % 3 <> 0"), rows.where("k % 2 = 0").select("k", F.lit(-1.0).alias("balance")), "k")


@query(f"WITH p AS (SELECT page_id, {CANON} AS canonical FROM pages) SELECT page_id, coalesce(canonical IN (SELECT canonical FROM p WHERE page_id % 2 = 0 AND canonical IS NOT NULL), false) AS skipped FROM p WHERE page_id % 2 = 1")
def articles_insert(spark: SparkSession, d: str) -> DataFrame:
    """Odd pages into a table of even ones: a URL that is there is skipped."""
    rows = table(spark, d, "pages").select("page_id", U.url_hash(F.col("url")).alias("url_hash"))
    fresh, skipped = storage.insert_new(rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1"), ["url_hash"])
    return fresh.select("page_id", F.lit(False).alias("skipped")).unionByName(skipped.select("page_id", F.lit(True).alias("skipped"))).distinct()


@query(f"WITH p AS (SELECT page_id, {CANON} AS canonical FROM pages WHERE {CANON} IS NOT NULL) SELECT page_id, canonical IN (SELECT canonical FROM p WHERE page_id % 4 <> 3) AS known FROM p WHERE page_id % 4 = 3")
def urls_known(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters of the pages are stored in batches; which URLs of the last quarter are among them."""
    rows = table(spark, d, "pages").select("page_id", U.url_hash(F.col("url")).alias("url_hash")).where("url_hash IS NOT NULL")
    store = KeyStore(spark, f"{storage.shared_dir(spark)}/urls-{uuid.uuid4().hex}", buckets=16)
    for batch in range(3):
        store.add(rows.where(F.col("page_id") % 4 == batch).select("url_hash"), batch)
    asked = rows.where("page_id % 4 = 3")
    found = store.known(asked.select("url_hash")).select(F.col("key").alias("url_hash"), F.lit(True).alias("known"))
    return asked.join(found, "url_hash", "left").select("page_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS url, CASE WHEN page_id % 2 = 0 THEN -1 ELSE length(url) END::BIGINT AS n FROM pages WHERE page_id % 7 <> 0 AND (page_id % 3 <> 0 OR page_id % 2 = 0)")
def pages_versioned(spark: SparkSession, d: str) -> DataFrame:
    """Appended, merged, taken down and vacuumed in a versioned table, then read from its files."""
    rows = table(spark, d, "pages").select("page_id", "url", F.length("url").cast("long").alias("n"))
    kept = Table(spark, f"{storage.shared_dir(spark)}/pages-{uuid.uuid4().hex}", "page_id", "page_id long, url string, n long", buckets=16)
    kept.append(rows.where("page_id % 3 <> 0"))
    kept.merge(rows.where("page_id % 2 = 0").select("page_id", F.lit(-1).cast("long").alias("n")))
    kept.delete(rows.where("page_id % 7 = 0").select("page_id"))
    kept.compact(most_files=1)
    kept.vacuum()
    return kept.read()


@query(f"WITH {WITH} SELECT id FROM art WHERE fetched_at >= (SELECT max(fetched_at) FROM art) - INTERVAL 1 DAY AND id % 7 <> 0")
def articles_retained(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.articles(spark, d)
    newest = rows.agg(F.max("fetched_at")).first()[0]
    return incremental.retained(rows, F.lit(newest), days=1, taken_down=rows.where("id % 7 = 0").select("id")).select("id")


@query(f"WITH {WITH}, left_a AS (SELECT * FROM art WHERE source_fk IS NULL OR source_fk NOT IN (1, 2)) SELECT 'articles' AS name, count(*) AS n FROM left_a UNION ALL SELECT 'labels', count(*) FROM lab WHERE article_fk NOT IN (SELECT id FROM art WHERE source_fk IN (1, 2)) UNION ALL SELECT 'sources', count(*) FROM src WHERE id NOT IN (1, 2)")
def takedown_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows left when two sources go with all that hangs on them."""
    tables = {"sources": domain.sources(spark, d), "articles": domain.articles(spark, d), "labels": domain.labels(spark, d)}
    left = storage.without_sources(tables, tables["sources"].where("id IN (1, 2)").select("id"))
    count = lambda name: left[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("articles").unionByName(count("labels")).unionByName(count("sources"))


# Labelling


@query(f"WITH {WITH}, k AS (SELECT conv_id, turn, reply, user_text FROM turns) {CHECKED[len(f'WITH {WITH}'):]} SELECT r.conv_id, r.turn, CASE WHEN r.turn % 5 = 0 THEN 'error' WHEN len(reasons) = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM r")
def label_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Turns labelled by a callable that answers with the reply as JSON; every fifth call fails."""

    def call(prompt: str) -> str:
        turn, reply = prompt.split("|", 1)
        if int(turn) % 5 == 0:
            raise ValueError("no answer")
        return json.dumps({"summary": reply, "key_entities": [], "confidence": 0.5})

    prompts = domain.turns(spark, d).select("conv_id", "turn", F.col("user_text").alias("source_text"), F.concat(F.col("turn").cast("string"), F.lit("|"), "reply").alias("prompt"))
    return labelling.label(prompts, call, limits=LIMITS, fuzzy=False).select("conv_id", "turn", "outcome")


@query(f"WITH {WITH}, new AS (SELECT id FROM art WHERE content_text IS NOT NULL AND id % 4 = 0) SELECT article_fk, source, prompt_version, qc_passed FROM lab UNION ALL SELECT id, 'llm', 'v1', id % 8 = 0 FROM new WHERE id NOT IN (SELECT article_fk FROM lab)")
def labels_appended(spark: SparkSession, d: str) -> DataFrame:
    """New labels are appended; an article that has one for the prompt is skipped."""
    old = domain.labels(spark, d)
    made = domain.articles(spark, d).where("content_text IS NOT NULL AND id % 4 = 0").select(F.col("id").alias("article_fk"), F.lit("summary").alias("summary_text"), (F.col("id") % 8 == 0).alias("qc_passed"))
    return labelling.append_labels(old, made, prompt_version="v1").select("article_fk", "source", "prompt_version", "qc_passed")


# Data sets, models and scores


@query(f"{DATASET} SELECT split, CASE WHEN article_id > 0 THEN 1 + (article_id - 1) // 32768 ELSE article_id // 32768 END AS bucket, count(DISTINCT article_id) AS n, sum(DISTINCT article_id)::BIGINT AS id_sum, bit_xor(DISTINCT article_id * article_id) AS mixed FROM ds GROUP BY ALL")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a version as bitmaps, and what they are, read back from these."""
    made = storage.cut_lineage(dataset.manifest(_dataset(spark, d), "v1"))
    ids = dataset.manifest_ids(made).withColumn("bucket", F.bitmap_bucket_number("article_id"))
    sums = ids.groupBy("split", "bucket").agg(F.sum("article_id").alias("id_sum"), F.bit_xor(F.col("article_id") * F.col("article_id")).alias("mixed"))
    return made.select("split", "bucket", F.bitmap_count("ids").alias("n")).join(sums, ["split", "bucket"])


@query(f"WITH {WITH} SELECT turns.conv_id, turns.turn, list_transform(string_split(user_text, ' '), lambda w: length(w)::INT)[1:16]::VARCHAR AS ids, list_transform(string_split(reply, ' '), lambda w: length(w)::INT)[1:8]::VARCHAR AS labels FROM turns WHERE user_text <> '' AND reply <> ''")
def tokenized_turns(spark: SparkSession, d: str) -> DataFrame:
    """By an injected tokenizer that says how long the words are."""
    rows = domain.turns(spark, d).select("conv_id", "turn", F.col("user_text").alias("text"), F.col("reply").alias("target")).where("text <> '' AND target <> ''")
    made = dataset.tokenized(rows, lambda: lambda t, n: [len(w) for w in t.split(" ")][:n], most_text=16, most_target=8, keep=("conv_id", "turn"))
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return made.select("conv_id", "turn", shown("input_ids").alias("ids"), shown("labels").alias("labels"))


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN length(text) || ':' || substr(text, 1, 10) ELSE '' END AS summary FROM documents")
def generated_summaries(spark: SparkSession, d: str) -> DataFrame:
    """By an injected model, which never sees a blank text."""

    def model():
        return lambda texts: [f"{len(t)}:{t[:10]}" for t in texts]

    return summaries.generated(table(spark, d, "documents").select("doc_id", "text"), model).select("doc_id", "summary")


@query(f"WITH {WITH} SELECT conv_id || ':' || turn AS id, reply AS prediction, user_text AS reference FROM turns")
def predictions_paired(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d)
    return scoring.paired(rows.select("id", "prediction"), rows.select("id", "reference"))


#: The longest common subsequence, row by row of its table.
LCS_SQL = f"""k AS MATERIALIZED (SELECT conv_id || ':' || turn AS id, {ASCII.replace('@', 'reply')} AS p, {ASCII.replace('@', 'user_text')} AS r FROM turns),
 l AS (SELECT id, p, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) AS was FROM k
       UNION ALL SELECT id, p, r, i + 1, list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN p[i + 1] = r[j[1]] THEN was[j[1]] + 1 ELSE greatest(acc[-1], was[j[1] + 1]) END), [0::BIGINT]) FROM l WHERE i < len(p)),
 scored AS (SELECT id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * was[-1] / (len(p) + len(r)) END AS f FROM l WHERE i = len(p))"""


@query(f"WITH RECURSIVE {WITH}, {LCS_SQL} SELECT id, round(f, 6) AS \"rougeL\" FROM scored")
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rouge_l(_pairs(spark, d)).withColumn("rougeL", F.round("rougeL", 6))


def _mean_sql(n: int) -> str:
    grams = lambda c: c if n == 1 else f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
    return f"""g{n} AS (SELECT id, {grams('p')} AS p, {grams('r')} AS r FROM k), p{n} AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(p) AS x FROM g{n}) GROUP BY ALL), r{n} AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(r) AS x FROM g{n}) GROUP BY ALL),
 m{n} AS (SELECT a.id, sum(least(a.c, b.c)) AS m FROM p{n} a JOIN r{n} b ON a.id = b.id AND a.x = b.x GROUP BY a.id), f{n} AS (SELECT g.id, CASE WHEN coalesce(m.m, 0) = 0 THEN 0.0 ELSE 2.0 * m.m / (len(p) + len(r)) END AS f FROM g{n} g LEFT JOIN m{n} m ON m.id = g.id)"""


#: Every window of the longer text against the shorter one, by their longest common subsequences.
FUZZY_SQL = f"""
WITH RECURSIVE {WITH}, p AS MATERIALIZED (SELECT conv_id, turn, user_text AS source, CASE WHEN turn % 4 = 0 THEN substr(user_text, 21, 4) || substr(user_text, 26, 7) ELSE substr(reply, 1, 12) END AS name FROM turns),
 o AS (SELECT conv_id, turn, CASE WHEN length(name) <= length(source) THEN name ELSE source END AS a, CASE WHEN length(name) <= length(source) THEN source ELSE name END AS b FROM p),
 w AS (SELECT conv_id, turn, a, substr(b, greatest(0, s) + 1, s + length(a) - greatest(0, s)) AS w FROM (SELECT *, unnest(range(1 - length(a), length(b))) AS s FROM o WHERE a <> '')),
 k AS MATERIALIZED (SELECT DISTINCT a, w, list_filter(string_split(a, ''), lambda c: c <> '') AS p, list_filter(string_split(w, ''), lambda c: c <> '') AS r FROM w),
 l AS (SELECT a, w, p, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) AS was FROM k
       UNION ALL SELECT a, w, p, r, i + 1, list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN p[i + 1] = r[j[1]] THEN was[j[1]] + 1 ELSE greatest(acc[-1], was[j[1] + 1]) END), [0::BIGINT]) FROM l WHERE i < len(p)),
 scored AS (SELECT a, w, 200.0::DOUBLE * was[-1] / (len(p) + len(r)) AS score FROM l WHERE i = len(p)),
 best AS (SELECT conv_id, turn, max(score) AS score FROM w JOIN scored USING (a, w) GROUP BY conv_id, turn)
SELECT o.conv_id, o.turn, CASE WHEN a = '' THEN b = '' ELSE best.score >= 85 END AS supported FROM o LEFT JOIN best ON best.conv_id = o.conv_id AND best.turn = o.turn
"""


#: The whole check with its fuzzy clause: names that no window of the source is like enough, as JSON.
QC_SQL = f"""{CHECKED.replace("WITH ", "WITH RECURSIVE ", 1)},
 named AS (SELECT conv_id, turn, user_text AS source, unnest(missing_e) AS name, generate_subscripts(missing_e, 1) AS i FROM q),
 o AS (SELECT DISTINCT name, source, CASE WHEN length(name) <= length(source) THEN name ELSE source END AS a, CASE WHEN length(name) <= length(source) THEN source ELSE name END AS b FROM named),
 w AS (SELECT name, source, a, substr(b, greatest(0, s) + 1, s + length(a) - greatest(0, s)) AS w FROM (SELECT *, unnest(range(1 - length(a), length(b))) AS s FROM o WHERE a <> '')),
 k AS MATERIALIZED (SELECT DISTINCT a, w, list_filter(string_split(a, ''), lambda c: c <> '') AS p, list_filter(string_split(w, ''), lambda c: c <> '') AS r FROM w),
 l AS (SELECT a, w, p, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) AS was FROM k
       UNION ALL SELECT a, w, p, r, i + 1, list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN p[i + 1] = r[j[1]] THEN was[j[1]] + 1 ELSE greatest(acc[-1], was[j[1] + 1]) END), [0::BIGINT]) FROM l WHERE i < len(p)),
 found AS (SELECT DISTINCT w.name, w.source FROM w JOIN l ON l.a = w.a AND l.w = w.w WHERE l.i = len(l.p) AND 200.0::DOUBLE * l.was[-1] / (len(l.p) + len(l.r)) >= 85),
 lost AS (SELECT n.conv_id, n.turn, list(n.name ORDER BY n.i) AS names FROM named n LEFT JOIN found f ON f.name = n.name AND f.source = n.source WHERE f.name IS NULL GROUP BY n.conv_id, n.turn),
 j AS (SELECT q.conv_id, q.turn, q.w, q.k, q.missing_n, coalesce(lost.names, []::VARCHAR[]) AS missing FROM q LEFT JOIN lost ON lost.conv_id = q.conv_id AND lost.turn = q.turn)
SELECT conv_id, turn, to_json({{'passed': len(reasons) = 0, 'reasons': reasons, 'word_count': w::INT, 'sentence_count': k::INT, 'missing_numbers': missing_n, 'missing_entities': missing}})::VARCHAR AS qc FROM (SELECT *, list_filter([
 CASE WHEN w < 10 THEN 'too_short:' || w || '<10' END, CASE WHEN w > 60 THEN 'too_long:' || w || '>60' END, CASE WHEN k < 1 THEN 'too_few_sentences:' || k || '<1' END, CASE WHEN k > 6 THEN 'too_many_sentences:' || k || '>6' END,
 CASE WHEN len(missing_n) > 0 THEN 'unsupported_numbers:' || array_to_string(missing_n[1:5], ',') END, CASE WHEN len(missing) > 0 THEN 'unsupported_entities:' || array_to_string(missing[1:5], ',') END], lambda x: x IS NOT NULL) AS reasons FROM j)
"""


@query(QC_SQL)
def qc_battery_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    out = quality.quality(domain.turns(spark, d), summary="reply", source="user_text", refusal=None, limits=LIMITS)
    return out.select("conv_id", "turn", F.to_json("qc").alias("qc"))


@query(FUZZY_SQL)
def fuzzy_support(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the question with a letter left out, and beginnings of the answer, looked for in the question."""
    text = F.col("user_text")
    piece = F.concat(F.substring(text, 21, 4), F.substring(text, 26, 7))
    name = F.when(F.col("turn") % 4 == 0, piece).otherwise(F.substring("reply", 1, 12))
    return domain.turns(spark, d).select("conv_id", "turn", quality.fuzzy_reached(name, text).alias("supported"))


@query(f"""WITH RECURSIVE {WITH}, {LCS_SQL}, {_mean_sql(1)}, {_mean_sql(2)}
 SELECT (SELECT round(avg(f), 4) FROM f1) AS rouge1, (SELECT round(avg(f), 4) FROM f2) AS rouge2, (SELECT round(avg(f), 4) FROM scored) AS "rougeL", (SELECT round(avg(CASE WHEN length(reply) > length(user_text) THEN 1.0 ELSE 0.0 END), 4) FROM turns) AS scorer_f1, (SELECT count(*) FROM turns) AS n""")
def rouge_corpus_mean(spark: SparkSession, d: str) -> DataFrame:
    """With an injected scorer, which says whether the prediction is the longer one."""
    return scoring.corpus_scores(_pairs(spark, d), scorer=lambda p, r: [float(len(a) > len(b)) for a, b in zip(p, r, strict=True)])
