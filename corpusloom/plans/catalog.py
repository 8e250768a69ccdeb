"""The library's queries and their DuckDB equivalents, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions.hashing import simhash64, simhash_grams
from corpusloom.operators import dataset, dedupe, labelling, quality, reports, scoring, summaries
from corpusloom.operators.articles import extracted
from corpusloom.plans import domain
from corpusloom.plans.domain import WITH
from corpusloom.sources import feeds, storage
from corpusloom.sources.storage import table
from corpusloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TRACKED = "(" + " OR ".join(f"starts_with(lower({{k}}), '{p}')" for p in U.TRACKING_PREFIXES) + ")"
TITLE = f"[{T.TITLE_CHARS}][\\p{{L}}\\p{{N}}_À-ỹ]*"
SPACES = r"[\s\p{Z}\x{0085}\x{000B}\x{001C}-\x{001F}]"
NORMALIZED = rf"""trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '(?im)^\s*(?:đọc thêm|xem thêm|tags?:|từ khóa:|liên quan:|chia sẻ).*$', '', 'g'), '{SPACES}+', ' ', 'g'))"""
WORDS = rf"list_filter(regexp_split_to_array(coalesce(@, ''), '{SPACES}+'), lambda w: w <> '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Datasets and labels


def _dataset(spark: SparkSession, d: str) -> DataFrame:
    return dataset.dataset_rows(domain.labels(spark, d), domain.articles(spark, d), domain.sources(spark, d), prompt_version="v1")


BUCKET = "CASE WHEN ('0x' || substr(sha256('vn-news-v1:' || art.id), 1, 2))::INT < 26 THEN 'test' WHEN ('0x' || substr(sha256('vn-news-v1:' || art.id), 1, 2))::INT < 52 THEN 'val' ELSE 'train' END"
DATASET = f"WITH {WITH}, ds AS (SELECT art.id AS article_id, src.source_id AS source, art.url, art.title, art.category, strftime(art.published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at, art.content_text, lab.summary_text AS summary, lab.prompt_version, {BUCKET} AS split FROM lab JOIN art ON art.id = lab.article_fk JOIN src ON src.id = art.source_fk WHERE lab.qc_passed)"


@query(f"{DATASET} SELECT split, count(*) AS n FROM ds GROUP BY split")
def dataset_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_sizes(_dataset(spark, d))


@query(f"{DATASET} SELECT * FROM ds")
def dataset_split_rows(spark: SparkSession, d: str) -> DataFrame:
    return _dataset(spark, d)


@query(f"{DATASET} SELECT split, count(*) AS n, sum(article_id)::BIGINT AS id_sum FROM ds GROUP BY split")
def export_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines, read back, and summed up."""
    folder = f"{storage.shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    storage.write_dataset(_dataset(spark, d), folder)
    return storage.read_dataset(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("article_id").alias("id_sum"))


@query(f"{DATASET} SELECT 'v1' AS name, string_agg(article_id, ',' ORDER BY article_id) FILTER (split = 'train') AS train_ids, string_agg(article_id, ',' ORDER BY article_id) FILTER (split = 'val') AS val_ids, string_agg(article_id, ',' ORDER BY article_id) FILTER (split = 'test') AS test_ids FROM ds")
def dataset_version(spark: SparkSession, d: str) -> DataFrame:
    row = dataset.version_row(_dataset(spark, d), "v1")
    return row.select("name", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("train_ids", "val_ids", "test_ids")))


@query(f"{DATASET} SELECT content_text AS text, summary AS target FROM ds WHERE length(content_text) > 0 AND length(summary) > 0")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset.training_rows(_dataset(spark, d))


@query(f"WITH {WITH} SELECT id, published_at FROM art WHERE status IN ('cleaned', 'summarized') AND content_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.article_fk = art.id AND prompt_version = 'v1') ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50")
def unlabelled_topk(spark: SparkSession, d: str) -> DataFrame:
    return labelling.unlabelled(domain.articles(spark, d), domain.labels(spark, d), prompt_version="v1").select("id", "published_at")


@query(f"WITH {WITH} SELECT id FROM art WHERE content_text IS NOT NULL AND source_fk IN (SELECT id FROM src WHERE source_id IN ('src1', 'src2')) AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.article_fk = art.id)")
def unlabelled_of_sources(spark: SparkSession, d: str) -> DataFrame:
    return labelling.unlabelled(domain.articles(spark, d), domain.labels(spark, d), prompt_version="v1", sources=domain.sources(spark, d), only=["src1", "src2"], limit=None).select("id")


@query(f"WITH {WITH} SELECT coalesce(k.name, 'unknown') AS source_name, count(*) AS n FROM art LEFT JOIN (SELECT * FROM src WHERE id < 10) k ON k.id = art.source_fk GROUP BY 1")
def source_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    return labelling.named_source(domain.articles(spark, d), domain.sources(spark, d).where("id < 10")).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WITH} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM lab WHERE lab.article_fk = art.id AND qc_passed) THEN 'summarized' ELSE status END AS status FROM art")
def mark_summarized(spark: SparkSession, d: str) -> DataFrame:
    return labelling.mark_summarized(domain.articles(spark, d), domain.labels(spark, d)).select("id", "status")


@query(f"WITH {WITH} SELECT count(*) AS requested, count(lab.article_fk) AS labelled, count(*) FILTER (lab.qc_passed) AS qc_passed, count(*) FILTER (NOT lab.qc_passed) AS qc_failed, count(*) FILTER (lab.article_fk IS NULL) AS llm_errors, round(count(*) FILTER (lab.qc_passed) / count(lab.article_fk), 6) AS qc_pass_rate FROM art LEFT JOIN lab ON lab.article_fk = art.id")
def label_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    joined = domain.articles(spark, d, "id").join(domain.labels(spark, d).withColumnRenamed("article_fk", "id"), "id", "left")
    outcome = F.when(F.col("qc_passed").isNull(), F.lit("error")).when(F.col("qc_passed"), F.lit("passed")).otherwise(F.lit("failed"))
    return labelling.label_counts(joined.withColumn("outcome", outcome)).withColumn("qc_pass_rate", F.round("qc_pass_rate", 6))


#: Replies by number, where @ is a label's doc_id: whole, over-confident, refused, no JSON, with a confidence out of range, without a summary.
REPLIES = (
    '{"summary": "S @", "key_entities": ["X", "@"], "confidence": 0.5, "refusal_reason": null}', '{"summary": "S @", "confidence": 10}', '{"summary": null, "refusal_reason": "none @"}',
    "not-json @", '{"summary": "S @", "confidence": -0.5}', '{"key_entities": ["@"]}',
)


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 'S ' || doc_id WHEN doc_id % 6 = 2 THEN '' END AS summary, [2, 0, 0, 0, 0, 1][doc_id % 6 + 1]::INT AS n_entities, [0.5, 1.0, 0.0, 0.0, -0.5, 0.0][doc_id % 6 + 1]::DOUBLE AS confidence,
 [NULL, NULL, NULL, 'not valid JSON', 'confidence is out of range', 'summary is missing'][doc_id % 6 + 1] AS error FROM labels""")
def label_json_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.get(F.array(*(F.lit(r) for r in REPLIES)), (F.col("doc_id") % 6).cast("int")), F.lit("@"), F.col("doc_id").cast("string"))
    parsed = table(spark, d, "labels").select("doc_id", labelling.parse_reply(raw).alias("p"))
    return parsed.select("doc_id", "p.summary", F.size("p.key_entities").alias("n_entities"), "p.confidence", "p.error")


# URLs

HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1))"
PATH = "regexp_replace(regexp_replace(CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) END, '/+', '/', 'g'), '(.)/$', '\\1')"
PAIRS = f"list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND NOT {TRACKED.format(k='p')}))"
CANON = f"regexp_extract(lower(url), '^([^:]+)://', 1) || '://' || {HOST} || {PATH} || CASE WHEN len({PAIRS}) = 0 THEN '' ELSE '?' || array_to_string({PAIRS}, '&') END"


@query(f"SELECT page_id, {CANON} AS canonical FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, substr(sha256({CANON}), 1, 32) AS url_hash FROM pages")
def url_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))


@query(f"SELECT k, count(*) AS n, {TRACKED.format(k='k')} AS tracking FROM (SELECT unnest(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: split_part(p, '=', 1))) AS k FROM pages) WHERE k <> '' GROUP BY k")
def url_tracking_params(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "pages").select(F.explode(U.query_pairs(F.regexp_extract("url", r"\?([^#]*)", 1))).alias("p")).select("p.k")
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("tracking", U.is_tracking(F.col("k")))


@query(f"SELECT canonical, min(page_id) AS page_id FROM (SELECT page_id, {CANON} AS canonical FROM pages) GROUP BY canonical")
def url_first_seen(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))
    return dedupe.first_seen(keyed, "canonical", F.col("page_id"))


@query("SELECT page_id, nullif(replace(lower(regexp_extract(url, '^[^/]*//[^/]*/([\\w-]+)/', 1)), '-', '_'), '') AS category FROM pages")
def url_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.url_category(F.col("url")).alias("category"))


ALIAS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(raw), '{w}') OR contains('{w}', lower(raw))" for w in words) + f" THEN '{name}'" for name, words in U.CATEGORY_ALIASES.items()) + " END"
RAW = ("Thời sự", "kinh-doanh", "the-thao-24h", "xa_hoi", "giải trí", "weather", "so-hoa")


@query("SELECT doc_id, raw, " + ALIAS_SQL + " AS category FROM (SELECT doc_id, [" + ", ".join(f"'{r}'" for r in RAW) + "][doc_id % 7 + 1] AS raw FROM documents)")
def category_alias(spark: SparkSession, d: str) -> DataFrame:
    """Documents with one of a few raw categories each."""
    raw = F.get(F.array(*(F.lit(r) for r in RAW)), (F.col("doc_id") % 7).cast("int"))
    return table(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", U.canonical_category(F.col("raw")).alias("category"))


# Text


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, sha256({NORMALIZED}) AS normalized FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, len({WORDS.replace('@', 'text')})::INT AS words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id FROM documents WHERE len({WORDS.replace('@', 'text')}) >= 50")
def min_words_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(T.word_count(F.col("text")) >= 50).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN len({WORDS.replace('@', 'text')}) <= 70 THEN regexp_replace(coalesce(text, ''), '^{SPACES}+|{SPACES}+$', '', 'g') ELSE array_to_string(list_slice({WORDS.replace('@', 'text')}, 1, 70), ' ') END AS cut FROM documents")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.truncate_words(F.col("text"), 70).alias("cut"))


@query(f"WITH {WITH} SELECT art.id, sha256('T: ' || title || ' / ' || category || ' / ' || coalesce(src.source_id, 'unknown') || chr(10) || CASE WHEN length(content_text) > 6000 THEN regexp_replace(substr(content_text, 1, 6000), '(?s) [^ ]*$', '') || ' […]' ELSE content_text END) AS prompt FROM art LEFT JOIN src ON src.id = art.source_fk")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    known = domain.articles(spark, d).join(domain.sources(spark, d).select(F.col("id").alias("source_fk"), "source_id"), "source_fk", "left")
    made = T.render_prompt("T: {title} / {category} / {source}\n{content_text}", title=F.col("title"), category=F.col("category"), source=F.coalesce("source_id", F.lit("unknown")), content=F.col("content_text"))
    return known.select("id", F.sha2(made, 256).alias("prompt"))


@query(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_À-ỹ]+'))::INT AS n, sha256(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_À-ỹ]+'), lambda t: lower(t)), ' ')) AS tokens FROM documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("t", T.lower_tokens(F.col("text"))).select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(@, '([.!?…]){SPACES}+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENTENCES.replace('@', 'text')})::INT AS n, sha256(array_to_string({SENTENCES.replace('@', 'text')}, chr(1))) AS sentences FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("s", T.sentences(F.col("text"))).select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\x01"), 256).alias("sentences"))


BITS = " | ".join(f"(CASE WHEN sum(w * ((h >> {b}) & 1)::BIGINT) * 2 > sum(w) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))
GRAMS = r"SELECT doc_id, j, unnest(CASE WHEN length(j) < 4 THEN [j] ELSE list_transform(range(1, length(j) - 2), lambda i: substr(j, i, 4)) END) AS g FROM (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), '') AS j FROM documents) WHERE j <> ''"


@query(f"SELECT doc_id, count(*) AS n_features, sum(least(c, 50))::BIGINT AS weight FROM (SELECT doc_id, g, count(*) AS c FROM ({GRAMS}) GROUP BY ALL) GROUP BY doc_id")
def simhash_features(spark: SparkSession, d: str) -> DataFrame:
    grams = _docs(spark, d).select("doc_id", F.explode_outer(simhash_grams(F.col("text"))).alias("g")).where("g IS NOT NULL").groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("c"))
    return grams.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.least("c", F.lit(50))).alias("weight"))


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).withColumn("simhash", simhash64(F.col("text")))


HASHES = f"SELECT d.doc_id, coalesce(x.h, 0::UBIGINT) AS h FROM documents d LEFT JOIN (SELECT doc_id, {BITS} AS h FROM (SELECT doc_id, least(count(*), 50) AS w, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h FROM ({GRAMS}) GROUP BY doc_id, g) GROUP BY doc_id) x ON x.doc_id = d.doc_id"


@query(f"SELECT doc_id, format('{{:016x}}', h) AS simhash FROM ({HASHES})")
def simhash64_of_text(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    times = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return storage.cut_lineage(_hashed(spark, d).join(times, "doc_id").select(F.col("doc_id").alias("id"), "simhash", "fetched_at"))


@query(f"WITH h AS MATERIALIZED ({HASHES}), t AS MATERIALIZED (SELECT h.doc_id, h.h, e.ts FROM h JOIN events e ON e.event_id = h.doc_id) SELECT a.doc_id AS earlier, b.doc_id AS later, bit_count(xor(a.h, b.h))::INT AS distance FROM t a JOIN t b ON (a.ts < b.ts OR (a.ts = b.ts AND a.doc_id < b.doc_id)) AND b.ts - a.ts <= INTERVAL 2 DAY AND bit_count(xor(a.h, b.h)) <= 3")
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.near_pairs(_timed(spark, d))


# Quality checks

NUMERICS = r"list_filter(list_transform(regexp_extract_all(@, '\S*\d\S*'), lambda x: trim(x, '.,;:%()[]{}')), lambda x: x <> '')"
ENTITIES = rf"regexp_extract_all(@, '{TITLE}(?:{SPACES}+{TITLE})+')"


@query(f"WITH {WITH} SELECT conv_id, turn, array_to_string({NUMERICS.replace('@', 'reply')}, '|') AS numbers FROM turns")
def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return domain.turns(spark, d).select("conv_id", "turn", F.array_join(T.numeric_tokens(F.col("reply")), "|").alias("numbers"))


@query(f"WITH {WITH}, e AS (SELECT conv_id, turn, x, min(i) AS i FROM (SELECT conv_id, turn, unnest({ENTITIES.replace('@', 'reply')}) AS x, generate_subscripts({ENTITIES.replace('@', 'reply')}, 1) AS i FROM turns) GROUP BY ALL) SELECT turns.conv_id, turns.turn, coalesce(string_agg(e.x, '|' ORDER BY e.i), '') AS names FROM turns LEFT JOIN e USING (conv_id, turn) GROUP BY ALL".replace("GROUP BY ALL) SELECT", "GROUP BY conv_id, turn, x) SELECT"))
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return domain.turns(spark, d).select("conv_id", "turn", F.array_join(T.entities(F.col("reply")), "|").alias("names"))


LIMITS = quality.Thresholds(min_words=10, max_words=60, min_sentences=1, max_sentences=6)


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(domain.turns(spark, d), summary="reply", source="user_text", refusal=None, limits=LIMITS, fuzzy=False)


PUNCT = r"trim(regexp_replace(@, '[\s\p{Z}\-–—.,;:()\[\]{}/]+', ' ', 'g'))"
CHECKED = f"""WITH {WITH}, q AS (SELECT conv_id, turn, reply, user_text, len({WORDS.replace('@', 'reply')}) AS w, len({SENTENCES.replace('@', 'reply')}) AS k,
 list_filter({NUMERICS.replace('@', 'reply')}, lambda n: NOT (contains(user_text, n) OR ({PUNCT.replace('@', 'n')} <> '' AND contains({PUNCT.replace('@', 'user_text')}, {PUNCT.replace('@', 'n')})) OR (len(regexp_extract_all(n, '[0-9]{{3,}}')) > 0 AND len(list_filter(regexp_extract_all(n, '[0-9]{{3,}}'), lambda g: NOT contains(user_text, g))) = 0))) AS missing_n,
 list_filter({ENTITIES.replace('@', 'reply')}, lambda e: NOT (contains(user_text, e) OR contains({PUNCT.replace('@', 'user_text')}, {PUNCT.replace('@', 'e')}) OR len(list_filter({WORDS.replace('@', 'e')}, lambda v: length(v) >= 4 AND contains(user_text, v))) > 0)) AS missing_e FROM turns),
 r AS (SELECT conv_id, turn, w::INT AS words, k::INT AS sentences, list_filter([CASE WHEN w < 10 THEN 'too_short' END, CASE WHEN w > 60 THEN 'too_long' END, CASE WHEN k < 1 THEN 'too_few_sentences' END, CASE WHEN k > 6 THEN 'too_many_sentences' END, CASE WHEN len(missing_n) > 0 THEN 'unsupported_numbers' END, CASE WHEN len(missing_e) > 0 THEN 'unsupported_entities' END], lambda x: x IS NOT NULL) AS reasons FROM q)"""


@query(f"{CHECKED} SELECT conv_id, turn, words, sentences, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS passed FROM r")
def qc_battery(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.transform("qc.reasons", lambda r: F.split_part(r, F.lit(":"), F.lit(1))), "|")
    return _checked(spark, d).select("conv_id", "turn", F.col("qc.word_count").alias("words"), F.col("qc.sentence_count").alias("sentences"), names.alias("reasons"), "qc.passed")


@query(f"{CHECKED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def qc_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.reason_histogram(_checked(spark, d))


@query(f"WITH {WITH} SELECT src.source_id, count(*) FILTER (qc_passed) AS n_passed, count(*) FILTER (NOT qc_passed) AS n_failed, round(count(*) FILTER (qc_passed) / count(*), 6) AS pass_rate FROM lab JOIN art ON art.id = lab.article_fk JOIN src ON src.id = art.source_fk GROUP BY 1")
def qc_pass_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    joined = domain.labels(spark, d).drop("source").join(domain.articles(spark, d, "id", "source_fk").withColumnRenamed("id", "article_fk"), "article_fk").join(domain.sources(spark, d).select(F.col("id").alias("source_fk"), "source_id"), "source_fk")
    return reports.pass_rates(joined).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"WITH {WITH} SELECT round(avg(CASE WHEN len({WORDS.replace('@', 'reply')}) BETWEEN 40 AND 80 THEN 1.0 ELSE 0.0 END), 6) AS conformity FROM turns")
def length_conformity(spark: SparkSession, d: str) -> DataFrame:
    return reports.length_conformity(domain.turns(spark, d), T.word_count(F.col("reply"))).select(F.round("conformity", 6).alias("conformity"))


# Summaries and scores


def _user_sentences(spark: SparkSession, d: str) -> DataFrame:
    return summaries.sentence_tokens(table(spark, d, "benchmark"), id_col="item_id")


SENT = rf"""s AS (SELECT item_id AS id, unnest({SENTENCES.replace('@', 'text')}) AS x, generate_subscripts({SENTENCES.replace('@', 'text')}, 1) - 1 AS pos FROM benchmark),
 t AS (SELECT id, pos, list_transform(regexp_extract_all(x, '[\p{{L}}\p{{N}}_À-ỹ]+'), lambda w: lower(w)) AS tokens FROM s)"""


@query(f"WITH {SENT}, w AS (SELECT id, pos, len(tokens) AS n, unnest(list_distinct(tokens)) AS t FROM t) SELECT a.id, a.pos::INT AS i, b.pos::INT AS j, round(count(*) / (ln(1 + a.n) + ln(1 + b.n)), 6) AS weight FROM w a JOIN w b ON a.id = b.id AND a.t = b.t AND a.pos < b.pos GROUP BY a.id, a.pos, b.pos, a.n, b.n")
def textrank_edges(spark: SparkSession, d: str) -> DataFrame:
    return summaries.overlap_edges(_user_sentences(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {SENT}, n AS (SELECT id, count(*) AS n FROM t GROUP BY id), f AS (SELECT id, pos, t, count(*) AS tf FROM (SELECT id, pos, unnest(tokens) AS t FROM t) GROUP BY ALL), d AS (SELECT id, t, count(*) AS df FROM f GROUP BY ALL),
 w AS (SELECT f.id, f.pos, f.t, f.tf * (ln((1 + n.n) / (1 + d.df)) + 1) AS w FROM f JOIN d ON d.id = f.id AND d.t = f.t JOIN n ON n.id = f.id), u AS (SELECT id, pos, t, w / sqrt(sum(w * w) OVER (PARTITION BY id, pos)) AS w FROM w)
 SELECT a.id, a.pos::INT AS i, b.pos::INT AS j, round(sum(a.w * b.w), 6) AS weight FROM u a JOIN u b ON a.id = b.id AND a.t = b.t AND a.pos < b.pos GROUP BY a.id, a.pos, b.pos HAVING sum(a.w * b.w) >= 0.1""")
def lexrank_edges(spark: SparkSession, d: str) -> DataFrame:
    return summaries.cosine_edges(_user_sentences(spark, d)).withColumn("weight", F.round("weight", 6))


def _summary_sql(edges: str) -> str:
    """Ranks by iteration, all items a round at a time, until an item's scores move less than 1e-6 together."""
    return f"""WITH RECURSIVE {SENT}, e AS MATERIALIZED ({edges}), both_ways AS (SELECT id, i, j, weight FROM e UNION ALL SELECT id, j, i, weight FROM e),
 degree AS (SELECT id, i, sum(weight) AS total FROM both_ways GROUP BY id, i), move AS MATERIALIZED (SELECT b.id, b.i, b.j, 0.85 * b.weight / d.total AS part FROM both_ways b JOIN degree d ON d.id = b.id AND d.i = b.i),
 size AS (SELECT id, count(*) AS n FROM t GROUP BY id),
 r AS (SELECT t.id, t.pos, 0 AS step, 1.0::DOUBLE / n AS score, 1.0::DOUBLE AS moved FROM t JOIN size ON size.id = t.id
  UNION ALL SELECT id, pos, step, score, sum(abs(score - was)) OVER (PARTITION BY id) FROM (SELECT r.id, r.pos, r.step + 1 AS step, any_value(r.score) AS was, 0.15 / any_value(n) + coalesce(sum(m.part * f.score), 0) AS score FROM r JOIN size ON size.id = r.id LEFT JOIN move m ON m.id = r.id AND m.j = r.pos LEFT JOIN r f ON f.id = m.id AND f.pos = m.i WHERE r.moved >= 1e-6 AND r.step < 100 GROUP BY r.id, r.pos, r.step)),
 last AS (SELECT id, pos, score FROM r QUALIFY step = max(step) OVER (PARTITION BY id)),
 top AS (SELECT id, pos FROM last QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) <= 4),
 joined AS (SELECT s.id, string_agg(s.x, ' ' ORDER BY s.pos) AS x FROM top JOIN s ON s.id = top.id AND s.pos = top.pos GROUP BY s.id)
 SELECT id, CASE WHEN len({WORDS.replace('@', 'x')}) <= 70 THEN x ELSE array_to_string(list_slice({WORDS.replace('@', 'x')}, 1, 70), ' ') END AS summary FROM joined"""


OVERLAPS = "SELECT a.id, a.pos AS i, b.pos AS j, count(*) / (ln(1 + a.n) + ln(1 + b.n)) AS weight FROM (SELECT id, pos, len(tokens) AS n, unnest(list_distinct(tokens)) AS t FROM t) a JOIN (SELECT id, pos, len(tokens) AS n, unnest(list_distinct(tokens)) AS t FROM t) b ON a.id = b.id AND a.t = b.t AND a.pos < b.pos GROUP BY a.id, a.pos, b.pos, a.n, b.n"
COSINES = """WITH n AS (SELECT id, count(*) AS n FROM t GROUP BY id), f AS (SELECT id, pos, t, count(*) AS tf FROM (SELECT id, pos, unnest(tokens) AS t FROM t) GROUP BY ALL), d AS (SELECT id, t, count(*) AS df FROM f GROUP BY ALL),
 w AS (SELECT f.id, f.pos, f.t, f.tf * (ln((1 + n.n) / (1 + d.df)) + 1) AS w FROM f JOIN d ON d.id = f.id AND d.t = f.t JOIN n ON n.id = f.id), u AS (SELECT id, pos, t, w / sqrt(sum(w * w) OVER (PARTITION BY id, pos)) AS w FROM w)
 SELECT a.id, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS weight FROM u a JOIN u b ON a.id = b.id AND a.t = b.t AND a.pos < b.pos GROUP BY a.id, a.pos, b.pos HAVING sum(a.w * b.w) >= 0.1"""


def _items(spark: SparkSession, d: str, graph: str) -> DataFrame:
    return summaries.with_summary(table(spark, d, "benchmark"), options=summaries.Options(graph=graph)).select(F.col("item_id").alias("id"), "summary")


@query(_summary_sql(OVERLAPS))
def textrank_of_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "textrank")


@query(_summary_sql(COSINES))
def lexrank_of_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "lexrank")


@query()
def textrank_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.with_summary(_docs(spark, d), options=summaries.Options(graph="textrank")).select("doc_id", "summary")


@query()
def lexrank_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.with_summary(_docs(spark, d)).select("doc_id", "summary")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return domain.turns(spark, d).select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), F.col("reply").alias("prediction"), F.col("user_text").alias("reference"))


ASCII = "list_filter(regexp_split_to_array(lower(@), '[^a-z0-9]+'), lambda x: x <> '')"


def _rouge_sql(n: int) -> str:
    grams = lambda c: c if n == 1 else f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
    return f"""WITH {WITH}, k AS (SELECT conv_id || ':' || turn AS id, {ASCII.replace('@', 'reply')} AS p, {ASCII.replace('@', 'user_text')} AS r FROM turns), g AS (SELECT id, {grams('p')} AS p, {grams('r')} AS r FROM k),
 cp AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(p) AS x FROM g) GROUP BY ALL), cr AS (SELECT id, x, count(*) AS c FROM (SELECT id, unnest(r) AS x FROM g) GROUP BY ALL), m AS (SELECT cp.id, sum(least(cp.c, cr.c)) AS m FROM cp JOIN cr ON cp.id = cr.id AND cp.x = cr.x GROUP BY cp.id)
 SELECT g.id, round(CASE WHEN coalesce(m.m, 0) = 0 THEN 0.0 ELSE 2.0 * m.m / (len(p) + len(r)) END, 6) AS rouge{n} FROM g LEFT JOIN m ON m.id = g.id"""


@query(_rouge_sql(1))
def rouge1(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rouge_n(_pairs(spark, d), 1).withColumn("rouge1", F.round("rouge1", 6))


@query(_rouge_sql(2))
def rouge2(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rouge_n(_pairs(spark, d), 2).withColumn("rouge2", F.round("rouge2", 6))


# Pages, runs, streams


@query()
def article_extract(spark: SparkSession, d: str) -> DataFrame:
    return extracted(table(spark, d, "pages")).select("page_id", "article.title", "article.author", "article.published", "article.text")


#: By the length of the host: two files of rules, and none.
ROBOTS = ("User-agent: *\nDisallow: /de/", "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /fr/a\nDisallow: /fr/\nDisallow: /en/")
AFTER_HOST = "coalesce(regexp_extract(url, '^[^:]+://[^/?#]*(.*)$', 1), '')"


@query(f"SELECT page_id, host <> '' AND CASE length(host) % 3 WHEN 0 THEN NOT starts_with(path, '/de/') WHEN 1 THEN starts_with(path, '/fr/a') OR NOT (starts_with(path, '/fr/') OR starts_with(path, '/en/')) ELSE true END AS allowed FROM (SELECT page_id, coalesce({HOST}, '') AS host, {AFTER_HOST} AS path FROM pages)")
def robots_allow(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    kind = F.length("host") % 3
    rules = pages.select(U.url_host(F.col("url")).alias("host")).distinct().where("host <> ''").select("host", F.when(kind == 0, F.lit(ROBOTS[0])).otherwise(F.lit(ROBOTS[1])).alias("body"), F.when(kind == 2, F.lit(404)).otherwise(F.lit(200)).alias("status"))
    return feeds.robots_allow(pages, rules).select("page_id", "allowed")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events in the role of candidates: what became of one goes by its id."""
    kinds = F.array(*(F.lit(o) for o in reports.OUTCOMES))
    return table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("outcome"))


RUNS = "c AS (SELECT 'src' || (user_id % 20) AS source_id, count(*) AS discovered, " + ", ".join(f"count(*) FILTER (event_id % 6 = {k}) AS {o}" for k, o in enumerate(reports.OUTCOMES)) + " FROM events GROUP BY 1)"


@query(f"WITH {RUNS} SELECT * FROM c")
def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.crawl_counters(_outcomes(spark, d))


@query(f"WITH {RUNS} SELECT source_id, inserted AS n_new, skipped_seen + skipped_dupe + skipped_robots AS n_skipped, fetch_failed + extract_failed AS n_errors, CASE WHEN inserted > 0 THEN 'success' ELSE 'partial' END AS status, " + " || ' ' || ".join(f"'{c}=' || {c}" for c in ("discovered", *reports.OUTCOMES)) + " AS notes FROM c")
def crawl_run_status(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_row(reports.crawl_counters(_outcomes(spark, d))).select("source_id", "n_new", "n_skipped", "n_errors", "status", "notes")


@query(f"WITH {RUNS}, r AS (SELECT source_id, inserted AS n_new, fetch_failed + extract_failed AS n_errors FROM c) SELECT source_id, round(n_errors / (n_new + n_errors), 6) AS error_rate FROM r WHERE n_errors / (n_new + n_errors) > 0.3")
def source_health_alert(spark: SparkSession, d: str) -> DataFrame:
    return reports.health_alerts(reports.run_row(reports.crawl_counters(_outcomes(spark, d)))).select("source_id", F.round("error_rate", 6).alias("error_rate"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.event_windows(rows).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query(f"SELECT min(doc_id) AS doc_id, sha256({NORMALIZED}) AS key FROM documents GROUP BY 2")
def streaming_incremental_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream of files, each batch checked against all that came before."""
    folder = f"{storage.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    # A pattern, since the table may be a file or a folder of files.
    source = spark.readStream.schema(schema).parquet(f"{d}/document[s].parquet")
    incremental.dedupe_stream(source.select("doc_id", "text"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "key")
