"""Table schemas and value sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = "id int, source_id string, name string, domain string, rss_urls array<string>, enabled boolean, robots_ok boolean, created_at timestamp, updated_at timestamp"
ARTICLES = (
    "id int, source_fk int, url string, url_hash string, title string, author string, category string, published_at timestamp, fetched_at timestamp, language string, "
    "raw_html_path string, content_text string, word_count int, simhash bigint, status string, error string, created_at timestamp, updated_at timestamp"
)
SUMMARIES = (
    "id int, article_fk int, summary_text string, model_name string, model_version string, prompt_version string, rouge1 double, rouge2 double, rougeL double, "
    "bertscore_f1 double, factuality_score double, is_published boolean, created_at timestamp"
)
QC_DETAILS = "struct<passed:boolean,reasons:array<string>,word_count:int,sentence_count:int,missing_numbers:array<string>,missing_entities:array<string>>"
LABELS = f"id int, article_fk int, source string, summary_text string, prompt_version string, reviewer_id string, quality string, notes string, qc_passed boolean, qc_details {QC_DETAILS}, created_at timestamp"
DATASET_VERSIONS = "id int, name string, description string, train_ids array<int>, val_ids array<int>, test_ids array<int>, created_at timestamp"
CRAWL_RUNS = "id int, source_fk int, started_at timestamp, ended_at timestamp, n_new int, n_skipped int, n_errors int, status string, notes string"
MODEL_RUNS = "id int, model_name string, version string, params map<string,string>, metrics map<string,string>, artifact_path string, dataset_version_fk int"
EXAMPLE = "article_id bigint, source string, url string, title string, category string, published_at string, content_text string, summary string, prompt_version string"
LABEL_REPLY = "summary string, key_entities array<string>, confidence double, refusal_reason string"

#: The states of rows.
ARTICLE_STATUS = ("new", "cleaned", "summarized", "failed")
LABEL_SOURCE = ("llm", "human", "llm+human")
LABEL_QUALITY = ("good", "bad", "fix")
CRAWL_STATUS = ("success", "partial", "failed")


def violations(articles: DataFrame) -> DataFrame:
    """``articles`` with ``violation``: the first constraint that a row breaks, else null."""
    checks = [
        (F.length("url_hash") != 32, "url_hash must have 32 characters"),
        (F.col("url").isNull() | (F.col("url") == ""), "url is required"),
        (~F.coalesce(F.col("status").isin(*ARTICLE_STATUS), F.lit(False)), "unknown status"),
        (F.col("word_count") < 0, "word_count is negative"),
    ]
    return articles.withColumn("violation", F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in checks)))


def public_article(articles: DataFrame) -> DataFrame:
    """What readers see of an article."""
    return articles.select("id", "source_fk", "url", "title", "author", "category", "published_at", "fetched_at", "language", "content_text", "word_count", "status")


def public_source(sources: DataFrame) -> DataFrame:
    return sources.select("id", "source_id", "name", "domain", "enabled")


def public_summary(summaries: DataFrame) -> DataFrame:
    return summaries.select("id", "article_fk", "summary_text", "model_name", "model_version", "prompt_version", "is_published", "created_at")


def public_label(labels: DataFrame) -> DataFrame:
    return labels.select("id", "article_fk", "source", "summary_text", "prompt_version", "quality", "qc_passed", "created_at")


def one_of(column: Column, values: tuple[str, ...]) -> Column:
    return column.isin(*values)
