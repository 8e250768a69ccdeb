"""The test tables in the roles of the domain's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.storage import table

#: The same views for DuckDB.
WITH = """
src AS (SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, source AS source_id, 'Source ' || substr(source, 4) AS name FROM documents WHERE source IS NOT NULL),
art AS (SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS INT) AS source_fk, 'https://example.org/' || d.lang || '/' || d.doc_id AS url, 'Title ' || d.doc_id AS title, d.lang AS category,
        e.ts AS published_at, e.ts AS fetched_at, d.text AS content_text, 'cleaned' AS status FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id),
lab AS (SELECT doc_id AS article_fk, 'llm' AS source, 'v1' AS prompt_version, 'Summary ' || doc_id AS summary_text, quality = 1 AS qc_passed FROM labels),
turns AS (SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS reply FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    number = F.substr("source", F.lit(4))
    return table(spark, d, "documents").where("source IS NOT NULL").select(number.cast("int").alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("Source "), number).alias("name")).distinct()


def articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.substr("source", F.lit(4)).cast("int").alias("source_fk"), F.concat(F.lit("https://example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("category"), F.col("text").alias("content_text"), F.lit("cleaned").alias("status"),
    )
    times = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"), F.col("ts").cast("timestamp").alias("fetched_at"))
    found = rows.join(times, "id", "left")
    return found.select(*columns) if columns else found


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("article_fk"), F.lit("llm").alias("source"), F.lit("v1").alias("prompt_version"), F.concat(F.lit("Summary "), F.col("doc_id").cast("string")).alias("summary_text"), (F.col("quality") == 1).alias("qc_passed"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    rows = table(spark, d, "conversations")
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_text"))
    reply = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return user.join(reply, ["conv_id", "turn"])
