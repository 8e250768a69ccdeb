"""Incremental ingestion: each micro-batch goes through the batch operators against what is stored."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import normalized
from corpusloom.operators.articles import ingest
from corpusloom.sources.keys import KeyStore
from corpusloom.sources.storage import cut_lineage, delete, exists, remove

STORED = "id long, url_hash string, simhash long, fetched_at timestamp"


def stored_so_far(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What earlier batches stored; a batch that runs again does not see its own first try."""
    try:
        found = spark.read.parquet(folder)
    except AnalysisException as problem:
        # The folder is not there, or holds batches without rows only.
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], STORED + ", batch long, day date")
    return found if before is None else found.where(F.col("batch") < before)


def stored_urls(spark: SparkSession, folder: str) -> KeyStore:
    """The URL hashes of what ``folder`` holds, beside it; made from its rows if they are not there yet."""
    store = KeyStore(spark, f"{folder}_urls")
    if exists(spark, folder) and not exists(spark, f"{folder}_urls"):
        store.add(stored_so_far(spark, folder).select("url_hash"), -1)
    return store


def store(outcomes: DataFrame, folder: str, batch: int) -> None:
    """Write a batch's inserted rows to its own sub-folder, by day, and their URL hashes to the store of these."""
    inserted = outcomes.where(F.col("outcome") == "inserted").drop("outcome").withColumn("day", F.to_date("fetched_at"))
    stored_urls(outcomes.sparkSession, folder).add(inserted.select("url_hash"), batch)
    inserted.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={batch}")


def ingest_stream(candidates: DataFrame, folder: str, checkpoint: str, *, processing_time: str | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that ingests a stream of candidates into ``folder``, one sub-folder per batch.

    Without ``processing_time`` it takes what is there and ends.  A batch's rows are
    written to the batch's own sub-folder, by day, overwriting a failed try's, so each is
    stored once.  Of the whole history only those files of URL hashes are opened that may hold
    one of the batch (``KeyStore``); near duplicates are looked for from two days before the batch's first row on, and older days are not opened.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min("fetched_at")).first()[0]
        urls = stored_urls(spark, folder)
        outcomes = cut_lineage(ingest(batch, stored_so_far(spark, folder, before=number), as_of=None if first is None else F.lit(first), known=lambda keys: urls.known(keys, before=number)))
        store(outcomes, folder, number)
        if on_batch:
            on_batch(outcomes, number)

    started = candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (started.trigger(processingTime=processing_time) if processing_time else started.trigger(availableNow=True)).start()


def dedupe_stream(rows: DataFrame, folder: str, checkpoint: str, *, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Append the rows whose normalised text no earlier row has, the smallest id of a batch first.

    The hashes of all texts so far are a ``KeyStore`` beside ``folder``, of which a batch
    opens only files that may hold one of its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("key", F.sha2(normalized(F.col(text_col)), 256))
        ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("key").orderBy(id_col))).where(F.col("_rank") == 1).drop("_rank")
        first, keys = cut_lineage(ranked), KeyStore(batch.sparkSession, f"{folder}_keys")
        fresh = first.join(keys.known(first.select("key"), before=number), "key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        # The keys are read from what was written, so that texts are written once.
        keys.add(batch.sparkSession.read.schema(fresh.schema).parquet(f"{folder}/batch={number}").select("key"), number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and value sums by tumbling window and type, with late rows up to the watermark; streams and batches alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def expire(spark: SparkSession, folder: str, before: dt.date, taken_down: DataFrame | None = None) -> int:
    """Delete the days of ``folder`` that lie before a date, and the rows whose id ``taken_down`` has; how many days' folders went.

    Days are folders of their own, so nothing is read or written to drop them; of the rest
    only files that hold a row to be taken down are written anew.  URL hashes stay, so what
    is gone is not fetched again.
    """
    if not exists(spark, folder):
        return 0
    gone = 0
    for place in _folders(spark, folder, "batch="):
        for day in _folders(spark, place, "day="):
            if day.rsplit("day=", 1)[1] < before.isoformat():
                gone += delete(spark, day)
    left = [d for place in _folders(spark, folder, "batch=") for d in _folders(spark, place, "day=")]
    if taken_down is not None and left:
        remove(spark, folder, taken_down, "id", partitioned=("batch", "day"))
    return gone


def _folders(spark: SparkSession, folder: str, start: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName().startswith(start)]


def retained(articles: DataFrame, as_of, days: int = 30, taken_down: DataFrame | None = None) -> DataFrame:
    """Articles not older than ``days``, without those taken down (by ``id``)."""
    kept = articles.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return kept if taken_down is None else kept.join(taken_down.select("id"), "id", "left_anti")


__all__ = ["dedupe_stream", "event_windows", "expire", "ingest_stream", "retained", "store", "stored_so_far", "stored_urls"]
