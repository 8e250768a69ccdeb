"""Train, validation and test sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import split_bucket
from corpusloom.functions.text import iso_time

#: Fixed value: what the split hash is salted with.
SALT = "vn-news-v1"


def dataset_rows(labels: DataFrame, articles: DataFrame, sources: DataFrame, *, prompt_version: str, salt: str = SALT) -> DataFrame:
    """One row per passing model label of the prompt, with its split; an article with several has several rows."""
    passed = labels.where((F.col("source") == "llm") & F.col("qc_passed") & (F.col("prompt_version") == prompt_version))
    joined = passed.alias("l").join(articles.alias("a"), F.col("l.article_fk") == F.col("a.id")).join(sources.alias("s"), F.col("a.source_fk") == F.col("s.id"))
    return joined.select(
        F.col("a.id").alias("article_id"), F.col("s.source_id").alias("source"), "a.url", "a.title", "a.category", iso_time(F.col("a.published_at")).alias("published_at"),
        "a.content_text", F.col("l.summary_text").alias("summary"), "l.prompt_version", split_bucket(salt, F.col("a.id")).alias("split"),
    )


def split_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def version_row(rows: DataFrame, name: str, description: str = "") -> DataFrame:
    """The dataset's name and, per split, its sorted ids: a report whose size is the dataset's number of ids."""
    ids = lambda s: F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("article_id"))))
    return rows.agg(F.lit(name).alias("name"), F.lit(description).alias("description"), *(ids(s).alias(f"{s}_ids") for s in ("train", "val", "test")))


#: Fixed value: how many ids a bitmap of Spark's has room for.
BITMAP_BITS = 32_768


def manifest(rows: DataFrame, name: str) -> DataFrame:
    """``(name, split, bucket, ids)``: which articles each split has, as bitmaps of 32,768 ids, a row for each bucket.

    However many ids there are, no row and no task holds more than a bucket of them.  An
    article with several rows counts once.
    """
    id_ = F.col("article_id").cast("long")
    kept = rows.where(id_.isNotNull()).select("split", F.bitmap_bucket_number(id_).alias("bucket"), F.bitmap_bit_position(id_).alias("bit"))
    return kept.groupBy("split", "bucket").agg(F.bitmap_construct_agg("bit").alias("ids")).select(F.lit(name).alias("name"), "split", "bucket", "ids")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("name", "split").agg(F.sum(F.bitmap_count("ids")).alias("n"))


def manifest_ids(manifest: DataFrame) -> DataFrame:
    """``(name, split, article_id)`` from the bitmaps; ids from 1 on count up from their bucket's start, others down from it."""
    digits = F.split(F.hex("ids"), "(?<=\\G..)")
    octets = F.transform(digits, lambda x: F.conv(x, 16, 10).cast("int"))
    set_ = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_BITS - 1)), lambda p: F.getbit(F.coalesce(F.get(F.col("_octets"), F.floor(p / 8).cast("int")), F.lit(0)), p % 8) == 1)
    spread = manifest.withColumn("_octets", octets).select("name", "split", "bucket", F.explode(set_).alias("bit"))
    up = (F.col("bucket") - 1) * BITMAP_BITS + F.col("bit") + 1
    return spread.select("name", "split", F.when(F.col("bucket") > 0, up).otherwise(F.col("bucket") * BITMAP_BITS - F.col("bit")).alias("article_id"))


def split_of(ids: DataFrame, manifest: DataFrame, *, id_col: str = "article_id") -> DataFrame:
    """``ids`` with ``split``: where a version's manifest has them, null where it does not; bitmaps are joined by bucket, and stay whole."""
    id_ = F.col(id_col).cast("long")
    placed = ids.withColumns({"_bucket": F.bitmap_bucket_number(id_), "_bit": F.bitmap_bit_position(id_)})
    held = manifest.groupBy(F.col("bucket").alias("_bucket")).agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("_maps"))
    octet = lambda ids_: F.conv(F.hex(F.substring(ids_, F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.filter(F.map_entries("_maps"), lambda e: F.getbit(octet(e["value"]), (F.col("_bit") % 8).cast("int")) == 1)
    return placed.join(held, "_bucket", "left").withColumn("split", F.get(has, 0)["key"]).drop("_bucket", "_bit", "_maps")


def training_rows(rows: DataFrame, *, text: str = "content_text", target: str = "summary", fallback: tuple[str, str] = ("content_text", "summary")) -> DataFrame:
    """``(text, target)`` where neither is empty; a column that is not there gives way to its default."""
    t, y = (c if c in rows.columns else d for c, d in zip((text, target), fallback, strict=True))
    return rows.select(F.col(t).alias("text"), F.col(y).alias("target")).where((F.length("text") > 0) & (F.length("target") > 0))


def tokenized(rows: DataFrame, make_tokenizer: Callable[[], Callable[[str, int], list[int]]], *, most_text: int = 1024, most_target: int = 128, keep: tuple[str, ...] = ()) -> DataFrame:
    """``input_ids, attention_mask, labels`` of ``(text, target)``, after the columns ``keep``; the tokenizer is made once per worker and truncates."""
    kept = rows.select(*keep)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_tokenizer()
        for batch in batches:
            ids = [encode(t, most_text) for t in batch["text"]]
            yield pd.DataFrame({**{c: batch[c] for c in keep}, "input_ids": ids, "attention_mask": [[1] * len(i) for i in ids], "labels": [encode(t, most_target) for t in batch["target"]]})

    return rows.select(*keep, "text", "target").mapInPandas(run, ddl + "input_ids array<int>, attention_mask array<int>, labels array<int>")


def pad_negative(ids, pad: int):
    """Column: negative ids, which mark what a loss skips, as the pad id."""
    return F.transform(ids, lambda x: F.when(x < 0, F.lit(pad)).otherwise(x))
