"""Choosing articles to label, labelling them, and keeping the results."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.quality import Thresholds, quality
from corpusloom.schemas import LABEL_REPLY


def unlabelled(articles: DataFrame, labels: DataFrame, *, prompt_version: str, sources: DataFrame | None = None, only: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """Cleaned or summarized articles with text and no model label for the prompt, newest first, dates missing last."""
    done = labels.where((F.col("source") == "llm") & (F.col("prompt_version") == prompt_version)).select(F.col("article_fk").alias("id"))
    open_rows = articles.where(F.col("status").isin("cleaned", "summarized") & F.col("content_text").isNotNull()).join(done, "id", "left_anti")
    if only:
        wanted = sources.where(F.col("source_id").isin(only)).select(F.col("id").alias("source_fk"))
        open_rows = open_rows.join(wanted, "source_fk", "left_semi")
    ordered = open_rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def named_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``articles`` with ``source_name``, 'unknown' where the source is not known."""
    names = sources.select(F.col("id").alias("source_fk"), F.col("name").alias("source_name"))
    return articles.join(names, "source_fk", "left").withColumn("source_name", F.coalesce("source_name", F.lit("unknown")))


def parse_reply(raw: Column) -> Column:
    """struct(summary, key_entities, confidence, refusal_reason, error) of a model's JSON reply.

    Control characters inside strings are allowed; a confidence over 1 counts as 1; a null
    summary with a refusal is an empty one.  ``error`` says what makes a reply unusable.
    """
    got = F.from_json(raw, LABEL_REPLY, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})
    refused = F.coalesce(got["refusal_reason"], F.lit("")) != ""
    summary = F.when(got["summary"].isNull() & refused, F.lit("")).otherwise(got["summary"])
    confidence = F.least(F.coalesce(got["confidence"], F.lit(0.0)), F.lit(1.0))
    whole = F.coalesce(raw.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False)) & F.from_json(raw, "map<string,string>", {"allowUnquotedControlChars": "true"}).isNotNull()
    error = F.when(~whole, F.lit("not valid JSON")).when(summary.isNull(), F.lit("summary is missing")).when(F.isnan(confidence) | (confidence < 0), F.lit("confidence is out of range"))
    return F.struct(summary.alias("summary"), F.coalesce(got["key_entities"], F.array().cast("array<string>")).alias("key_entities"), confidence.alias("confidence"), got["refusal_reason"].alias("refusal_reason"), error.alias("error"))


def generate(prompts: DataFrame, call: Callable[[str], str], *, prompt_col: str = "prompt", tries: int = 5, wait: float = 0.0, concurrency: int = 1, transient: tuple[str, ...] = ("429", "deadline", "unavailable", "timeout", "internal")) -> DataFrame:
    """``prompts`` with ``reply`` and ``call_error`` from the given callable.

    Transient errors are tried again, after ``wait`` seconds, then twice as many, and so on, a
    minute at most; others become data.  Each task has ``concurrency`` calls under way at
    a time; answers keep the order of their prompts.
    """

    def ask(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(tries):
            if attempt and wait:
                time.sleep(min(60.0, wait * 2 ** (attempt - 1)) * random.uniform(0.8, 1.2))
            try:
                return call(prompt), None
            except Exception as problem:  # noqa: BLE001  the adapter's errors are data
                error = f"{type(problem).__name__}: {problem}"
                if not any(word in error.lower() for word in transient):
                    break
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for batch in batches:
                answers = list(pool.map(ask, batch[prompt_col]))
                yield batch.assign(reply=[a for a, _ in answers], call_error=[e for _, e in answers])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, reply string, call_error string")


def label(prompts: DataFrame, call: Callable[[str], str], *, limits: Thresholds = Thresholds(), source: str = "source_text", fuzzy: bool = True, wait: float = 0.0, concurrency: int = 1) -> DataFrame:
    """Replies parsed and checked: ``outcome`` is error, failed or passed; ``qc`` is null for errors."""
    parsed = generate(prompts, call, wait=wait, concurrency=concurrency).withColumn("_p", parse_reply(F.col("reply")))
    flat = parsed.withColumns({"summary": F.col("_p.summary"), "refusal_reason": F.col("_p.refusal_reason"), "error": F.coalesce("call_error", "_p.error")}).drop("_p")
    checked = quality(flat, summary="summary", source=source, limits=limits, fuzzy=fuzzy)
    outcome = F.when(F.col("error").isNotNull(), F.lit("error")).when(F.col("qc.passed"), F.lit("passed")).otherwise(F.lit("failed"))
    return checked.withColumn("outcome", outcome).withColumn("qc", F.when(F.col("outcome") != "error", F.col("qc")))


def new_labels(stored: DataFrame, made: DataFrame, *, prompt_version: str, source: str = "llm") -> DataFrame:
    """The labels ``made`` (article_fk, summary_text, qc_passed) as rows of ``stored``, without articles that have one for the prompt; other columns are null."""
    done = stored.where((F.col("source") == source) & (F.col("prompt_version") == prompt_version)).select("article_fk")
    fresh = made.join(done, "article_fk", "left_anti").withColumns({"source": F.lit(source), "prompt_version": F.lit(prompt_version)})
    return fresh.select(*((F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema.fields))


def append_labels(stored: DataFrame, made: DataFrame, *, prompt_version: str, source: str = "llm") -> DataFrame:
    return stored.unionByName(new_labels(stored, made, prompt_version=prompt_version, source=source))


def label_counts(outcomes: DataFrame) -> DataFrame:
    """requested, labelled, qc_passed, qc_failed, llm_errors, qc_pass_rate (0 if none was labelled)."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    counts = outcomes.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("outcome") != "error").alias("labelled"), is_("passed").alias("qc_passed"), is_("failed").alias("qc_failed"), is_("error").alias("llm_errors"))
    return counts.withColumn("qc_pass_rate", F.coalesce(F.try_divide("qc_passed", "labelled"), F.lit(0.0)))


def mark_summarized(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """``articles`` with the status of those that have a passing label set to summarized."""
    passed = labels.where("qc_passed").select(F.col("article_fk").alias("_id")).distinct()
    joined = articles.join(passed, articles["id"] == passed["_id"], "left")
    return joined.withColumn("status", F.when(F.col("_id").isNotNull(), F.lit("summarized")).otherwise(F.col("status"))).select(articles.columns)
