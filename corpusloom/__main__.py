"""Command line: ``python -m corpusloom {crawl,ingest,retire,label,export,evaluate,query} …``."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import articles, crawl, dataset, labelling, reports, scoring, summaries
from corpusloom.sources import feeds, storage
from corpusloom.sources.config import load_prompt, settings
from corpusloom.sources.feed_stream import rounds
from corpusloom.sources.versions import Table
from corpusloom.streaming.incremental import expire, store, stored_so_far, stored_urls


def parser() -> argparse.ArgumentParser:
    own, known = argparse.ArgumentParser(prog="corpusloom", description=__doc__), settings()
    sub = own.add_subparsers(dest="command", required=True)
    crawling = sub.add_parser("crawl", help="crawl the catalogue's feeds; ends with 1 if nothing is new, with 2 without a catalogue")
    crawling.add_argument("--config", default="sources.yaml", help="YAML file of the sources")
    crawling.add_argument("--fetch", required=True, help="module:function that gives (status, text) of a URL")
    crawling.add_argument("--store", default=f"{known.warehouse}/articles")
    crawling.add_argument("--source", action="append", default=[])
    crawling.add_argument("--delay", type=float, default=1.0, help="seconds between two calls to one host")
    crawling.add_argument("--wait", type=float, default=1.0, help="seconds before a failed call is tried again; doubled each time")
    crawling.add_argument("--schedule", action="store_true", help="crawl again and again; rounds missed meanwhile are one")
    crawling.add_argument("--interval", type=float, default=30.0, help="minutes between two crawls")
    crawling.add_argument("--rounds", type=int, help="end after so many crawls")
    ingest = sub.add_parser("ingest", help="ingest a Parquet table of fetched candidates; ends with 1 if nothing is new")
    ingest.add_argument("candidates")
    ingest.add_argument("--store", default=f"{known.warehouse}/articles")
    ingest.add_argument("--source", action="append", default=[])
    retire = sub.add_parser("retire", help="delete stored articles that are too old, or taken down; ends with 1 if nothing is left")
    retire.add_argument("--store", default=f"{known.warehouse}/articles")
    retire.add_argument("--days", type=int, default=30)
    retire.add_argument("--taken-down", help="Parquet table with the ids of articles to take down")
    retire.add_argument("--today", type=dt.date.fromisoformat, help="the day to count from")
    label = sub.add_parser("label", help="label a batch of articles and append the labels; ends with 1 if none was labelled")
    label.add_argument("--prompt", required=True, help="YAML file of the prompt and its limits")
    label.add_argument("--model", required=True, help="module:function that answers a prompt's text")
    label.add_argument("--tables", default=known.warehouse, help="folder of Parquet tables or JDBC URL")
    label.add_argument("--source", action="append", default=[])
    label.add_argument("--limit", type=int, default=50)
    label.add_argument("--concurrency", type=int, default=1, help="calls under way at a time in each task")
    label.add_argument("--wait", type=float, default=1.0, help="seconds before a failed call is tried again; doubled each time")
    export = sub.add_parser("export", help="write a dataset version from labels, articles and sources; ends with 2 if there is one of that name")
    export.add_argument("name")
    export.add_argument("--prompt-version", required=True)
    export.add_argument("--tables", default=known.warehouse, help="folder of Parquet tables or JDBC URL")
    export.add_argument("--dataset-root", default=known.dataset_root)
    evaluate = sub.add_parser("evaluate", help="score a summariser on a split; ends with 2 without the dataset, the model or the scorer")
    evaluate.add_argument("--baseline", choices=("lexrank", "textrank"), default="lexrank")
    evaluate.add_argument("--dataset", default="v1")
    evaluate.add_argument("--dataset-root", default=known.dataset_root)
    evaluate.add_argument("--split", choices=storage.SPLITS, default="test")
    evaluate.add_argument("--max-words", type=int, default=70)
    evaluate.add_argument("--max-sentences", type=int, default=4)
    evaluate.add_argument("--limit", type=int)
    evaluate.add_argument("--model", help="module:function that makes a model, instead of a baseline")
    evaluate.add_argument("--scorer", help="module:function that scores lists of predictions and references")
    evaluate.add_argument("--metrics", help="folder of the metrics table to append to")
    query = sub.add_parser("query", help="run a registered query and write its result as Parquet")
    query.add_argument("name")
    query.add_argument("tables")
    query.add_argument("out")
    return own


def imported(target: str) -> Callable:
    module, function = target.split(":", 1)
    return getattr(importlib.import_module(module), function)


def keep_run(spark: SparkSession, outcomes: DataFrame, folder: str, number: int) -> int:
    """Store what a batch inserted and a row of counters for each source; the number of new articles."""
    store(outcomes, folder, number)
    report = reports.run_row(reports.crawl_counters(outcomes)).select("source_id", "status", "n_new", "n_skipped", "n_errors", "notes")
    report = storage.cut_lineage(report.withColumns({"batch": F.lit(number), "finished_at": F.lit(dt.datetime.now(dt.timezone.utc))}))
    report.write.mode("append").parquet(f"{folder}_runs")
    report.show(1000, truncate=False)
    return report.agg(F.coalesce(F.sum("n_new"), F.lit(0))).first()[0]


def run_crawl(spark: SparkSession, args: argparse.Namespace) -> int:
    if not os.path.exists(args.config):
        print(f"no such catalogue: {args.config}", file=sys.stderr)
        return 2
    sources, get, new = feeds.catalogue(spark, args.config), imported(args.fetch), 0
    robots = spark.createDataFrame([], feeds.ROBOTS)
    Table(spark, f"{args.store}_sources", "source_id", feeds.CATALOGUE, buckets=1).merge(sources)
    for done, _ in enumerate(rounds(60 * args.interval), 1):
        stored = stored_so_far(spark, args.store)
        number = (stored.agg(F.max("batch")).first()[0] or 0) + 1
        now = F.lit(dt.datetime.now(dt.timezone.utc))
        outcomes, robots = crawl.crawl(sources, stored, robots, get, now=now, batch=number, only=args.source, known=stored_urls(spark, args.store).known, interval=args.delay, jitter=0.05, wait=args.wait)
        new += keep_run(spark, storage.cut_lineage(outcomes), args.store, number)
        if not args.schedule or done == args.rounds:
            break
    return 0 if new else 1


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = spark.read.parquet(args.candidates)
    if args.source:
        rows = rows.where(F.col("source_id").isin(args.source))
    stored = stored_so_far(spark, args.store)
    number = (stored.agg(F.max("batch")).first()[0] or 0) + 1
    first = rows.agg(F.min("fetched_at")).first()[0]
    outcomes = storage.cut_lineage(articles.ingest(rows, stored, as_of=None if first is None else F.lit(first), known=stored_urls(spark, args.store).known))
    return 0 if keep_run(spark, outcomes, args.store, number) else 1


def run_retire(spark: SparkSession, args: argparse.Namespace) -> int:
    today = args.today or dt.datetime.now(dt.timezone.utc).date()
    taken = spark.read.parquet(args.taken_down) if args.taken_down else None
    gone = expire(spark, args.store, today - dt.timedelta(args.days), taken)
    left = stored_so_far(spark, args.store).count()
    print(json.dumps({"days_deleted": gone, "articles": left}))
    return 0 if left else 1


def run_label(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda name: storage.load(spark, args.tables, name)
    prompt, call = load_prompt(args.prompt), imported(args.model)
    sources, labels = read("sources"), read("labels")
    chosen = labelling.unlabelled(read("articles"), labels, prompt_version=prompt.version, sources=sources, only=args.source, limit=args.limit)
    named = labelling.named_source(chosen, sources)
    asked = text.render_prompt(prompt.user_template, title=F.col("title"), category=F.col("category"), source=F.col("source_name"), content=F.col("content_text"))
    prompts = named.select(F.col("id").alias("article_fk"), text.source_text(F.col("title"), F.col("content_text")).alias("source_text"), asked.alias("prompt"))
    # Written once: the calls are not made again by whoever reads the outcomes.
    outcomes = storage.cut_lineage(labelling.label(prompts, call, limits=prompt.limits, wait=args.wait, concurrency=args.concurrency))
    made = outcomes.where("outcome <> 'error'").select("article_fk", F.col("summary").alias("summary_text"), F.col("qc.passed").alias("qc_passed"))
    storage.save(storage.cut_lineage(labelling.new_labels(labels, made, prompt_version=prompt.version)), args.tables, "labels")
    passed = outcomes.where("outcome = 'passed'").select(F.col("article_fk").alias("id"), F.lit("summarized").alias("status"))
    storage.update(spark, passed, args.tables, "articles", "id")
    counts = labelling.label_counts(outcomes).first().asDict()
    print(json.dumps({"prompt_version": prompt.version, **counts}))
    return 0 if counts["labelled"] else 1


def run_export(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda name: storage.load(spark, args.tables, name)
    kept = f"{args.dataset_root}/{args.name}_manifest"
    if storage.exists(spark, kept):
        print(f"there is a version of that name: {args.name}", file=sys.stderr)
        return 2
    rows = storage.cut_lineage(dataset.dataset_rows(read("labels"), read("articles"), read("sources"), prompt_version=args.prompt_version))
    storage.write_dataset(rows, f"{args.dataset_root}/{args.name}")
    dataset.manifest(rows, args.name).write.parquet(kept)
    dataset.split_sizes(rows).show()
    return 0


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        rows = storage.read_split(spark, f"{args.dataset_root}/{args.dataset}", args.split)
    except FileNotFoundError as missing:
        print(f"no such dataset: {missing}", file=sys.stderr)
        return 2
    try:
        model, scorer = (imported(t) if t else None for t in (args.model, args.scorer))
    except (ImportError, AttributeError, ValueError) as missing:
        print(f"no such model or scorer: {missing}", file=sys.stderr)
        return 2
    if args.limit is not None:
        rows = rows.orderBy("article_id", "url").limit(args.limit)
    options = summaries.Options(graph=args.baseline, max_words=args.max_words, max_sentences=args.max_sentences)
    asked = rows.withColumnRenamed("summary", "reference")
    if model:
        made = summaries.generated(asked, model, text_col="content_text", out="prediction")
    else:
        made = summaries.with_summary(asked, text_col="content_text", options=options, out="prediction")
    pairs = storage.cut_lineage(made.select(F.concat_ws(":", "article_id", "url").alias("id"), "prediction", "reference"))
    scores = scoring.corpus_scores(pairs, scorer=scorer).first().asDict()
    if args.metrics:
        storage.metrics_row(spark, args.metrics, f"{args.dataset}-{args.split}", {"model": args.model or args.baseline, "max_words": args.max_words}, scores)
    print(json.dumps({"baseline": args.model or args.baseline, "split": args.split, **scores}, ensure_ascii=False))
    return 0


def run_query(spark: SparkSession, args: argparse.Namespace) -> int:
    from corpusloom.plans import lifecycle  # noqa: F401  adds its queries to the catalogue's
    from corpusloom.plans.catalog import QUERIES

    if args.name not in QUERIES:
        print("known queries: " + ", ".join(sorted(QUERIES)), file=sys.stderr)
        return 2
    QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"crawl": run_crawl, "ingest": run_ingest, "retire": run_retire, "label": run_label, "export": run_export, "evaluate": run_evaluate, "query": run_query}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
