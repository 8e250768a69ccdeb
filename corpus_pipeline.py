"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` chains them over
``documents``, writing each stage's result as Parquet in the shared folder and reading it
back as the next one's input.  All stages but the last return the columns they were given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import default_ranks, token_digest
from corpusloom.llm.decontaminate import contaminated
from corpusloom.llm.line_dedup import with_lines_dropped
from corpusloom.llm.shared import shared_dir, table
from corpusloom.llm.simhash_dedup import near_duplicates
from corpusloom.llm.toxicity import fit, score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame) -> DataFrame:
    """``(row, id, sig)``: each row whole, as a struct, so that its columns can have any names, its id and its text's XXH64.

    Id and text together tell rows apart, since ids can be null or repeated; a null text
    counts as an empty one.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("sig"))


def _back(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts have the score of the bias alone.  Repeated rows have one score.
    All columns pass as they are; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = "score"
    while found in {c.lower() for c in docs.columns}:
        found += "_"
    return score(docs, model, out=found).where(F.col(found) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the largest id; ``n_chars`` follows the text.

    No row goes: a document that loses all its lines keeps an empty text.  Null texts stay
    null; rows with one id count as one document, and a null id is the smallest of all.
    """
    return with_lines_dropped(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, only the row with the smallest id stays, null being the largest.

    Of rows with that id, the one whose text has the smallest XXH64 stays; of rows equal in
    id and text, the one whose JSON has.  Texts without words are one component.
    """
    rows = _rows(docs)
    found = near_duplicates(rows.select("id", "sig", F.col("row.text").alias("text")), id_col="id", keep=("sig",), by_print=True)
    least = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("least"))
    first = least.select(F.col("least.doc_id").alias("first_id"), F.col("least.sig").alias("first_sig"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("sig") == F.col("first_sig")), "left_semi")
    if not found.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        kept = kept.groupBy("id", "sig").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return _back(kept, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; others of the same id, or without one, stay.

    Null and empty texts hold nothing and stay; of repeated rows all go or all stay.
    """
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True).select(F.col("doc_id").alias("leak"), F.col("sig").alias("leak_sig")).distinct()
    kept = _rows(docs).join(leaks, F.col("id").eqNullSafe(F.col("leak")) & (F.col("sig") == F.col("leak_sig")), "left_anti")
    return _back(kept, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hashes of each row's token ids and decoded bytes; a null text is an empty one, repeated rows have a row each."""
    path, pattern = default_ranks()
    return token_digest(docs, path=path, pattern=pattern)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: No SQL expresses the trained classifier or the SimHash components; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
