"""Counters and reports over outcomes of crawling and labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can become of a candidate.
OUTCOMES = ("skipped_seen", "skipped_robots", "skipped_dupe", "fetch_failed", "extract_failed", "inserted")


def crawl_counters(outcomes: DataFrame, *, by: str = "source_id") -> DataFrame:
    """Per source, how many candidates were discovered and what became of them, in one aggregation."""
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def run_row(counters: DataFrame, errors: Column | None = None) -> DataFrame:
    """``counters`` with n_new, n_skipped, n_errors, status and notes; ``errors`` is an array of messages.

    Success needs an insertion and no message, partial an insertion; failed is a run with
    messages that discovered nothing; a quiet run is partial.
    """
    found = errors if errors is not None else F.array().cast("array<string>")
    said = F.when(F.size(found) > 0, F.concat(F.lit(" errors="), F.array_join(found, "; "))).otherwise(F.lit(""))
    status = (
        F.when((F.col("inserted") > 0) & (F.size(found) == 0), F.lit("success"))
        .when(F.col("inserted") > 0, F.lit("partial"))
        .when((F.size(found) > 0) & (F.col("discovered") == 0), F.lit("failed"))
        .otherwise(F.lit("partial"))
    )
    notes = F.concat(F.concat_ws(" ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("discovered", *OUTCOMES))), said)
    return counters.withColumns({
        "n_new": F.col("inserted"), "n_skipped": F.col("skipped_seen") + F.col("skipped_dupe") + F.col("skipped_robots"),
        "n_errors": F.col("fetch_failed") + F.col("extract_failed") + F.size(found), "status": status, "notes": notes,
    })


def health_alerts(runs: DataFrame, *, most: float = 0.3) -> DataFrame:
    """Runs whose share of errors among errors and insertions is above ``most``."""
    return runs.withColumn("error_rate", F.try_divide("n_errors", F.col("n_new") + F.col("n_errors"))).where(F.col("error_rate") > most)


def pass_rates(labels: DataFrame, *, by: str = "source_id", passed: str = "qc_passed") -> DataFrame:
    counts = labels.groupBy(by).agg(F.count_if(F.col(passed)).alias("n_passed"), F.count_if(~F.col(passed)).alias("n_failed"))
    return counts.withColumn("pass_rate", F.try_divide("n_passed", F.col("n_passed") + F.col("n_failed")))


def reason_histogram(checked: DataFrame, *, reasons: str = "qc.reasons") -> DataFrame:
    """How often each reason occurs, by what stands before its colon."""
    return checked.select(F.explode_outer(reasons).alias("r")).where(F.col("r").isNotNull()).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_conformity(rows: DataFrame, words: Column, low: int = 40, high: int = 80) -> DataFrame:
    """The share of rows whose number of words lies within the bounds."""
    return rows.agg(F.avg(words.between(low, high).cast("double")).alias("conformity"))
