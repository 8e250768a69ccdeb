"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.storage import cut_lineage, shared_dir, table

__all__ = ["ASCII_SPACE", "LOWER", "UPPER", "cut_lineage", "look_up", "lower_ascii", "shared_dir", "table"]

#: The white space of the contracts, `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; the fast built-in serves texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def look_up(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, *, most_hot: int = 10_000, least: int = 500) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key; null where there is none.

    ``weight`` is the column of ``facts`` that says how many rows have the key; it is left
    out.  Keys of more than ``least`` rows and of more than a ``most_hot``-th of all rows,
    fewer than ``most_hot`` by that, are broadcast, and a salt spreads their rows, so none
    of them meets in one task.  Null keys find nothing.
    """
    values = [c for c in facts.columns if c not in (*keys, weight)]
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) > max(least, total / most_hot)
    hot = facts.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    # Always 0, but not a literal, which the optimizer would take out of the join's keys.
    cold = facts.where(~heavy).select(*keys, F.least(F.lit(0).cast("long"), F.abs(F.col(weight))).alias("_salt"), F.struct(*values).alias("_cold"))
    spread = 1 + F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(1 << 20))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(spread))
    found = F.coalesce("_hot", "_cold")
    return marked.join(cold, [*keys, "_salt"], "left").select(*rows.columns, *(found[v].alias(v) for v in values))
