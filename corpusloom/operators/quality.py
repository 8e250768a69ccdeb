"""Checks of a summary against its source."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 40
    max_words: int = 90
    min_sentences: int = 2
    max_sentences: int = 4
    fuzzy_ratio: float = 0.85


def number_supported(source: Column, collapsed: Column, token: Column) -> Column:
    """The token is in the source, or is once punctuation is one space, or all its groups of 3 or more digits are."""
    groups, bare = T.digit_groups(token), T.collapse_punctuation(token)
    return F.contains(source, token) | ((bare != "") & F.contains(collapsed, bare)) | ((F.size(groups) > 0) & F.forall(groups, lambda g: F.contains(source, g)))


def entity_supported(source: Column, collapsed: Column, name: Column) -> Column:
    """As for numbers, or some word of four or more characters is in the source; the fuzzy clause is ``partial_ratio``."""
    bare = T.collapse_punctuation(name)
    return F.contains(source, name) | ((bare != "") & F.contains(collapsed, bare)) | F.exists(T.words(name), lambda w: (F.length(w) >= 4) & F.contains(source, w))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def partial_ratio(short: str, long: str) -> float:
    """The best 0-100 similarity of the shorter text with a window of its length in the longer, shorter windows at the edges included."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return 100.0 if not long else 0.0
    n, m, best = len(short), len(long), 0.0
    letters = set(short)
    for start in range(1 - n, m):
        window = long[max(0, start) : start + n]
        # A window can only be best where its outer character occurs in the short text.
        if (window[-1] if start < m - n else window[0]) in letters:
            best = max(best, 200.0 * lcs(short, window) / (n + len(window)))
            if best == 100.0:
                break
    return best


def window_starts(short: str, long: str, ratio: float) -> list[int]:
    """Where windows of ``long`` begin that can reach ``ratio`` with ``short``, the shorter text; the others cannot.

    A window that reaches it leaves at most ``errors`` letters of both unmatched.  Each
    breaks one of ``errors + 1`` pieces of the shorter text at most, so one piece stands whole in
    the window, no further than that from its own place; at the longer text's edges, where
    windows are shorter, no further than twice that.
    """
    n, m = len(short), len(long)
    errors = int(2 * n * (1 - ratio) + 1e-9)
    if errors + 1 > n:
        return list(range(1 - n, m))
    starts: set[int] = set()
    for k in range(errors + 1):
        at, end = k * n // (errors + 1), (k + 1) * n // (errors + 1)
        piece, x = short[at:end], long.find(short[at:end])
        while x >= 0:
            starts.update(range(max(1 - n, x - at - 2 * errors), min(m, x - at + errors + 1)))
            x = long.find(piece, x + 1)
    return sorted(starts)


def reaches(short: str, long: str, ratio: float) -> bool:
    """Whether ``partial_ratio`` is ``100 * ratio`` or more, from windows that hold a piece of the shorter text only."""
    if len(short) > len(long):
        short, long = long, short
    if not short:
        return not long or ratio <= 0
    n = len(short)
    return any(200.0 * lcs(short, w) / (n + len(w)) >= 100 * ratio for s in window_starts(short, long, ratio) if (w := long[max(0, s) : s + n]))


def _fuzzy(ratio: float):
    @F.pandas_udf("array<string>")
    def missing(sources: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[n for n in ns if not reaches(n, s, ratio)] for s, ns in zip(sources, names, strict=True)])

    return missing


def fuzzy_reached(name: Column, source: Column, ratio: float = 0.85) -> Column:
    """Whether some window of ``source`` is as like ``name`` as ``ratio`` asks; null texts count as empty."""

    @F.pandas_udf("boolean")
    def reached(names: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([reaches(n, s, ratio) for n, s in zip(names, sources, strict=True)], dtype=bool)

    return reached(F.coalesce(name, F.lit("")), F.coalesce(source, F.lit("")))


def quality(rows: DataFrame, *, summary: str = "summary", source: str = "source_text", refusal: str | None = "refusal_reason", limits: Thresholds = Thresholds(), fuzzy: bool = True) -> DataFrame:
    """``rows`` with ``qc``: passed, reasons, word and sentence counts, missing numbers and entities.

    Null texts count as empty.  The fuzzy clause runs in Arrow only for rows that still
    miss an entity after the native clauses.
    """
    spread = rows.withColumn("_s", T.stripped(T.nfc(F.coalesce(F.col(summary), F.lit(""))))).withColumn("_t", T.stripped(T.nfc(F.coalesce(F.col(source), F.lit("")))))
    spread = spread.withColumn("_c", T.collapse_punctuation(F.col("_t")))
    spread = spread.withColumn("_n", F.filter(T.numeric_tokens(F.col("_s")), lambda n: ~number_supported(F.col("_t"), F.col("_c"), n)))
    spread = spread.withColumn("_e", F.filter(T.entities(F.col("_s")), lambda e: ~entity_supported(F.col("_t"), F.col("_c"), e)))
    if fuzzy:
        open_rows = F.size("_e") > 0
        spread = spread.withColumn("_e", F.when(open_rows, _fuzzy(limits.fuzzy_ratio)(F.when(open_rows, F.col("_t")).otherwise(F.lit("")), F.col("_e"))).otherwise(F.col("_e")))
    spread = spread.withColumn("_w", T.word_count(F.col("_s"))).withColumn("_k", F.size(T.sentences(F.col("_s"))))
    refused = F.lit(None).cast("string") if refusal is None else F.nullif(F.col(refusal), F.lit(""))
    first5 = lambda c: F.array_join(F.slice(c, 1, 5), ",")
    reasons = F.filter(F.array(
        F.concat(F.lit("llm_refusal:"), refused),
        F.when(F.col("_w") < limits.min_words, F.format_string(f"too_short:%d<{limits.min_words}", "_w")),
        F.when(F.col("_w") > limits.max_words, F.format_string(f"too_long:%d>{limits.max_words}", "_w")),
        F.when(F.col("_k") < limits.min_sentences, F.format_string(f"too_few_sentences:%d<{limits.min_sentences}", "_k")),
        F.when(F.col("_k") > limits.max_sentences, F.format_string(f"too_many_sentences:%d>{limits.max_sentences}", "_k")),
        F.when(F.size("_n") > 0, F.concat(F.lit("unsupported_numbers:"), first5(F.col("_n")))),
        F.when(F.size("_e") > 0, F.concat(F.lit("unsupported_entities:"), first5(F.col("_e")))),
    ), lambda r: r.isNotNull())
    judged = spread.withColumn("_r", reasons)
    qc = F.struct((F.size("_r") == 0).alias("passed"), F.col("_r").alias("reasons"), F.col("_w").alias("word_count"), F.col("_k").alias("sentence_count"), F.col("_n").alias("missing_numbers"), F.col("_e").alias("missing_entities"))
    return judged.withColumn("qc", qc).drop("_s", "_t", "_c", "_n", "_e", "_w", "_k", "_r")
