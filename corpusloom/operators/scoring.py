"""ROUGE and other scores of predictions against references."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.core import let
from corpusloom.operators.dataset import pad_negative
from corpusloom.operators.quality import lcs

_ASCII = re.compile(r"[^a-z0-9]+")
_ANY = re.compile(r"\w+")


def ascii_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; all else splits, accented letters too, as published ROUGE scores have it."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", -1), lambda t: t != "")


def unicode_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", -1), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    grams = lambda ts: F.transform(F.sequence(F.lit(1), F.size(ts) - (n - 1)), lambda i: F.array_join(F.slice(ts, i, n), " "))
    return let(tokens, lambda ts: F.when(F.size(ts) >= n, grams(ts)).otherwise(F.array().cast("array<string>")))


def f_measure(shared: Column, predicted: Column, reference: Column) -> Column:
    p, r = F.try_divide(shared, predicted), F.try_divide(shared, reference)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rouge_n(pairs: DataFrame, n: int, *, id_col: str = "id", tokens: Callable[[Column], Column] = ascii_tokens) -> DataFrame:
    """``(id, rouge<n>)``: F1 of clipped n-gram overlap of ``prediction`` and ``reference``; 0 where either has none."""
    made = pairs.select(F.col(id_col).alias("id"), tokens(F.col("prediction")).alias("p"), tokens(F.col("reference")).alias("r"))
    made = made.select("id", ngrams(F.col("p"), n).alias("p"), ngrams(F.col("r"), n).alias("r"))
    sizes = made.select("id", F.size("p").alias("np"), F.size("r").alias("nr"))
    count = lambda c, out: made.select("id", F.explode_outer(c).alias("g")).where(F.col("g").isNotNull()).groupBy("id", "g").agg(F.count(F.lit(1)).alias(out))
    shared = count("p", "cp").join(count("r", "cr"), ["id", "g"]).groupBy("id").agg(F.sum(F.least("cp", "cr")).alias("m"))
    return sizes.join(shared, "id", "left").select("id", f_measure(F.coalesce("m", F.lit(0)), F.col("np"), F.col("nr")).alias(f"rouge{n}"))


def rouge_l_of(prediction: str | None, reference: str | None, unicode: bool = False) -> float:
    cut = (lambda t: _ANY.findall((t or "").lower())) if unicode else (lambda t: [x for x in _ASCII.split((t or "").lower()) if x])
    p, r = cut(prediction), cut(reference)
    if not p or not r:
        return 0.0
    ids: dict[str, str] = {}
    coded = ["".join(ids.setdefault(t, chr(len(ids) + 0x10000 if len(ids) >= 0xD000 else len(ids))) for t in side) for side in (p, r)]
    m = lcs(*coded)
    return 2 * m / (len(p) + len(r))


def rouge_l(pairs: DataFrame, *, id_col: str = "id", unicode: bool = False) -> DataFrame:
    """``(id, rougeL)``: F1 of the longest common token subsequence."""

    @F.pandas_udf("double")
    def scored(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_of(a, b, unicode) for a, b in zip(p, r, strict=True)])

    return pairs.select(F.col(id_col).alias("id"), scored("prediction", "reference").alias("rougeL"))


def corpus_scores(pairs: DataFrame, *, id_col: str = "id", scorer: Callable[[list[str], list[str]], list[float]] | None = None, digits: int = 4) -> DataFrame:
    """Means of ROUGE-1, -2 and -L, the number of pairs and, with a scorer, its mean; zeros for no pairs."""
    each = rouge_n(pairs, 1, id_col=id_col).join(rouge_n(pairs, 2, id_col=id_col), "id").join(rouge_l(pairs, id_col=id_col), "id")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(c)
    wanted = [mean("rouge1"), mean("rouge2"), mean("rougeL"), F.count(F.lit(1)).alias("n")]
    if scorer is not None:

        @F.pandas_udf("double")
        def extra(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for p, r in batches:
                yield pd.Series(scorer(p.tolist(), r.tolist()), dtype=float)

        each = each.join(pairs.select(F.col(id_col).alias("id"), extra("prediction", "reference").alias("scorer_f1")), "id")
        wanted.append(mean("scorer_f1"))
    return each.agg(*wanted)


def token_scores(rows: DataFrame, make_decoder: Callable[[], Callable[[list[list[int]]], list[str]]], *, pad: int, id_col: str = "id", digits: int = 12) -> DataFrame:
    """``corpus_scores`` of token ids, ``predictions`` against ``labels``, as they are scored while a model trains.

    Negative ids, which fill up ragged rows and mark what a loss skips, become ``pad`` before they are
    decoded.  The decoder is made once per worker and takes a list of rows; null rows are empty.
    """

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = make_decoder()
        for ids in batches:
            yield pd.Series(decode([list(map(int, row)) for row in ids]), dtype=object)

    text = lambda c: decoded(F.coalesce(pad_negative(F.col(c), pad), F.array().cast("array<int>")))
    return corpus_scores(rows.select(F.col(id_col).alias("id"), text("predictions").alias("prediction"), text("labels").alias("reference")), digits=digits)


def paired(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Predictions and references by key; raises if either side lacks a key of the other."""
    both = predictions.select(key, "prediction").join(references.select(key, "reference"), key, "full_outer")
    return both.where(F.when(F.col("prediction").isNull() | F.col("reference").isNull(), F.raise_error(F.lit("predictions and references differ in their keys"))).otherwise(F.lit(True)).isNotNull())
