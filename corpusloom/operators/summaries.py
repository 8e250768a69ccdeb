"""Extractive summaries: sentence graphs, ranking, selection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")
_TOKEN = re.compile(r"[\wÀ-ỹ]+")


@dataclass(frozen=True)
class Options:
    """``sentences`` and ``words`` take the place of the patterns, as a segmenter for a language would."""

    graph: str = "lexrank"
    threshold: float = 0.1
    damping: float = 0.85
    max_sentences: int = 4
    max_words: int = 70
    sentences: Callable[[str], list[str]] | None = None
    words: Callable[[str], list[str]] | None = None


def _products(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int = 1024) -> np.ndarray:
    """The products of all pairs of ``n`` sparse rows, made from ``width`` columns at a time."""
    out, width = np.zeros((n, n)), max(1, min(width, int(columns.max(initial=0)) + 1))
    order = np.argsort(columns, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    edges = np.searchsorted(columns, np.arange(0, (columns[-1] if len(columns) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = np.zeros((n, width))
        block[rows[lo:hi], columns[lo:hi] - k * width] = values[lo:hi]
        out += block @ block.T
    return out


def _sparse(sentences: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, column, value) of each word of each sentence, and the number of columns."""
    ids: dict[str, int] = {}
    columns = [ids.setdefault(t, len(ids)) for s in sentences for t in s]
    rows = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    return rows, np.array(columns, np.int64), np.array([k for s in sentences for k in s.values()], np.float64), len(ids)


def overlap_graph(tokens: list[list[str]]) -> np.ndarray:
    """Shared distinct words over the sum of the logs of one plus the sentence lengths; nothing on the diagonal."""
    n = len(tokens)
    rows, columns, values, _ = _sparse([dict.fromkeys(s, 1) for s in tokens])
    weight = np.log1p([len(s) for s in tokens])
    total = weight[:, None] + weight[None, :]
    graph = np.divide(_products(rows, columns, values, n), total, out=np.zeros((n, n)), where=total > 0)
    np.fill_diagonal(graph, 0.0)
    return graph


def cosine_graph(tokens: list[list[str]], threshold: float) -> np.ndarray:
    """Cosine of smoothed TF-IDF rows, below the threshold 0; without any word, the identity."""
    n = len(tokens)
    rows, columns, tf, width = _sparse([Counter(t.lower() for t in s) for s in tokens])
    if not width:
        return np.eye(n)
    values = tf * (np.log((1 + n) / (1 + np.bincount(columns, minlength=width))) + 1)[columns]
    norm = np.sqrt(np.bincount(rows, values**2, n))
    graph = _products(rows, columns, values / norm[rows], n)
    if threshold > 0:
        graph[graph < threshold] = 0.0
    np.fill_diagonal(graph, 0.0)
    return graph


#: Sentences up to which a text's graph is a matrix.
DENSE = 1024
Spread = Callable[[np.ndarray], np.ndarray]


def overlap_spread(tokens: list[list[str]]) -> Spread:
    """What each sentence gets if each passes its score on along ``overlap_graph``, without that graph.

    A weight depends on the words shared and on the two lengths only, so the scores are
    summed by word for the sentences of each length, and each sentence picks up what its words hold.
    """
    n = len(tokens)
    rows, columns, _, width = _sparse([dict.fromkeys(s, 1) for s in tokens])
    size = np.log1p([len(s) for s in tokens])
    lengths, of = np.unique(size, return_inverse=True)
    parts = [np.flatnonzero(of[rows] == k) for k in range(len(lengths))]
    own = np.divide(np.bincount(rows, minlength=n), 2 * size, out=np.zeros(n), where=size > 0)

    def spread(scores: np.ndarray) -> np.ndarray:
        out = -own * scores
        for length, part in zip(lengths, parts, strict=True):
            if len(part):
                held = np.bincount(columns[part], scores[rows[part]], width)
                out += np.bincount(rows, held[columns], n) / np.where(size + length > 0, size + length, 1.0)
        return out

    return spread


def cosine_links(tokens: list[list[str]], threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, weight)``, i < j, of ``cosine_graph``, from ``block`` sentences against ``block`` at a time."""
    n = len(tokens)
    rows, columns, tf, width = _sparse([Counter(t.lower() for t in s) for s in tokens])
    if not width:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
    values = tf * (np.log((1 + n) / (1 + np.bincount(columns, minlength=width))) + 1)[columns]
    values /= np.sqrt(np.bincount(rows, values**2, n))[rows]
    edges = np.searchsorted(rows, np.arange(0, n + block, block))
    found = []
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        used = np.unique(columns[lo:hi])
        mine = np.zeros((block, len(used)))
        mine[rows[lo:hi] - k * block, np.searchsorted(used, columns[lo:hi])] = values[lo:hi]
        for m in range(k, len(edges) - 1):
            a, b = edges[m], edges[m + 1]
            at = np.minimum(np.searchsorted(used, columns[a:b]), len(used) - 1) if len(used) else np.zeros(b - a, int)
            known = used[at] == columns[a:b] if len(used) else np.zeros(b - a, bool)
            other = np.zeros((block, len(used)))
            other[rows[a:b][known] - m * block, at[known]] = values[a:b][known]
            i, j = np.nonzero(products := mine @ other.T)
            weight = products[i, j]
            good = (weight >= threshold if threshold > 0 else weight != 0) & (i + k * block < j + m * block)
            found.append(((i[good] + k * block).astype(np.int32), (j[good] + m * block).astype(np.int32), weight[good]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def cosine_spread(tokens: list[list[str]], threshold: float) -> Spread:
    """What ``cosine_graph`` passes on, along its links only."""
    n = len(tokens)
    i, j, weight = cosine_links(tokens, threshold)
    return lambda scores: np.bincount(i, weight * scores[j], n) + np.bincount(j, weight * scores[i], n)


def rank(n: int, spread: Spread, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """PageRank of a symmetric graph that is known by what it passes on; a sentence without weight passes on nothing."""
    scores, degree = np.full(n, 1 / max(1, n)), spread(np.ones(n))
    share = np.divide(damping, degree, out=np.zeros(n), where=degree > 0)
    moved = np.inf
    while n and rounds and moved >= tolerance:
        new = spread(share * scores) + (1 - damping) / n
        moved, scores, rounds = np.abs(new - scores).sum(), new, rounds - 1
    return scores


def spread_of(tokens: list[list[str]], o: Options, dense: int = DENSE) -> Spread:
    """By a matrix for texts of up to ``dense`` sentences, and without one for longer ones."""
    if len(tokens) <= dense:
        graph = cosine_graph(tokens, o.threshold) if o.graph == "lexrank" else overlap_graph(tokens)
        return lambda scores: graph @ scores
    return cosine_spread(tokens, o.threshold) if o.graph == "lexrank" else overlap_spread(tokens)


def summarize(text: str | None, o: Options = Options()) -> str:
    """The best-ranked sentences in their order, cut to the word limit; ties, to nine digits, go to the earlier sentence."""
    split, cut = o.sentences or _SENTENCE_END.split, o.words or _TOKEN.findall
    parts = [s.strip() for s in split((text or "").strip()) if s.strip()]
    if len(parts) > 1:
        tokens = [[t.lower() for t in cut(s)] for s in parts]
        scores = np.round(rank(len(tokens), spread_of(tokens, o), o.damping), 9)
        parts = [parts[i] for i in sorted(np.argsort(-scores, kind="stable")[: o.max_sentences])]
    joined = " ".join(parts)
    words = joined.split()
    return joined if len(words) <= o.max_words else " ".join(words[: o.max_words])


def with_summary(docs: DataFrame, *, text_col: str = "text", options: Options = Options(), out: str = "summary") -> DataFrame:
    """``docs`` with an extractive summary; '' for null and empty texts."""

    @F.pandas_udf("string")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: summarize(t, options))

    return docs.withColumn(out, made(F.col(text_col)))


def sentence_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, sentence, tokens)`` of each sentence, tokens lower-cased."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode_outer(T.sentences(F.col(text_col))).alias("pos", "sentence"))
    return split.where(F.col("sentence").isNotNull()).withColumn("tokens", T.lower_tokens(F.col("sentence")))


def overlap_edges(sentences: DataFrame) -> DataFrame:
    """``(id, i, j, weight)``, i < j, of the overlap graph: sentences meet on the words that they share, not all with all."""
    word = sentences.select("id", "pos", F.size("tokens").alias("n"), F.explode_outer(F.array_distinct("tokens")).alias("t")).where(F.col("t").isNotNull())
    a, b = word.select("id", "t", F.col("pos").alias("i"), F.col("n").alias("ni")), word.select("id", "t", F.col("pos").alias("j"), F.col("n").alias("nj"))
    shared = a.join(b, ["id", "t"]).where(F.col("i") < F.col("j")).groupBy("id", "i", "j", "ni", "nj").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("id", "i", "j", (F.col("shared") / (F.log1p("ni") + F.log1p("nj"))).alias("weight"))


def cosine_edges(sentences: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``(id, i, j, weight)``, i < j, of the TF-IDF graph at the threshold or more."""
    size = sentences.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    tf = sentences.select("id", "pos", F.explode_outer("tokens").alias("t")).where(F.col("t").isNotNull()).groupBy("id", "pos", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("id", "t").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, ["id", "t"]).join(size, "id").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy("id", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norm, ["id", "pos"]).select("id", "pos", "t", (F.col("w") / F.col("norm")).alias("w"))
    a, b = unit.select("id", "t", F.col("pos").alias("i"), F.col("w").alias("wi")), unit.select("id", "t", F.col("pos").alias("j"), F.col("w").alias("wj"))
    dot = a.join(b, ["id", "t"]).where(F.col("i") < F.col("j")).groupBy("id", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("weight"))
    return dot.where(F.col("weight") >= threshold)


def generated(docs: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]], *, text_col: str = "text", out: str = "summary", batch: int = 8) -> DataFrame:
    """Summaries by an injected model in chunks of ``batch``; blank texts give '' and never reach it."""

    @F.pandas_udf("string")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for series in texts:
            values, full = [""] * len(series), [i for i, t in enumerate(series) if t and t.strip()]
            for lo in range(0, len(full), batch):
                model = model or make_model()
                chunk = full[lo : lo + batch]
                for i, summary in zip(chunk, model([series.iloc[i] for i in chunk]), strict=True):
                    values[i] = summary
            yield pd.Series(values, dtype=object)

    return docs.withColumn(out, made(F.col(text_col)))
