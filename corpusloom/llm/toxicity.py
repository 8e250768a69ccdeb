"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is a bag of features: itself and its character n-grams between boundary marks,
hashed into ``buckets`` rows of an embedding.  A word's vector is the mean of its rows, a
passage's the mean of its words', where a word that is repeated counts once, and a linear
softmax reads the passage.  Embedding and
softmax are trained jointly in numpy by Adagrad, on the driver, over a bounded sample of
labelled documents.  A misspelling that was never seen still shares most n-grams, and so
most of its vector, with the word it stands for.

Only buckets whose log odds between toxic and other documents differ from none by
``least_evidence`` standard errors are trained, the others stay 0: with few labels there are
more n-grams than documents, and those would be learnt by heart.

A text is read in passages of ``passage`` words and has the logit of its most toxic
passage, in training too (only that passage is learnt from), so a few insults are not
averaged away by a long text.  In the first third of the epochs (``early``) the passage is
the one whose buckets give most evidence.  For scoring, the trained layers are folded into one number
per bucket, 4 bytes each, which is all that travels to the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the documents that are drawn for training; one of over ``longest_sampled`` characters is left out of it, never cut."""

    sample: int = 8000
    longest_sampled: int = 12_000
    buckets: int = 1 << 18
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    passage: int = 32
    epochs: int = 6
    most_epochs: int = 60
    steps: int = 1200
    batch: int = 32
    rate: float = 0.5
    least_evidence: float = 3.0
    early: float = 0.34
    seed: int = 7


MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, bucket)``: for each word its own bucket and those of its n-grams between boundary marks.

    All words are hashed at once, by polynomials over their code points; ``owner`` is the
    word's place and is not sorted.
    """
    text = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    place = (np.arange(len(points)) - starts[owner]).astype(np.uint64)
    spread = (points + np.uint64(1)) * MIX
    spread ^= spread >> np.uint64(29)
    whole = np.add.reduceat(spread * (np.uint64(2) * place * place + np.uint64(2) * place + np.uint64(1)), starts)
    owners, hashes = [np.arange(len(words))], [whole]
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, s.longest + 1):
        if n > len(points):
            break
        rolling = rolling[: len(points) - n + 1] * MIX + spread[n - 1 :]
        if n >= s.shortest:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            owners.append(owner[: len(rolling)][inside])
            hashes.append(rolling[inside] + np.uint64(n))
    mixed = np.concatenate(hashes) * MIX
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate(owners), ((mixed * MIX) >> np.uint64(40)).astype(np.int64) % s.buckets


def word_values(words: list[str], weights: np.ndarray, s: Settings) -> np.ndarray:
    """Each word's mean over its buckets."""
    owner, bucket = features(words, s)
    return np.bincount(owner, weights[bucket], len(words)) / np.bincount(owner, minlength=len(words))


class Model:
    """One number per bucket and a bias: a word's value is the mean over its buckets, a passage's logit the mean over its words and the bias."""

    def __init__(self, weights: np.ndarray, bias: float, settings: Settings, limit: int = 300_000):
        self.weights, self.bias, self.settings, self.limit = weights, bias, settings, limit
        self.place: dict[str, int] = {}
        self.value = np.zeros(limit)

    def _places(self, words: list[str]) -> np.ndarray:
        """A number for each word; ``value`` has the words' values at these."""
        if new := list(set(words).difference(self.place)):
            if len(self.place) + len(new) > len(self.value):
                self.place.clear()
                new = list(set(words))
                if len(new) > len(self.value):
                    self.value = np.zeros(len(new))
            start = len(self.place)
            self.place.update(zip(new, range(start, start + len(new)), strict=True))
            self.value[start : start + len(new)] = word_values(new, self.weights, self.settings)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def logit(self, text: str | None) -> float:
        """The logit of the most toxic passage."""
        words = words_of(text)
        if not words:
            return self.bias
        return float(passage_means(self.value, self._places(words), self.settings.passage).max() + self.bias)

    def scores(self, texts) -> np.ndarray:
        logits = np.array([self.logit(t) for t in texts], np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -60, 60)))


def passage_edges(n: int, size: int) -> np.ndarray:
    """Edges of near-equal passages of at most ``size`` words."""
    parts = -(-n // size)
    return np.arange(parts + 1) * n // parts


def passage_means(value: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """For each passage, the sum of its distinct words' values over its number of words: a word that is repeated adds nothing."""
    edges = passage_edges(len(words), size)
    passage = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    once = np.unique((passage << 32) | words)
    return np.bincount(once >> 32, value[once & 0xFFFFFFFF], len(edges) - 1) / np.diff(edges)


def train(texts: list[str], labels: list[int], s: Settings) -> Model:
    """Fit embedding and softmax jointly; with one class only, the model gives that class's prior everywhere."""
    rng = np.random.default_rng(s.seed)
    share = (sum(labels) + 1) / (len(labels) + 2)
    if not labels or min(labels) == max(labels):
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))), s)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    y, docs = np.array([label for label, d in zip(labels, docs, strict=True) if len(d)]), [d for d in docs if len(d)]
    if not docs:
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))), s)
    bucket, sizes = _grouped_features(list(ids), s)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    evidence = _evidence(docs, y, bucket, starts, s.buckets)
    # What tells the classes apart no better than chance would only serve to learn documents by heart.
    known = np.abs(evidence) >= s.least_evidence
    owner = np.repeat(np.arange(len(sizes)), sizes)[known[bucket]]
    bucket = bucket[known[bucket]]
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sizes)))))
    word_mean = lambda of_bucket: np.bincount(owner, of_bucket[bucket], len(sizes)) / sizes
    # Words without a known bucket add nothing to a passage but its length.
    passages = Passages(docs, s.passage, np.diff(starts) > 0)
    telling = word_mean(evidence)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32) * known[:, None]
    soft, bias = np.array([[-0.1, 0.1]] * s.dim, np.float32), np.zeros(2, np.float32)
    seen, soft_seen, bias_seen = np.full(s.buckets, 1e-3, np.float32), np.full_like(soft, 1e-3), np.full_like(bias, 1e-3)
    epochs = min(s.most_epochs, max(s.epochs, -(-s.steps * s.batch // len(docs))))
    for epoch in range(epochs):
        # At first the passages with the buckets that tell most, else chance decides which ones are ever looked at.
        worst = passages.worst(telling if epoch < s.early * epochs else word_mean(table @ (soft[:, 1] - soft[:, 0])))
        shuffled = rng.permutation(len(docs))
        for at in range(0, len(docs), s.batch):
            chosen = shuffled[at : at + s.batch]
            held, lengths = passages.words_of(worst[chosen])
            whole = passages.length[worst[chosen]]
            words, flat = np.unique(held, return_inverse=True)
            per_word = np.diff(starts)[words]
            rows = np.concatenate([bucket[starts[w] : starts[w + 1]] for w in words] or [bucket[:0]])
            of_word = np.repeat(np.arange(len(words)), per_word)
            of_doc = np.repeat(np.arange(len(chosen)), lengths)
            vectors = _sums(table[rows] / sizes[words][of_word][:, None], of_word, len(words))
            hidden = _sums(vectors[flat], of_doc, len(chosen)) / whole[:, None]
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), y[chosen]] -= 1
            g_words = _sums((error @ soft.T / whole[:, None])[of_doc], flat, len(words))
            touched, slot = np.unique(rows, return_inverse=True)
            g_rows = _sums((g_words / sizes[words][:, None])[of_word], slot, len(touched))
            seen[touched] += (g_rows**2).mean(axis=1)
            table[touched] -= s.rate * g_rows / np.sqrt(seen[touched])[:, None]
            for layer, so_far, gradient in ((soft, soft_seen, hidden.T @ error / len(chosen)), (bias, bias_seen, error.mean(axis=0))):
                so_far += gradient**2
                layer -= (0.1 * gradient / np.sqrt(so_far)).astype(np.float32)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), s)


def _grouped_features(words: list[str], s: Settings, chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word after word, and how many each has; made in chunks, since hashing takes several times their space."""
    buckets, sizes = [], []
    for lo in range(0, len(words), chunk):
        part = words[lo : lo + chunk]
        owner, bucket = features(part, s)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(sizes)


def _evidence(docs: list[np.ndarray], y: np.ndarray, bucket: np.ndarray, starts: np.ndarray, buckets: int) -> np.ndarray:
    """For each bucket, how far the log odds of toxic documents to have it are from those of others, in standard errors."""
    held = np.full((2, buckets), 0.5)
    for label, d in zip(y, docs, strict=True):
        held[label][np.unique(np.concatenate([bucket[starts[w] : starts[w + 1]] for w in np.unique(d)]))] += 1
    odds = np.log(held / (np.array([(y == 0).sum(), (y == 1).sum()]) + 1.0)[:, None])
    return (odds[1] - odds[0]) / np.sqrt((1 / held).sum(axis=0))


def _sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The sum of the rows of each group."""
    return np.stack([np.bincount(group, rows[:, k], groups) for k in range(rows.shape[1])], axis=1)


class Passages:
    """The passages of all documents, numbered on, with the distinct words of each that ``counts`` marks."""

    def __init__(self, docs: list[np.ndarray], size: int, counts: np.ndarray):
        edges = [passage_edges(len(d), size) for d in docs]
        self.length = np.concatenate([np.diff(e) for e in edges])
        self.first = np.concatenate(([0], np.cumsum([len(e) - 1 for e in edges])))
        words = np.concatenate(docs)
        passage = np.repeat(np.arange(len(self.length)), self.length)[counts[words]]
        once = np.unique((passage << 32) | words[counts[words]])
        self.passage, self.word = once >> 32, once & 0xFFFFFFFF
        self.start = np.searchsorted(self.passage, np.arange(len(self.length) + 1))

    def worst(self, value: np.ndarray) -> np.ndarray:
        """The number of each document's passage with the highest value, the first of several."""
        means = np.bincount(self.passage, value[self.word], len(self.length)) / self.length
        return np.array([lo + means[lo:hi].argmax() for lo, hi in zip(self.first[:-1], self.first[1:], strict=True)])

    def words_of(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some passages, one passage after the other, and how many each has."""
        return np.concatenate([self.word[self.start[p] : self.start[p + 1]] for p in passages]), self.start[passages + 1] - self.start[passages]


def held_out(doc_id) -> object:
    """Column: crc32 of the id as text is a multiple of 5; ids that are null are held out, as they have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on at most ``settings.sample`` labelled documents that are not held out, a third of them toxic if there are as many.

    Ids are drawn by a hash, so a repeated run draws the same.  Labels other than 0 and 1
    and ids with both are not learnt from.  Each different text of an id has its label;
    rows equal in id and text count once, null texts not at all.
    """
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(F.col("toxic") == F.col("most"))
    drawn = []
    for y, wanted in ((1, settings.sample // 3), (0, settings.sample - settings.sample // 3)):
        ranked = clean.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted)
        drawn += [(r["doc_id"], y) for r in ranked.select("doc_id").collect()]
    label_of = dict(drawn)
    if not label_of:
        return train([], [], settings)
    picked = docs.where(F.col("doc_id").isin(list(label_of)) & (F.char_length("text") <= settings.longest_sampled)).select("doc_id", "text")
    rows = sorted({(r["doc_id"], r["text"]) for r in picked.collect()})
    return train([t for _, t in rows], [label_of[i] for i, _ in rows], settings)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``out``, 0 to 1, which takes the place of one of that name; null and word-less texts get the bias alone.

    Whole texts are read, however long.
    """
    weights, bias, settings = model.weights, model.bias, model.settings

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias, settings)
        for batch in texts:
            yield pd.Series(own.scores(batch))

    return docs.withColumn(out, toxicity(F.col(text_col).cast("string")))


def toxicity_digest(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's columns: ``doc_id, held_out, score, predicted``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
