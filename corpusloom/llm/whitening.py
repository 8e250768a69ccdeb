"""Whitening of embeddings from exact sums, by digit slices.

Entries become integers, ``floor(64 c) + 1000000``, and each distinct integer vector counts
once.  With ``n`` such vectors and their sums ``S``, the centred vector ``n x - S`` is an
integer too, so the covariance is a sum of products of integers: each task splits its
vectors into slices of 20 bits, multiplies the slices with float64 BLAS in blocks of rows so
short that no partial sum passes 2**53, and puts the products together as big integers.
Those are merged by Spark as base-2**32 digits, and only the matrix of the sums, whose size is the
dimension squared, reaches the driver, where it is divided once and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage

#: How entries become integers.
SCALE, SHIFT = 64, 1_000_000
SLICE_BITS, BLOCK_ROWS, DIGIT_BITS = 20, 4096, 32
COMPONENTS = 16
#: Entries from here on would not give a long.
TOO_LARGE = 2.0**56
DIGEST = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: ``n`` distinct vectors, ``low`` and ``rest`` so that ``n x - S = n (x - low) - rest``, and the components, one a column."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    bound: int
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.low, self.rest)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened values; NaN in components without variance."""
        z = self.centred(x).astype(np.float64) / self.n
        scale = np.array([v**-0.5 if v > 0 else np.nan for v in self.values])
        return (z @ self.components) * scale


def centred(x: np.ndarray, n: int, low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``n x - S``, exactly; as Python integers where ``low`` and ``rest`` are."""
    return (x.astype(low.dtype) - low) * n - rest


def slices(z: np.ndarray, bound: int) -> list[np.ndarray]:
    """Float64 arrays whose sum, each times ``2 ** (20 k)``, is ``z``: 20 bits each, the last with the sign; no entry of ``z`` passes ``bound``."""
    out = []
    while bound >> SLICE_BITS:
        out.append((z & ((1 << SLICE_BITS) - 1)).astype(np.float64))
        z, bound = z >> SLICE_BITS, bound >> SLICE_BITS
    return [*out, z.astype(np.float64)]


def gram(z: np.ndarray, bound: int) -> np.ndarray:
    """``z.T @ z`` as Python integers, from exact products of slices."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for lo in range(0, len(z), BLOCK_ROWS):
        parts = slices(z[lo : lo + BLOCK_ROWS], bound)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) << (SLICE_BITS * (i + j))
                total += product if i == j else product + product.T
    return total


def digits(value: int) -> Iterator[tuple[int, int]]:
    """``(place, digit)`` of a number in base 2**32, the last digit with the sign."""
    place = 0
    while not -(1 << DIGIT_BITS) < value < 1 << DIGIT_BITS:
        yield place, value & ((1 << DIGIT_BITS) - 1)
        value, place = value >> DIGIT_BITS, place + 1
    yield place, value


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The column ``x`` as rows of ``dim`` longs."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integers(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: usable rows; vectors that are null, or that hold null, non-finite or too large (2**56) entries, go."""
    vector = F.col(vector_col).cast("array<double>")
    fine = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    return table.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def usual_size(rows: DataFrame) -> int | None:
    """The dimension that most rows have, the larger one of two; None without rows."""
    found = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return found[0]["dim"] if found else None


def fit(rows: DataFrame, dim: int, *, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of ``rows(x)``, all of dimension ``dim``, of which there is one at least.

    What reaches the driver is a sum for each dimension and for each pair of dimensions.
    """
    distinct = cut_lineage(rows.select("x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, dim)
            if len(x):
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array(range(dim), pa.int32()), "n": pa.array([len(x)] * dim, pa.int64()), "high": (x >> 32).sum(axis=0), "low": (x & 0xFFFFFFFF).sum(axis=0),
                    "least": x.min(axis=0), "most": x.max(axis=0),
                })

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    per = distinct.mapInArrow(sums, "at int, n long, high long, low long, least long, most long")
    facts = per.groupBy("at").agg(F.sum("n").alias("n"), big("high"), big("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()
    n = facts[0]["n"]
    total = [(int(f["high"]) << 32) + int(f["low"]) for f in facts]
    bound = max(n * (f["most"] - f["least"]) for f in facts)
    # Longs serve while n (x - low) fits one.
    kind = np.int64 if bound < 1 << 62 else object
    low = np.array([f["least"] for f in facts], kind)
    rest = np.array([s - n * f["least"] for s, f in zip(total, facts, strict=True)], kind)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((dim, dim), object)
        for batch in batches:
            own = own + gram(centred(matrix(batch, dim), n, low, rest), bound)
        cells = [(i, j, place, digit) for i in range(dim) for j in range(i + 1) for place, digit in digits(int(own[i, j])) if digit]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "place", "digit"])

    merged = distinct.mapInArrow(products, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect()
    exact = np.zeros((dim, dim), object)
    for cell in merged:
        exact[cell["i"], cell["j"]] += cell["digit"] << (DIGIT_BITS * cell["place"])
    # Each entry is rounded once, from the quotient of two integers.
    cov = np.array([[exact[max(i, j), min(i, j)] / n**3 for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(components, dim)]
    trace = sum(exact[i, i] for i in range(dim)) / n**3
    chosen = np.where(values[order] > trace * 1e-13, values[order], 0.0)
    explained = chosen / trace if trace > 0 else np.full(len(order), np.nan)
    model = Whitening(n, low, rest, bound, vectors[:, order], chosen, explained, 0.0)
    return Whitening(**{**model.__dict__, "identity_error": identity_error(distinct, model, dim)})


def identity_error(distinct: DataFrame, model: Whitening, dim: int) -> float:
    """The largest absolute entry of the covariance of what ``model`` makes of the fit list, minus the identity; components without variance are left out."""
    live = np.flatnonzero(model.values > 0)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(live), len(live)))
        for batch in batches:
            white = model.whiten(matrix(batch, dim))[:, live]
            own += white.T @ white
        i, j = np.indices(own.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(own.ravel())], names=["i", "j", "part"])

    found = distinct.mapInArrow(squares, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("total")).collect()
    return max((abs(c["total"] / model.n - (c["i"] == c["j"])) for c in found), default=0.0)


def whitened(rows: DataFrame, model: Whitening, dim: int) -> DataFrame:
    """The columns of ``DIGEST`` for each row of ``rows(vec_id, x)`` and each component."""
    fast = dim * model.bound**2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = matrix(batch, dim)
            z = model.centred(x)
            far = (z**2).sum(axis=1) if fast else [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in z]
            white = model.whiten(x)
            nulls = lambda a: pa.array(a, from_pandas=True)  # noqa: E731  NaN as null
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(x) * k, model.n, np.int64)), "deviation": pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": nulls(white.ravel()), "explained": nulls(np.tile(model.explained, len(x))), "identity_error": pa.array(np.full(len(x) * k, model.identity_error)),
            })

    return rows.mapInArrow(run, DIGEST)


def whiten_digest(table: DataFrame) -> DataFrame:
    """The contract's columns, for each usable row and up to 16 components.

    Vectors of another dimension than most have, empty ones among them, take no part; null
    and repeated ids have their rows like any others.  A component without variance (all
    vectors equal along it) has null for its whitened value, and where nothing varies
    ``explained`` is null too.  A deviation that does not fit a long is null.  An empty
    table gives no rows; columns other than ``vec_id`` and ``embedding`` are not read.
    """
    rows = integers(table.select("vec_id", "embedding"))
    dim = usual_size(rows)
    if dim is None:
        return table.sparkSession.createDataFrame([], DIGEST)
    rows = rows.where(F.size("x") == dim)
    return whitened(rows, fit(rows, dim), dim)
