"""Nearest neighbours by inverted lists with an adaptive dimension scan.

Vectors are rotated by a fixed random orthogonal matrix and dealt to the list of their
nearest centroid (centroids are fitted on a bounded sample; every vector is indexed).  A
query probes its nearest lists, as many as vectors of the sample need to find the wanted
share of their true neighbours in it: few where vectors cluster, a third or more where they
hardly do.  Inside the probed lists, vectors lie in blocks of columns: after each block the
partial squared distance of every remaining candidate, scaled up to all dimensions, is
tested against the tenth best so far; a candidate that exceeds it by more than a random
rotation would explain is abandoned.  Survivors are measured exactly, in double precision,
on the original vectors.

Lists are packed into cells of ``rows_a_cell`` rows, long ones are dealt into several, and
queries into parts of ``queries_a_part``, so a task has a bounded number of both.  Equal
vectors are one entry with its smallest ids, so a vector that a third of all rows share
costs one comparison, and its answer reaches its rows without meeting them in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage, look_up


def usable(vector, dim: int | None = None):
    """Not null, finite throughout, not zero, and of the table's dimension where given."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return fine if dim is None else fine & (F.size(vector) == dim)


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centers, 1)[:, 0]
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each point, nearest first."""
    out = np.empty((len(points), n), np.int64)
    norm = (centers**2).sum(axis=1)
    for lo in range(0, len(points), 4096):
        far = norm - 2 * points[lo : lo + 4096] @ centers.T
        part = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(n), (len(far), 1))
        out[lo : lo + 4096] = np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, axis=1), axis=1, kind="stable"), axis=1)
    return out


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def survivors(queries: np.ndarray, vectors: np.ndarray, turn: np.ndarray, visit: np.ndarray, k: int, doubt: float | None, column_block: int = 16, pairs: int = 1 << 18):
    """Pairs (query, vector, exact distance), as three arrays, that may be among the ``k`` nearest of each query's visited vectors.

    ``visit`` is a mask of queries by vectors.  The best by partial distance over the first
    columns are measured in full and set each query's bar; the other candidates must pass the
    test after every block of columns.  ``doubt`` None abandons only what is surely farther.
    """
    dim = vectors.shape[1]
    out = []
    turned, turned_queries = vectors @ turn, queries @ turn
    step = max(1, pairs // max(1, len(vectors)))
    for lo in range(0, len(queries), step):
        q, tq, alive = queries[lo : lo + step], turned_queries[lo : lo + step], visit[lo : lo + step]
        slack = 1e-9 * ((q**2).sum(axis=1) + (vectors**2).sum(axis=1).max())
        bar, partial, seen = np.full(len(q), np.inf), None, 0
        at, of = np.nonzero(alive)
        for start in range(0, dim, column_block):
            x, y = tq[:, start : start + column_block], turned[:, start : start + column_block]
            seen += x.shape[1]
            if start == 0:
                whole = np.where(alive, (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, np.inf)
                partial = whole[at, of]
                if len(vectors) > 2 * k:
                    first = np.argpartition(whole, 2 * k - 1, axis=1)[:, : 2 * k]
                    exact = ((vectors[first] - q[:, None, :]) ** 2).sum(axis=2)
                    exact[np.isinf(np.take_along_axis(whole, first, axis=1))] = np.inf
                    bar = np.partition(exact, k - 1, axis=1)[:, k - 1]
            else:
                partial = partial + ((y[of] - x[at]) ** 2).sum(axis=1)
            if seen < dim and doubt is not None:
                fine = partial * dim / seen <= bar[at] * (1 + doubt / np.sqrt(seen)) ** 2 + slack[at]
            else:
                fine = partial <= bar[at] + slack[at]
            at, of, partial = at[fine], of[fine], partial[fine]
        out.append((at + lo, of, np.sqrt(((vectors[of] - q[at]) ** 2).sum(axis=1))))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """How many lists vectors of the sample must visit to find the share ``recall`` of their ``k`` nearest others in it."""
    queries = sample[:: max(1, len(sample) // asked)][:asked]
    far = (sample**2).sum(axis=1) - 2 * queries @ sample.T
    near = np.argsort(far, axis=1)[:, 1 : k + 1]
    order = nearest(queries, centers, len(centers))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centers))[None, :], axis=1)
    needed = np.take_along_axis(rank, nearest(sample, centers, 1)[:, 0][near], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else len(centers)


def cells_of(sizes: np.ndarray, centers: np.ndarray, rows_a_cell: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first cell, number of cells)`` of each list; lists that are neighbours along the centroids' main axis share a cell."""
    axis = np.linalg.svd(centers - centers.mean(axis=0), full_matrices=False)[2][0]
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows_a_cell))
    cell, held = 0, 0
    for j in np.argsort(centers @ axis, kind="stable"):
        if held and held + sizes[j] > rows_a_cell:
            cell, held = cell + 1, 0
        first[j] = cell
        held += sizes[j]
        if parts[j] > 1:
            cell, held = cell + int(parts[j]), 0
    return first, parts


def visits_of(near: np.ndarray, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(query, cell, lists)`` from each query's probed lists: one entry per query and cell with the lists it visits there."""
    lists, query = near.ravel(), np.repeat(np.arange(len(near)), near.shape[1])
    times = parts[lists]
    before = np.cumsum(times) - times
    lists, query, ordinal = np.repeat(lists, times), np.repeat(query, times), np.arange(times.sum()) - np.repeat(before, times)
    cell = first[lists] + ordinal
    order = np.lexsort((cell, query))
    lists, query, cell = lists[order], query[order], cell[order]
    edges = np.flatnonzero((np.diff(query) != 0) | (np.diff(cell) != 0)) + 1
    starts = np.concatenate(([0], edges))
    return query[starts], cell[starts], np.split(lists.astype(np.int32), edges)


def search(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10,
    sample: int = 20_000, lists: int | None = None, probes: int | None = None, least_rows: int = 512, recall: float = 0.98, doubt: float | None = 2.5, rows_a_cell: int = 4096, queries_a_part: int = 8192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for ids divisible by ``every``, the ``k`` nearest other rows found.

    Order is by exact Euclidean distance, then by id.  Null, zero, and non-finite vectors,
    those of another dimension than most, and null ids take no part.  Rows with one id and
    one vector are one row.  ``lists`` defaults to four times the square root of the number
    of distinct vectors, an eighth of the sample at most; ``probes`` to what the share
    ``recall`` of the sample's neighbours needs, which is above what unseen vectors reach, as the centroids fit the sample, and to lists of
    ``least_rows`` vectors together at least.  With as many ``probes`` as lists and
    ``doubt`` None the answer is exact.  An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, key = sizes[0]["dim"], ["vkey", "vkey2"]
    # Two hashes, 128 bits, stand for a vector where its numbers are not needed.
    rows = rows.where(F.size("v") == dim).withColumns({"vkey": F.xxhash64("v"), "vkey2": F.xxhash64(F.lit("second"), "v")})
    # The k + 1 smallest ids of each distinct vector; the limit runs before the shuffle too.
    ranked = rows.dropDuplicates(["vec_id", *key]).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = cut_lineage(ranked.groupBy(*key).agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", *key])
    queries = cut_lineage(asked.groupBy(*key).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")))

    total = entries.count()
    drawn = np.array([r["v"] for r in entries.orderBy(F.xxhash64(F.lit("sample"), "vkey"), "vkey").limit(min(sample, total)).select("v").collect()])
    lists = max(1, min(lists or int(4 * total**0.5), len(drawn) // 8 or 1))
    centers, turn = kmeans(drawn, lists), rotation(dim)
    probed = min(lists, probes or max(-(-lists * least_rows // max(1, total)), probes_for(drawn, centers, k, recall)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["list"] = nearest(np.array(batch["v"].tolist()), centers, 1)[:, 0]
                yield batch

    indexed = cut_lineage(entries.mapInPandas(assign, "vkey long, vkey2 long, v array<double>, ids array<long>, list int"))
    counted = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts = cells_of(np.array([counted.get(j, 0) for j in range(lists)]), centers, rows_a_cell)
    of_list = lambda array: F.get(F.array(*(F.lit(int(x)) for x in array)), F.col("list"))
    query_parts = max(1, -(-queries.count() // queries_a_part))
    dealt = indexed.withColumn("cell", of_list(first) + F.pmod("vkey", of_list(parts))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                own = batch.iloc[lo : lo + 256]
                query, cell, visited = visits_of(nearest(np.array(own["v"].tolist()), centers, probed), first, parts)
                yield own.iloc[query].assign(cell=cell, lists=visited)

    visits = queries.select(*key, "v").mapInPandas(probe, "vkey long, vkey2 long, v array<double>, cell long, lists array<int>").withColumn("part", F.pmod("vkey2", F.lit(query_parts)).cast("int"))

    def scan_cell(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            names, place = np.unique(own["list"].to_numpy(), return_inverse=True)
            visited = np.zeros((len(asking), lists), bool)
            for i, chosen in enumerate(asking["lists"]):
                visited[i, chosen] = True
            at, of, far = survivors(np.array(asking["v"].tolist()), np.array(own["v"].tolist()), turn, visited[:, names][:, place], k + 1, doubt)
            ids, first_key, second_key = own["ids"].to_list(), asking["vkey"].to_numpy(), asking["vkey2"].to_numpy()
            for i, found in pd.DataFrame({"at": at, "of": of, "far": far}).groupby("at"):
                near = found.nsmallest(k + 1, "far", keep="all")
                best = sorted((d, j) for o, d in zip(near["of"], near["far"], strict=True) for j in ids[o])[: k + 1]
                out += [(first_key[i], second_key[i], j, d) for d, j in best]
        return pd.DataFrame(out, columns=["vkey", "vkey2", "vec_id", "score"])

    found = dealt.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInPandas(scan_cell, "vkey long, vkey2 long, vec_id long, score double")
    top = found.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    best = cut_lineage(top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best")).join(queries.select(*key, "n"), key))
    answered = look_up(asked.select(F.col("vec_id").alias("query_id"), *key), best, key, "n")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "found")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))


def neighbour_digest(table: DataFrame) -> DataFrame:
    """The contract's columns; vectors of another dimension than most take no part."""
    return search(table.select("vec_id", "embedding"))
