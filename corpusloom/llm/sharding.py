"""Sharding by sampled splitters.

A record's place is its key: the hash of its text, then the hash of its id, then that of its
place in the table, so equal texts are neighbours and no two records have one key.  A size-weighted sample of keys is drawn (bounded in expectation), its
quantiles cut the key space into ranges, and every record is counted in its range exactly.
A range that holds more than its share, as one hot text makes, is cut again inside by the
rest of the key; other cuts fall between texts.  Shards are runs of consecutive
ranges whose exact bytes are nearest to equal; one more sample inside the ranges that a
shard's ideal edge crosses makes the edges finer.  All data pass DataFrame code only; the
driver sees the sample and one row per range.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage

LOW = ""  # below every key


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, key)`` per row; a null text counts as empty.

    The last part of the key is of use only once the rows are written somewhere: it tells
    rows apart that are equal in id and text, so many of them can be cut into ranges too.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(F.lit("id"), F.col(id_col))), _hex(F.xxhash64(F.monotonically_increasing_id()))).alias("key"),
    )


def weighted_sample(records: DataFrame, total: int, wanted: int, salt: str) -> list[tuple[str, float]]:
    """About ``wanted`` keys in key order with their weights; each key's chance is in proportion to its size.

    The draw is a hash of the key, so a task that runs again draws the same.  A record
    larger than a draw's step is always in and weighs its size.
    """
    step = max(1.0, total / max(1, wanted))
    u = F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.where(u < F.col("size") / F.lit(step)).select("key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    return sorted((r["key"], r["weight"]) for r in drawn.collect())


def quantile_splitters(sample: list[tuple[str, float]], ranges: int) -> list[str]:
    """Sorted lower edges of ranges 1, 2, ...; an edge is cut inside a text only if that text fills more than a range."""
    total = sum(w for _, w in sample)
    weight_of: dict[str, float] = {}
    for key, w in sample:
        weight_of[key[:16]] = weight_of.get(key[:16], 0.0) + w
    edges, seen, k = set(), 0.0, 1
    for key, w in sample:
        while k < ranges and seen + w > total * k / ranges:
            edges.add(key if weight_of[key[:16]] > total / ranges else key[:16])
            k += 1
        seen += w
    return sorted(edges - {LOW})


def range_of(key: Column, edges: list[str]) -> Column:
    """The number of edges at or below the key, by two steps of about the square root of their number."""
    if not edges:
        return F.lit(0)
    wide = max(1, int(len(edges) ** 0.5))
    blocks = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    heads = F.array(*(F.lit(b[0]) for b in blocks))
    inner = F.array(*(F.array(*(F.lit(e) for e in b)) for b in blocks))
    count = lambda array: F.size(F.filter(array, lambda e: e <= key))
    block = count(heads)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * wide + count(F.get(inner, block - 1)))


def _exact(records: DataFrame, edges: list[str]) -> list[tuple[int, int]]:
    """(bytes, rows) of each range."""
    rows = records.groupBy(range_of(F.col("key"), edges).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    found = {r["range"]: (r["bytes"], r["rows"]) for r in rows}
    return [found.get(k, (0, 0)) for k in range(len(edges) + 1)]


def _crossed(exact: list[tuple[int, int]], shards: int) -> list[int]:
    """The ranges with more than one row in which an ideal shard edge lies."""
    total, seen, out = sum(b for b, _ in exact), 0, []
    for k, (size, rows) in enumerate(exact):
        if rows > 1 and any(seen < total * s / shards < seen + size for s in range(1, shards)):
            out.append(k)
        seen += size
    return out


def shard_by_bytes(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", sample: int = 32_768, ranges: int = 1024, rows_a_range: int = 500_000, most_ranges: int = 16_384) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` with shard sizes as near equal as ranges allow.

    ``ranges`` (more for more rows than ``rows_a_range`` each, ``most_ranges`` at most)
    and ``sample`` bound what reaches the driver.  Slots are gapless from 0 in each shard,
    in key order; they come from exact counts of earlier ranges and a row number within
    the range, so no task orders a whole shard.  Rows equal in id and text are ordered
    arbitrarily but hold different slots.  Null ids are ids like others; columns that are
    not named are not read; an empty table gives no rows.
    """
    records = cut_lineage(sized(docs, id_col=id_col, text_col=text_col))
    whole = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not whole["rows"]:
        return records.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(most_ranges, max(ranges, -(-whole["rows"] // rows_a_range)))
    edges = quantile_splitters(weighted_sample(records, whole["bytes"], sample, "first"), ranges)
    exact = _exact(records, edges)
    if crossed := _crossed(exact, shards):
        at = range_of(F.col("key"), edges)
        inside = records.where(at.isin(crossed))
        again = weighted_sample(inside, sum(exact[k][0] for k in crossed), sample, "second")
        finer: set[str] = set(edges)
        for k in crossed:
            low, high = (edges[k - 1] if k else LOW), (edges[k] if k < len(edges) else "~")
            own = [x for x in again if low <= x[0] < high]
            finer |= {e for e in quantile_splitters(own, 64) if low < e < high}
        edges = sorted(finer)
        exact = _exact(records, edges)
    return _place(records, edges, exact, shards)


def _place(records: DataFrame, edges: list[str], exact: list[tuple[int, int]], shards: int) -> DataFrame:
    ends, rows_before, seen, rows = [], [], 0, 0
    for size, n in exact:
        rows_before.append(rows)
        seen, rows = seen + size, rows + n
        ends.append(seen)
    cuts, first = [], 0
    for s in range(1, shards):
        ideal = seen * s / shards
        k = bisect_left(ends, ideal)
        # The range end nearest to the ideal edge; never before an earlier shard's.
        if k and ideal - ends[k - 1] <= ends[k] - ideal:
            k -= 1
        first = max(first, k + 1)
        cuts.append(min(first, len(exact)))
    shard_of, start_of = [], []
    for k in range(len(exact)):
        s = sum(c <= k for c in cuts)
        shard_of.append(s)
        start_of.append(rows_before[k] - (rows_before[cuts[s - 1]] if s else 0))
    return _slots(records, edges, shard_of, start_of)


def _slots(records: DataFrame, edges: list[str], shard_of: list[int], start_of: list[int]) -> DataFrame:
    spark = records.sparkSession
    placed = spark.createDataFrame([(k, s, b) for k, (s, b) in enumerate(zip(shard_of, start_of, strict=True))], "range int, shard int, start long")
    ranged = records.withColumn("range", range_of(F.col("key"), edges))
    numbered = ranged.withColumn("n", F.row_number().over(W.partitionBy("range").orderBy("key", "id")))
    # One row per range, most_ranges plus 64 for each shard at most: a proven bound.
    return numbered.join(F.broadcast(placed), "range").select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    out = shard_by_bytes(docs.select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
