"""Exact and near duplicates of articles."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.hashing import hamming

BANDS, BAND_BITS = 4, 16
#: Four of a hash's eight bytes whose numbers make zero together: 14 choices, and for any
#: three bytes one that has none of them, so hashes at three differing bits or fewer agree in one.
BYTE_SETS = [s for s in itertools.combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def first_seen(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; the rank limit runs before the shuffle too."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def cap_items(items: DataFrame, most: int | None, *, by: list[str], order: str) -> DataFrame:
    """The first ``most`` items of each feed; no cap for None or a number below 1."""
    if not most or most < 1:
        return items
    ranked = items.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def keys_of(h: Column) -> Column:
    """Generator of ``(band, key)``: the 32 bits of a hash in each of the 14 choices of four bytes.

    With 32 bits instead of 16, hashes that are not near hardly ever meet, however many there are.
    """
    octet = lambda k: F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(0xFF))
    word = lambda s: functools.reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(octet(k), 8 * place) for place, k in enumerate(s)))
    return F.posexplode(F.array(*(word(s) for s in BYTE_SETS))).alias("band", "key")


def near_pairs(articles: DataFrame, *, id_col: str = "id", hash_col: str = "simhash", time_col: str = "fetched_at", within_days: float = 2.0, threshold: int = 3) -> DataFrame:
    """``(earlier, later, distance)``: pairs at ``threshold`` (3 at most) or fewer differing bits, not over ``within_days`` apart.

    Four bands of 16 bits: three differing bits leave one band equal, so the equi-join
    finds every pair.  The band key also holds the day slot of the window, so a band that
    many share (an empty text's) meets only its neighbours in time.  Earlier means by time,
    then by id.  Rows without a time or a hash pair with none.
    """
    if threshold >= BANDS:
        raise ValueError("four bands guarantee at most 3 differing bits")
    span = int(within_days * 86_400_000_000)
    rows = articles.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")).where(F.col("h").isNotNull() & F.col("t").isNotNull())
    rows = rows.withColumn("slot", F.floor(F.col("t") / F.lit(max(1, span))))
    band = F.posexplode(F.array(*(F.shiftrightunsigned("h", BAND_BITS * k).bitwiseAND(F.lit(0xFFFF)) for k in range(BANDS)))).alias("band", "key")
    old = rows.select(F.col("id").alias("earlier"), F.col("h").alias("h1"), F.col("t").alias("t1"), "slot", band)
    new = rows.select(F.col("id").alias("later"), F.col("h").alias("h2"), F.col("t").alias("t2"), band, F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot"))
    met = old.join(new, ["band", "key", "slot"])
    first_band = F.coalesce(*(F.when(F.shiftrightunsigned("h1", BAND_BITS * k).bitwiseAND(F.lit(0xFFFF)) == F.shiftrightunsigned("h2", BAND_BITS * k).bitwiseAND(F.lit(0xFFFF)), F.lit(k)) for k in range(BANDS)))
    in_order = (F.col("t1") < F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("earlier") < F.col("later")))
    near = met.where(in_order & (F.col("t2") - F.col("t1") <= span) & (hamming(F.col("h1"), F.col("h2")) <= threshold) & (F.col("band") == first_band))
    return near.select("earlier", "later", hamming(F.col("h1"), F.col("h2")).alias("distance"))


def near_stored(fresh: DataFrame, stored: DataFrame, *, id_col: str = "id", hash_col: str = "simhash", time_col: str = "fetched_at", within_days: float = 2.0, threshold: int = 3) -> DataFrame:
    """Ids (column ``id``) of ``fresh`` rows that are near a stored row fetched at most ``within_days`` before them, or after them.

    Only fresh hashes meet stored ones, and each different hash once: a hash is looked up
    with the latest time at which a stored row had one near it.
    """
    if threshold >= BANDS:
        raise ValueError("the choices of bytes guarantee at most 3 differing bits")
    micros = F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")
    rows = fresh.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), micros).where(F.col("h").isNotNull() & F.col("t").isNotNull())
    known = stored.select(F.col(hash_col).alias("h"), micros).where(F.col("h").isNotNull() & F.col("t").isNotNull()).groupBy("h").agg(F.max("t").alias("last"))
    asked = rows.select("h").distinct().select("h", keys_of(F.col("h")))
    met = asked.join(known.select(F.col("h").alias("held"), "last", keys_of(F.col("h"))), ["band", "key"]).where(hamming(F.col("h"), F.col("held")) <= threshold)
    latest = met.groupBy("h").agg(F.max("last").alias("last"))
    return rows.join(latest, "h").where(F.col("last") >= F.col("t") - int(within_days * 86_400_000_000)).select("id")


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    """``(a, b)``: the different hashes of ``rows(h, slot)`` within the threshold that occur in the same or in neighbouring slots, both ways round."""
    band = keys_of(F.col("h"))
    classes = rows.select("h", "slot").distinct()
    left = classes.select(F.col("h").alias("a"), "slot", band)
    right = classes.select(F.col("h").alias("b"), band, F.explode(F.array(F.col("slot") - 1, F.col("slot"))).alias("slot"))
    met = left.join(right, ["band", "key", "slot"]).where((F.col("a") != F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold))
    # The right one is of the same slot or the next.
    return met.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, comp)``: the smallest value that each value of ``links(a, b)``, given both ways round, is joined to.

    In each round a value takes the least label that its neighbours' labels have, and its own
    label's own, and tells that to the value that was its label, which so joins two trees of
    labels as wholes.  The rounds grow with the logarithm of the longest chain or less.
    """
    from corpusloom.sources.storage import cut_lineage

    labels = cut_lineage(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        up = labels.join(labels.select(F.col("a").alias("comp"), F.col("comp").alias("up")), "comp").select("a", "comp", "up")
        seen = links.join(up.select(F.col("a").alias("b"), "up"), "b").select("a", F.lit(None).cast(up.schema["comp"].dataType).alias("comp"), "up")
        least = seen.unionByName(up).groupBy("a").agg(F.max("comp").alias("was"), F.min("up").alias("least"))
        told = least.select("least", F.inline(F.array(F.struct(F.col("a").alias("to"), "was"), F.struct(F.col("was").alias("to"), F.lit(None).cast(up.schema["comp"].dataType).alias("was")))))
        new = cut_lineage(told.groupBy(F.col("to").alias("a")).agg(F.min("least").alias("comp"), F.max("was").alias("was")))
        labels = new.select("a", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


def _swept(rows: DataFrame, links: DataFrame, span: int) -> DataFrame:
    """Ids of the rows of ``rows(comp, id, h, t)`` that are kept, by one pass over each component in order of time.

    ``links(comp, a, b)`` come before a component's rows and are what the pass holds; the rows stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, linked, closed = None, {}, {}
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for k, (own, a, b, h, t) in enumerate(zip(*(batch.column(c).to_numpy().tolist() for c in ("comp", "a", "b", "h", "t")), strict=True)):
                if own != comp:
                    comp, linked, closed = own, {}, {}
                if t < 0:
                    linked.setdefault(a, []).append(b)
                elif t > closed.get(h, -1):
                    kept[k] = True
                    closed[h] = t + span
                    for other in linked.get(h, ()):
                        closed[other] = t + span
            yield batch.select(["id"]).filter(pa.array(kept))

    # Times are counted from the first one on, so that -1 comes before all of them.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(rows.schema["id"].dataType)
    first = rows.agg(F.min("t")).first()[0]
    heads = links.select("comp", "a", "b", zero.alias("h"), F.lit(-1).cast("long").alias("t"), none.alias("id"))
    every = heads.unionByName(rows.select("comp", zero.alias("a"), zero.alias("b"), "h", (F.col("t") - (first or 0)).alias("t"), "id"))
    return every.repartition("comp").sortWithinPartitions("comp", "t", "id").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}")


def keep_first(articles: DataFrame, *, id_col: str = "id", hash_col: str = "simhash", time_col: str = "fetched_at", within_days: float = 2.0, threshold: int = 3, most: int = 5_000_000) -> DataFrame:
    """``(id, kept)``: in order of time, then id, a row is kept unless a kept row not over ``within_days`` before it is near.

    Hashes that are near each other within the window, directly or by others, are a
    component, and nothing outside decides its rows: each is swept once in order of time, in
    one pass whatever the time covered.  Components of more than ``most`` rows, which would
    hold up one task, are decided in rounds instead (``_in_rounds``).  Rows without a time
    or a hash are kept.
    """
    from corpusloom.sources.storage import cut_lineage

    if threshold >= BANDS:
        raise ValueError("four bands guarantee at most 3 differing bits")
    span = int(within_days * 86_400_000_000)
    rows = articles.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"))
    timed = cut_lineage(rows.where(F.col("h").isNotNull() & F.col("t").isNotNull()))
    links = cut_lineage(_linked(timed.withColumn("slot", F.floor(F.col("t") / F.lit(max(1, span)))), threshold))
    of = components(links)
    sizes = timed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(of.withColumnRenamed("a", "h"), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    # At most one for every ``most`` rows.
    large = F.broadcast(cut_lineage(sizes.groupBy("comp").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("comp", F.lit(True).alias("large"))))
    placed = sizes.select("h", "comp").join(large, "comp", "left")
    known = timed.join(placed, "h")
    kept = _swept(known.where("large IS NULL").drop("large"), links.join(of, "a").join(large, "comp", "left_anti"), span)
    if not large.isEmpty():
        hot = cut_lineage(known.where("large").select("id", "h", "t"))
        kept = kept.unionByName(_in_rounds(hot, links.join(hot.select(F.col("h").alias("a")).distinct(), "a", "left_semi"), span))
    kept = kept.unionByName(rows.where(F.col("h").isNull() | F.col("t").isNull()).select("id"))
    return rows.select("id").join(kept.withColumn("_kept", F.lit(True)), "id", "left").select("id", F.col("_kept").isNotNull().alias("kept"))


def _in_rounds(left: DataFrame, links: DataFrame, span: int) -> DataFrame:
    """Ids of the rows of ``left(id, h, t)`` that are kept.

    Copies are handled as classes of one hash, so many of them make no pairs.  In each
    round the earliest open row of a class is kept if no linked class has an earlier one;
    that closes all later rows of its class and of linked ones within the window.  The
    earliest open row of all is always decided, so the rounds end; their number grows with
    the time covered.
    """
    from corpusloom.sources.storage import cut_lineage

    links, rounds = cut_lineage(links), [left.select("id").limit(0)]
    while not left.isEmpty():
        heads = left.groupBy("h").agg(F.min(F.struct("t", "id")).alias("head"))
        behind = links.join(heads.withColumnRenamed("h", "a"), "a").join(heads.select(F.col("h").alias("b"), F.col("head").alias("earlier")), "b")
        behind = behind.where(F.col("earlier") < F.col("head")).select(F.col("a").alias("h")).distinct()
        chosen = cut_lineage(heads.join(behind, "h", "left_anti").select("h", "head.t", "head.id"))
        rounds.append(chosen.select("id"))
        if len(rounds) > 20:
            rounds = [cut_lineage(functools.reduce(DataFrame.unionByName, rounds))]
        # All open rows of these classes come after the rows that were chosen now.
        reach = links.join(chosen.withColumnRenamed("h", "a"), "a").select(F.col("b").alias("h"), "t").unionByName(chosen.select("h", "t")).groupBy("h").agg(F.max("t").alias("_last"))
        left = cut_lineage(left.join(reach, "h", "left").where(F.col("_last").isNull() | (F.col("t") > F.col("_last") + span)).drop("_last"))
    return functools.reduce(DataFrame.unionByName, rounds)
