"""Benchmark decontamination by SimHash windows of each item's own length.

1. Words are runs of letters and digits, lower-cased; a shingle is five words (a shorter
   text is one shingle).  A window of w shingles similar enough to an item of k holds at
   least ``similarity * (w + k) / (1 + similarity)`` shingles that the item has.  So of all
   starts only those are looked at whose window holds that many.  This pruning is exact in
   what it drops: no other window can reach the similarity.
2. Each such window has the item's number of words and gets the SimHash of its shingles.
3. Fingerprints of windows and of items of the same length meet in a multi-index: 8 blocks
   of 8 bits.  Two fingerprints within ``radius`` differ in at most ``radius // 8`` bits in
   some block, and the items' side lists every block value that near, so all pairs within
   the radius are found; the rest is cut by counting differing bits.
4. Exact similarity, the weighted Jaccard of the shingle multisets, decides.

Items of fewer than five words are one shingle of their own length and are looked up among
the documents' runs of as many words.

Everything is DataFrame code.  Shared shingles are joined by hash after both sides are
pre-aggregated per document; the item side is broadcast only if it is counted to be small.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage

SHINGLE = 5
BLOCK_BITS = 8
#: A broadcast side has at most so many rows, of some 24 bytes each.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """XXH64 of each run of ``size`` words; of all the words if there are fewer; [] without words."""
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size)))
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<long>")).when(F.size(words) < size, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - size), at))


def runs_of(words: Column, size: int) -> Column:
    """XXH64 of each run of ``size`` words, as ``shingle_hashes`` has it for a text of that many."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, size), " ")))


def with_shingles(df: DataFrame, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``df`` with ``w`` (words) and ``hs`` (shingle hashes).

    Explode ``hs`` by an outer generator: for an inner one the optimizer infers a filter on
    the array's size and pushes it below, where it makes all words again for every shingle.
    """
    return df.withColumn("w", words_of(F.col(text_col))).withColumn("hs", shingle_hashes(F.col("w"), size))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lane_sums(weight: Column, value: Column) -> list[Column]:
    """32 sums of two counters each: sum k counts bit k in its lower half and bit k + 32 in its upper half."""
    pair = F.lit((1 << 32) + 1)
    return [F.sum(F.shiftrightunsigned(value, k).bitwiseAND(pair) * weight).alias(f"s{k}") for k in range(32)] + [F.sum(weight).alias("weight")]


def assemble() -> Column:
    """The signed long whose bits are set where more than half of the weight has them."""
    half = lambda of: F.array_join(F.transform(F.array(*(F.col(f"s{k}") for k in reversed(range(32)))), lambda x: F.when(of(x) * 2 > F.col("weight"), F.lit("1")).otherwise(F.lit("0"))), "")
    upper, lower = half(lambda x: F.shiftright(x, 32)), half(lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
    return F.conv(F.concat(upper, lower), 2, -10).cast("long")


def block_value(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * k).bitwiseAND(F.lit(255)).cast("int")


def near_values(reach: int) -> list[int]:
    """Masks of up to ``reach`` of 8 bits."""
    return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BLOCK_BITS), n)]


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", similarity: float = 0.8, radius: int = 23, size: int = SHINGLE, by_text: bool = False) -> DataFrame:
    """``(doc_id, item_id, similarity, window_start, window_words)``: each document's best window for each item it leaks.

    Similarity is the weighted Jaccard of shingle multisets, at least ``similarity``; the
    window has the item's number of words, or is the whole document if that is shorter,
    and ``window_start`` counts words from 0 (ties: the earliest).  Null, empty and
    word-less texts and items match nothing.  Items equal in words each match.  Documents
    with one id are told apart by their text and reported under that id, best window
    first; with ``by_text`` each text has its own rows, and ``sig``, the XXH64 of the text
    (of an empty one for null), is the last column.  ``radius`` is the number of differing
    fingerprint bits searched exhaustively.  Repeated rows count once, other columns are not
    read, and either table may be empty.
    """
    bench = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text")), "text", size)
    item = cut_lineage(bench.select("item_id", F.size("w").alias("n"), F.posexplode_outer("hs").alias("off", "h")))
    shorter = item.where(F.col("n").between(1, size - 1))
    lengths = sorted(r["n"] for r in shorter.select("n").distinct().collect())
    short_rows = shorter.count() if lengths else 0
    item = item.where(F.col("n") >= size)
    rows = item.count()

    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"), F.col(text_col).alias("text"))
    shingled = with_shingles(own, "text", size)
    hit = shingled.select("doc_id", "sig", F.size("hs").alias("m"), F.posexplode_outer("hs").alias("pos", "h")).join(_small(item, rows), "h")
    hits = hit.groupBy("doc_id", "sig", "item_id", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # A window of ``wide`` shingles that holds ``need`` hits lies around ``need`` consecutive ones.
    width = F.col("n") - (size - 1)
    need = F.greatest(F.lit(1), F.ceil(similarity * (F.col("wide") + F.col("width")) / (1 + similarity) - 1e-9)).cast("int")
    enough = hits.withColumn("width", width).withColumn("wide", F.least("width", "m")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    low = lambda i: F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("wide") + 1)
    high = lambda i: F.least(F.get("at", i), F.col("m") - F.col("wide"))
    around = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>")))
    window = cut_lineage(enough.select("doc_id", "sig", "n", "width", F.explode_outer(F.flatten(around)).alias("start")).where(F.col("start").isNotNull()).distinct())

    by_doc = window.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("n", "start", "width")).alias("windows"))
    found = cut_lineage(by_doc)
    leaking = found.agg(F.coalesce(F.sum(F.size("windows") + 8), F.lit(0)).alias("n")).first()["n"]
    held = own.join(_small(found.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "windows"), leaking), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s")))
    again = with_shingles(held.dropDuplicates(["doc_id", "sig"]), "text", size)
    pieces = again.select("doc_id", "sig", "hs", F.explode("windows").alias("win")).select("doc_id", "sig", "win.n", "win.start", F.slice("hs", F.col("win.start") + 1, F.col("win.width")).alias("part"))
    win = cut_lineage(pieces.select("doc_id", "sig", "n", "start", F.size("part").alias("total"), F.explode("part").alias("h")).groupBy("doc_id", "sig", "n", "start", "total", "h").agg(F.count(F.lit(1)).alias("c")))
    item_h = item.groupBy("item_id", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    item_total = F.greatest(F.col("n") - (size - 1), F.lit(1))

    prints = cut_lineage(win.groupBy("doc_id", "sig", "n", "start", "total").agg(*lane_sums(F.col("c"), F.col("h"))).select("doc_id", "sig", "n", "start", "total", assemble().alias("fp")))
    item_fp = cut_lineage(item_h.groupBy("item_id", "n").agg(*lane_sums(F.col("c"), F.col("h"))).select("item_id", "n", assemble().alias("item_fp")))
    masks = F.array(*(F.lit(m) for m in near_values(radius // BLOCK_BITS)))
    listed = item_fp.select("item_id", "n", "item_fp", F.posexplode(F.array(*(block_value(F.col("item_fp"), k) for k in range(64 // BLOCK_BITS)))).alias("block", "own")).select("item_id", "n", "item_fp", "block", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"))
    keyed = prints.select("doc_id", "sig", "n", "start", "total", "fp", F.posexplode(F.array(*(block_value(F.col("fp"), k) for k in range(64 // BLOCK_BITS)))).alias("block", "value"))
    near = keyed.join(listed, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    candidate = cut_lineage(near.select("doc_id", "sig", "n", "start", "total", "item_id").distinct())

    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.sig") == F.col("b.sig"), F.col("a.n") == F.col("b.n"), F.col("a.start") == F.col("b.start")]
    with_h = candidate.alias("a").join(win.alias("b"), same).select("a.*", F.col("b.h").alias("h"), F.col("b.c").alias("cw"))
    shared = with_h.join(item_h.withColumnRenamed("c", "ci"), ["item_id", "n", "h"]).groupBy("doc_id", "sig", "item_id", "n", "start", "total").agg(F.sum(F.least("cw", "ci")).alias("m"))
    scored = shared.withColumn("similarity", F.col("m") / (F.col("total") + item_total - F.col("m"))).where(F.col("similarity") >= similarity)
    scored = scored.select("doc_id", "sig", "item_id", "similarity", "start", "n")
    for k in lengths:
        runs = own.withColumn("w", words_of(F.col("text"))).withColumn("runs", F.when(F.size("w") >= k, runs_of(F.col("w"), k)))
        of_length = shorter.where(F.col("n") == k).select("item_id", "n", "h")
        found_runs = runs.select("doc_id", "sig", F.posexplode_outer("runs").alias("start", "h")).join(_small(of_length, short_rows), "h")
        scored = scored.unionByName(found_runs.select("doc_id", "sig", "item_id", F.lit(1.0).alias("similarity"), "start", "n"))
    told_apart = ["sig"] if by_text else []
    best = scored.groupBy("doc_id", *told_apart, "item_id").agg(F.max(F.struct(F.col("similarity").alias("s"), (-F.col("start")).alias("p"), F.col("n").alias("n"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.s").alias("similarity"), (-F.col("best.p")).alias("window_start"), F.col("best.n").alias("window_words"), *told_apart)


def leak_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("window_start").cast("long").alias("window_start"), F.col("window_words").cast("long").alias("window_words"))
