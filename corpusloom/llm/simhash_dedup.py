"""SimHash near-dedup over an inverted index of positional bytes.

A fingerprint has 8 bytes.  Fingerprints at 3 or fewer differing bits differ in at most 3
bytes, so they share at least 5 positional bytes.  Any 3 of 8 positions lie together in
exactly one block of the Steiner system S(3,4,8); the block's complement, which is a block
too, then holds 4 shared bytes.  So posting lists keyed by the 14 blocks and their 4 bytes
bring together every pair that can reach the minimum count.  A pair's shared bytes are
tallied, pairs below 5 go, and the rest are verified by their differing bits.  Lists of
single bytes, which the tally alone would need, hold 1/256 of all fingerprints each (200
million of 51 billion), and their pairs could not be made; lists of four bytes hold 1/2^32,
and a list that is dense all the same is looked up by its fingerprints' neighbours instead.

Equal fingerprints are collapsed before anything is indexed, so copies cost nothing.
Components come from alternating minimum-label rounds over checkpointed links between
distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage, look_up

#: The 14 blocks of the Steiner system S(3,4,8) on positions 0 to 7.
BLOCKS = (
    (0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6),
    (4, 5, 6, 7), (2, 3, 6, 7), (2, 3, 4, 5), (1, 3, 5, 7), (1, 3, 4, 6), (1, 2, 5, 6), (1, 2, 4, 7),
)
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The text's 64-bit SimHash, unsigned; 0 without words.

    Words are runs of bytes other than ASCII white space with A-Z lower-cased; a bit is set
    if more than half of the shingles' XXH64 have it, repeats included.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter([hash_of(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` ids and the columns ``keep`` with ``fp``, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), *keep, fp(F.col(text_col).cast("string")).alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: What a block's four bytes cover.
BLOCK_MASKS = tuple(_signed(sum(255 << (8 * k) for k in block)) for block in BLOCKS)


def shared_bytes(differing: Column) -> Column:
    """How many of the 8 positional bytes are equal, by the bits that differ: each byte's bits are folded into its lowest."""
    for step in (4, 2, 1):
        differing = differing.bitwiseOR(F.shiftrightunsigned(differing, step))
    return 8 - F.bit_count(differing.bitwiseAND(F.lit(0x0101010101010101)))


def links(distinct: DataFrame, *, radius: int = 3, dense: int = 4096) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` at 1 to ``radius`` (3 at most) differing bits.

    Fingerprints of a posting list are compared pair by pair if it has at most ``dense``.
    In a longer one each fingerprint looks up all that differ from it in up to ``radius``
    bits outside the list's bytes, 5488 at most, so a list costs no more than that times its
    length, whatever it holds.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the blocks guarantee a radius of 3 at most")
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.lit(m) for m in BLOCK_MASKS))).alias("block", "mask")).select("fp", "block", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # Counted on the partitioning and in the order that the join needs as well.
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("block", "key")))
    few, many = sized.where(F.col("n") <= dense), cut_lineage(sized.where(F.col("n") > dense))
    if many.isEmpty():
        return _met(keyed, radius)
    # 14 blocks of 5488 masks at most: a proven bound.
    masks = distinct.sparkSession.createDataFrame(_masks(radius), "block int, mask long")
    asked = many.join(F.broadcast(masks), "block").select("block", "key", F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("mask")).alias("b")).where(F.col("a") < F.col("b"))
    held = many.select("block", F.col("fp").alias("b"))
    found = asked.where(_is_first()).join(held, ["block", "b"], "left_semi").select("a", "b")
    return _met(few, radius).unionByName(found)


def _masks(radius: int) -> list[tuple[int, int]]:
    """``(block, mask)``: all ways to set 1 to ``radius`` bits outside the block's bytes."""
    out = []
    for block, at in enumerate(BLOCKS):
        free = [8 * k + bit for k in range(8) if k not in at for bit in range(8)]
        for n in range(1, radius + 1):
            out += [(block, _signed(sum(1 << b for b in bits))) for bits in combinations(free, n)]
    return out


def _is_first() -> Column:
    """Whether no earlier block's bytes are all shared by ``a`` and ``b``: a pair counts in the first such block, so it comes out once."""
    earlier = F.slice(F.array(*(F.lit(m) for m in BLOCK_MASKS)), F.lit(1), F.col("block"))
    return ~F.exists(earlier, lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) == 0)


def _met(keyed: DataFrame, radius: int) -> DataFrame:
    differing = F.col("a").bitwiseXOR(F.col("b"))
    met = keyed.select(F.col("fp").alias("a"), "block", "key").join(keyed.select(F.col("fp").alias("b"), "block", "key"), ["block", "key"])
    near = (F.col("a") < F.col("b")) & (shared_bytes(differing) >= 8 - radius) & (F.bit_count(differing) <= radius)
    return met.where(near & _is_first()).select("a", "b")


def components(pairs: DataFrame, nodes: DataFrame, *, broadcast_rows: int = 500_000, salts: int = 64) -> DataFrame:
    """``(node, label)`` for each of ``nodes`` (column ``node`` with its ``label``): the least label that links reach.

    Rounds alternate between neighbours' least label and a jump to the label's own label,
    so the number of rounds grows with the logarithm of a component's diameter in practice;
    the loop ends when no label changes, which it must, as labels only fall.  Each round is
    checkpointed.  Nodes without links take no part in the rounds.  The jumps of a round
    are broadcast if they are counted to be at most ``broadcast_rows``; else the nodes of a
    large component are dealt into ``salts`` tasks.
    """
    both = cut_lineage(pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b"), F.col("a"))))
    state = cut_lineage(nodes.join(both.select("node").distinct(), "node", "left_semi").select("node", "label"))
    changed = not state.isEmpty()
    while changed:
        # A node has a bounded number of neighbours within the radius, so this join has no hot key.
        told = both.join(state.select(F.col("node").alias("other"), F.col("label").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        nearer = cut_lineage(state.join(told, "node", "left").select("node", F.col("label").alias("before"), F.least("label", "heard").alias("label")))
        hooks = cut_lineage(nearer.groupBy(F.col("before").alias("label")).agg(F.min("label").alias("hook")).where(F.col("hook") < F.col("label")))
        # A label falls where one of its nodes hears of a lesser one, so without hooks nothing has changed.
        fallen = hooks.count()
        changed = fallen > 0
        if fallen <= broadcast_rows:
            jumped = nearer.join(F.broadcast(hooks), "label", "left")
        else:
            dealt = hooks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
            jumped = nearer.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts))).join(dealt, ["label", "salt"], "left")
        state = jumped.select("node", F.least("label", "hook").alias("label"))
    return nodes.join(state.select("node", F.col("label").alias("least")), "node", "left").select("node", F.coalesce("least", "label").alias("label"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, keep: tuple[str, ...] = (), by_print: bool = False) -> DataFrame:
    """One row ``(doc_id, fp, component_id)``, with the columns ``keep`` after the id, per row of ``docs``.

    ``component_id`` is the least id that links reach, its own included.  Null, empty and
    word-less texts have fingerprint 0 and link like any other.  A row with a null id has
    the component of its fingerprint; a component of null ids only has a null
    ``component_id``.  With ``by_print`` it is the component's least fingerprint instead,
    which tells components apart whatever the ids.  Columns of ``docs`` that are not named
    are not read; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, keep=keep))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    far = F.lit((1 << 63) - 1)  # a class of null ids only
    label = F.col("fp") if by_print else F.coalesce(F.col("least").cast("long"), far)
    found = components(links(classes.select("fp"), radius=radius), classes.select(F.col("fp").alias("node"), label.alias("label")))
    known = F.col("label") if by_print else F.when(F.col("label") != far, F.col("label"))
    labels = found.select(F.col("node").alias("fp"), known.alias("component_id"))
    # Copies of one text have one fingerprint, which a third of all rows may share.
    facts = cut_lineage(labels.join(classes.select("fp", "n"), "fp"))
    return look_up(prints, facts, ["fp"], "n").select("doc_id", *keep, "fp", "component_id")


def near_digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
