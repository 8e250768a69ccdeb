"""Line dedup: lines that recur in several documents stay only in one of them.

Line hashes are range-partitioned and, inside a partition, sorted by hash, document and
position, so that each document's rank among the holders of a line streams past in one
sweep.  Hashes are uniform, so the ranges are equal parts of their space and no sample is
drawn.  The outcome is a compressed keep bitmap per document; texts are never shuffled by
line.  Everything is DataFrame code.

Skew: a hash's holders are dealt into ``slices`` by document, and each slice begins its
ranges at another partition, so a line that a third of all documents hold is spread over
many.  Only a slice's first ``min_docs`` documents can matter to the overall ranking, so
the second pass ranks at most ``slices * min_docs`` documents of any line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.core import let
from corpusloom.llm.shared import ASCII_SPACE, lower_ascii

WORD = 64


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: without ASCII white space at their ends, A-Z lower-cased."""
    return F.transform(_lines(lower_ascii(text)), lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hash_range(value: Column, piece: Column, parts: int, pieces: int) -> Column:
    """Which of ``parts`` equal ranges of all signed longs holds ``value``, counted from a place that depends on the slice ``piece``."""
    at = F.shiftright((F.shiftright(value, 32) + F.lit(1 << 31)) * F.lit(parts), 32)
    return F.pmod(at + piece * F.lit(max(1, parts // pieces)), F.lit(parts)).cast("int")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, slices: int = 32) -> DataFrame:
    """Rows ``(_id, _sig, keep_words)`` for the documents that lose a line.

    ``keep_words`` is the document's keep bitmap in words of 64 lines, as an array of
    ``(word, bits)`` sorted by word; words whose bits are all ones are left out, and a
    document that keeps all its lines has no row.  ``_sig`` is the XXH64 of the text.

    A line counts if its key has at least ``min_chars`` code points and at least
    ``min_docs`` (2 or more) different ids hold it; it then stays in the largest id only,
    with all its repeats there.  A null text is one empty line.  Rows with one id are one
    document for the count; a null id is the smallest of all.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    # The text's hash is made below the generator, or each line would hash the whole text.
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_sig", F.xxhash64("_text"))
    line = (
        base.select("_id", "_sig", F.posexplode_outer(line_keys(F.col("_text"))).alias("_pos", "_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_sig", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"), F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int").alias("_slice"))
    )
    newest = F.col("_id").desc_nulls_last()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = line.withColumn("_range", hash_range(F.col("_h1"), F.col("_slice"), parts, slices))
    first = ranged.repartitionById(parts, "_range").sortWithinPartitions("_range", "_h1", "_h2", "_slice", newest, "_pos")
    local = first.withColumn("_local", F.dense_rank().over(W.partitionBy("_range", "_h1", "_h2", "_slice").orderBy(newest))).drop("_range")
    # What ranks behind min_docs in its slice is decided; a salt keeps it out of the line's second group.
    dealt = local.withColumn("_salt", F.when(F.col("_local") <= min_docs, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("_id", "_pos"), F.lit(1 << 20))))
    group = W.partitionBy("_h1", "_h2", "_salt")
    ranked = dealt.withColumn("_rank", F.dense_rank().over(group.orderBy(newest)))
    counted = ranked.withColumn("_holders", F.max("_rank").over(group.orderBy(newest).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    lost = counted.where((F.col("_salt") > 0) | ((F.col("_holders") >= min_docs) & (F.col("_rank") > 1)))
    words = lost.groupBy("_id", "_sig", F.shiftright("_pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, _pos & 63)"))).alias("bits"))
    return words.groupBy("_id", "_sig").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep_words"))


def lost_positions(keep_words: Column) -> Column:
    """Sorted line numbers whose bit is 0."""
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    of_word = lambda w: F.transform(F.filter(bits, lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * WORD + b)
    return F.flatten(F.transform(keep_words, of_word))


def kept_lines(text: Column, lost: Column) -> Column:
    """The lines of ``text`` without the sorted positions ``lost``: the text is split once and the runs between them are joined."""

    def runs(found: Column) -> Column:
        lines, gone = found["lines"], found["gone"]
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i))))

    return F.array_join(let(F.struct(_lines(text).alias("lines"), lost.alias("gone")), runs), "\n")


def line_count(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped"), **limits) -> DataFrame:
    """``docs`` with the lost lines taken out of ``text_col`` and two more columns, named by ``counts``.

    Rows, their number and all other columns stay; columns of ``docs`` that have a name of
    ``counts`` give way to them.  A text that loses nothing, null included, stays as it is,
    and one that loses all its lines becomes empty.
    """
    kept, dropped, lines = _rebuilt(docs, id_col, text_col, limits)
    columns = [F.col("_kept").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in counts]
    return kept.select(*columns, lines.alias(counts[0]), dropped.alias(counts[1]))


def with_lines_dropped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **limits) -> DataFrame:
    """``docs``, all columns as they are but ``text_col`` without its lost lines and, where a text lost any, ``length_col`` its new length."""
    kept, dropped, _ = _rebuilt(docs, id_col, text_col, limits)
    columns = []
    for c in docs.columns:
        own = F.col(f"_row.`{c}`")
        if c == length_col:
            own = F.when(dropped > 0, F.char_length("_kept").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append((F.col("_kept") if c == text_col else own).alias(c))
    return kept.select(*columns)


def _rebuilt(docs: DataFrame, id_col: str, text_col: str, limits: dict) -> tuple[DataFrame, Column, Column]:
    """(rows with ``_row`` as it was and ``_kept``, numbers of lines dropped and of all).  The row travels as one struct, so its columns can have any names."""
    marks = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **limits)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_own"))
    joined = own.join(marks, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sig")), "left")
    lost = joined.withColumn("_lost", F.when(F.col("keep_words").isNotNull(), lost_positions(F.col("keep_words"))))
    text = F.col(f"_row.`{text_col}`")
    kept = lost.withColumn("_kept", F.when(F.col("_lost").isNull(), text).otherwise(kept_lines(text, F.col("_lost"))))
    return kept, F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long"), line_count(text)


def line_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
