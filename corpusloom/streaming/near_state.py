"""Near duplicates of a stream in order of event time, with two days of kept hashes as state.

A row is kept unless a kept row, fetched not over two days before it, has a hash at three or
fewer differing bits.  Files may come in any order: rows wait in state until the watermark
has passed them, so what is released comes in order of time, batch after batch, and the
decisions are those of ``keep_first`` over all rows at once.

One stateful operator serves both parts.  Groups without a band hold the waiting rows, dealt
by their id.  Groups of a band, dealt by its 16 bits, hold the hashes of kept rows with
the time of the last kept one, and name, for each hash whose rows are released now, the last
time at which a kept row was near it.  A timer drops kept hashes when the watermark is two
days past them, so the state follows two days of kept hashes and the rows that wait.

Copies make no pairs and no hot group: each partition asks a band once for each hash it
holds, and the rows themselves go by id.  The rows that no earlier batch decides are decided
among themselves by ``keep_first``; what is kept comes back to the bands as a second source of
the same query.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from corpusloom.operators.dedupe import BAND_BITS, BANDS, keep_first
from corpusloom.sources.storage import cut_lineage

#: A batch writes what it changed in the state, not the whole state; no disk is set aside for each partition beforehand.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # For all stores of an executor together; else each column of each store may fill two buffers of 64 MB.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Of the 48 bits outside a band: three differing bits leave one of four pieces equal.
PIECES, PIECE_BITS = 4, 12
FEEDBACK = "h long, t long, at timestamp"
#: kind: row (of a group without a band), ask and kept (of a band).
MESSAGE = "band int, key long, kind string, id long, h long, t long, until long, at timestamp"
#: kind: row (released), hit (``t``: when a row near the hash was last kept), seen (the newest time of a batch); ``mark`` is the watermark in ms.
FOUND = "kind string, id long, h long, t long, mark long"


class KeptState(StatefulProcessor):
    """State of a group is arrays of longs: waiting rows ``(id, h, t)``, or hashes asked for ``(h, first, last)`` and kept ones ``(h, t)``.

    Times are in microseconds since 1970, timers and watermarks in milliseconds; what is earlier than the watermark is released.
    """

    def __init__(self, span: int, threshold: int):
        self.span, self.threshold = span, threshold

    def init(self, handle) -> None:
        self.handle = handle
        self.states = {name: handle.getValueState(name, "longs binary") for name in ("waiting", "asked", "kept")}

    def _get(self, name: str) -> np.ndarray:
        found = self.states[name].get()
        return np.frombuffer(found[0] if found else b"", np.int64).reshape(-1, 2 if name == "kept" else 3)

    def _put(self, name: str, rows: np.ndarray) -> None:
        self.states[name].update((np.ascontiguousarray(rows).tobytes(),)) if len(rows) else self.states[name].clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, newest, times = pd.concat(rows, ignore_index=True), [], []
        for kind, part in own.groupby("kind"):
            if kind == "row":
                self._put("waiting", np.vstack((self._get("waiting"), part[["id", "h", "t"]].to_numpy())))
                newest.append(("seen", None, None, int(part["t"].max()), timerValues.getCurrentWatermarkInMs()))
            elif kind == "ask":
                self._put("asked", _merged(np.vstack((self._get("asked"), part[["h", "t", "until"]].to_numpy()))))
            else:
                self._put("kept", _merged(np.vstack((self._get("kept"), part[["h", "t"]].to_numpy()))))
                times.append(int(part["t"].min()) + self.span)
            if kind != "kept":
                times.append(int(part["t"].min()))
        self._wake(times, 0)
        yield _found(newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if key[0] < 0:
            rows = self._get("waiting")
            free = rows[:, 2] // 1000 < mark
            self._put("waiting", rows[~free])
            self._wake(rows[~free, 2].tolist(), mark)
            yield _found([("row", *r, mark) for r in rows[free].tolist()])
        else:
            yield _found(self._hits(key[0], mark))

    def _hits(self, band: int, mark: int) -> list[tuple]:
        kept, asked = self._get("kept"), self._get("asked")
        free = asked[asked[:, 1] // 1000 < mark, 0]
        last = last_near(free, kept, band, self.threshold)
        # Rows of a hash wait at some times from its first to its last, so it is looked up at each release until then.
        asked = asked[asked[:, 2] // 1000 >= mark]
        kept = kept[(kept[:, 1] + self.span) // 1000 >= mark]
        self._put("asked", asked)
        self._put("kept", kept)
        self._wake([*asked[:, 1].tolist(), *(kept[:, 1] + self.span).tolist()], mark)
        return [("hit", None, h, t, mark) for h, t in zip(free.tolist(), last.tolist(), strict=True) if t >= 0]

    def _wake(self, times: list[int], mark: int) -> None:
        if times:
            self.handle.registerTimer(max(min(times) // 1000, mark))


def _merged(rows: np.ndarray) -> np.ndarray:
    """One row for each hash, which is the first column, with the least of the second column where there are three, and the most of the last."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else np.zeros(0, int)
    if not len(first):
        return rows
    most = np.maximum.reduceat(rows[:, -1], first)
    return np.column_stack((rows[first, 0], most) if rows.shape[1] == 2 else (rows[first, 0], np.minimum.reduceat(rows[:, 1], first), most))


def band_key(h: np.ndarray, band: int) -> np.ndarray:
    return (h.astype(np.uint64) >> np.uint64(BAND_BITS * band) & np.uint64(0xFFFF)).astype(np.int64)


def last_near(asked: np.ndarray, kept: np.ndarray, band: int, threshold: int, most: int = 1 << 18) -> np.ndarray:
    """For each hash of ``asked`` the most ``t`` of ``kept(h, t)`` that shares its band and is near, else -1.

    Texts of one kind share many bits, so a band's number can have thousands of hashes on both
    sides.  Near ones also agree in one of four pieces of the other 48 bits; those that do are compared
    ``most`` pairs at a time, or all of one hash, so memory follows the hashes and not their pairs.
    """
    out = np.full(len(asked), -1, np.int64)
    for piece in range(PIECES):
        keys, own = _piece_key(kept[:, 0], band, piece), _piece_key(asked, band, piece)
        order = np.argsort(keys, kind="stable")
        lo, hi = np.searchsorted(keys, own, sorter=order), np.searchsorted(keys, own, "right", sorter=order)
        ends, begin = np.cumsum(hi - lo), 0
        while begin < len(asked):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
            n = (hi - lo)[begin:end]
            asking = np.repeat(np.arange(begin, end), n)
            held = order[np.arange(len(asking)) + np.repeat(lo[begin:end] - (ends[begin:end] - n - done), n)]
            near = np.bitwise_count((asked[asking] ^ kept[held, 0]).astype(np.uint64)) <= threshold
            np.maximum.at(out, asking[near], kept[held[near], 1])
            begin = end
    return out


def _piece_key(h: np.ndarray, band: int, piece: int) -> np.ndarray:
    """The bits of a band and of a piece of the rest, which is counted from the band upwards and around."""
    h = h.astype(np.uint64)
    turned = h >> np.uint64(BAND_BITS * band) | h << np.uint64(64 - BAND_BITS * band) if band else h
    return turned & np.uint64(0xFFFF) | (turned >> np.uint64(BAND_BITS + PIECE_BITS * piece) & np.uint64((1 << PIECE_BITS) - 1)) << np.uint64(BAND_BITS)


def _found(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["kind", "id", "h", "t", "mark"])
    return made.astype({"kind": object, "id": "Int64", "h": "Int64", "t": "Int64", "mark": "Int64"})


def _messages(groups: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows as messages: each to a group by its id, each different hash of a batch once to its bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b for b in batches if len(b)):
            rows, kept = batch[~batch["back"]], batch[batch["back"]]
            parts = [rows.assign(band=-1, key=rows["id"] % groups, kind="row", until=rows["t"])]
            # A hash waits from its first row to its last; the message counts as late only if both are.
            asks = rows.groupby("h", as_index=False).agg(t=("t", "min"), until=("t", "max"), at=("at", "max"), id=("id", "min"))
            for kind, own in (("ask", asks), ("kept", kept.assign(until=kept["t"]))):
                parts += [own.assign(band=k, key=band_key(own["h"].to_numpy("int64"), k) % groups, kind=kind) for k in range(BANDS)]
            yield pd.concat([p for p in parts if len(p)], ignore_index=True)[["band", "key", "kind", "id", "h", "t", "until", "at"]].astype({"kind": object})

    return run


def near_keep_stream(rows: DataFrame, folder: str, checkpoint: str, *, id_col: str = "id", hash_col: str = "simhash", time_col: str = "fetched_at", within_days: float = 2.0, threshold: int = 3, late: str = "1 day", groups: int = 64, partitions: int | None = None, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that writes ``(id, h, t, kept)`` of the stream ``rows`` to ``folder/decided``, a sub-folder for each batch.

    A row is decided when rows ``late`` newer than it have been seen, and rows that come
    later than that are left out, as by any watermark; rows without a time or a hash are
    too, and have nothing to be compared.  Ids are whole numbers.  State is dealt into
    ``groups`` for the rows and as many for each band; a batch reads those it touches, so a
    long stream wants more of them (65,536 at most) and a short one fewer.  The groups lie in
    ``partitions`` parts, of which every batch starts a Python worker and opens a store: twice
    the cores unless given, and no more than the session's shuffle partitions; a checkpoint keeps the number
    it was made with.  Stop the query, or wait by ``settle``; started again with the same folders it goes on.
    """
    if threshold >= BANDS:
        raise ValueError("four bands guarantee at most 3 differing bits")
    spark, span = rows.sparkSession, int(within_days * 86_400_000_000)
    spark.createDataFrame([], FEEDBACK).write.mode("append").parquet(f"{folder}/kept/batch=none")
    back = spark.readStream.schema(FEEDBACK).parquet(f"{folder}/kept/*").select(F.lit(0).cast("long").alias("id"), "h", "t", "at", F.lit(True).alias("back"))
    at = F.col(time_col).cast("timestamp")
    fresh = rows.select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("h"), F.unix_micros(at).alias("t"), at.alias("at"), F.lit(False).alias("back")).where("id IS NOT NULL AND h IS NOT NULL AND t IS NOT NULL")
    sent = fresh.unionByName(back).mapInPandas(_messages(groups), MESSAGE).withWatermark("at", late)
    found = sent.groupBy("band", "key").transformWithStateInPandas(KeptState(span, threshold), FOUND, "Append", "EventTime")

    def step(batch: DataFrame, number: int) -> None:
        # By way of files, whose sizes the optimizer knows; of a checkpoint of a stream's batch it would think that it is small enough to broadcast.
        # They are read by the caller's session: in a batch's own one adaptive execution is off, where each of many small shuffles is as many tasks as the state has partitions.
        batch.write.mode("overwrite").parquet(f"{folder}/found")
        held = spark.read.schema(FOUND).parquet(f"{folder}/found")
        news = held.agg(F.max(F.when(F.col("kind") == "seen", F.floor(F.col("t") / 1000))).alias("seen"), F.max("mark").alias("mark"), F.count_if(F.col("kind") == "row").alias("n")).first()
        if not news["n"]:
            return
        released = held.where("kind = 'row'").select("id", "h", "t")
        last = held.where("kind = 'hit'").groupBy("h").agg(F.max("t").alias("last"))
        left = released.join(last, "h", "left").where(F.col("last").isNull() | (F.col("t") > F.col("last") + span))
        kept = keep_first(left.select("id", "h", F.timestamp_micros("t").alias("at")), hash_col="h", time_col="at", within_days=within_days, threshold=threshold)
        decided = cut_lineage(released.join(kept.where("kept"), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
        decided.write.mode("overwrite").parquet(f"{folder}/decided/batch={number}")
        # Later than any watermark that this batch can lead to, or the bands would take it for late.
        stamp = F.timestamp_millis(F.lit(max(news["seen"] or 0, news["mark"] + 1)))
        classes = decided.where("kept").groupBy("h").agg(F.max("t").alias("t"))
        classes.withColumn("at", stamp).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        if on_batch:
            on_batch(decided, number)

    parts = partitions or min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(parts)}
    known = {name: spark.conf.get(name, None) for name in settings}
    # A query keeps the settings that it was started with.
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return found.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).start()
    finally:
        for name, value in known.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def settle(query: StreamingQuery, quiet: int = 2) -> None:
    """Wait until ``quiet`` looks in a row find nothing new to do, then stop the query."""
    still, seen = 0, None
    while still < quiet:
        query.processAllAvailable()
        last = query.lastProgress
        now = None if last is None else last["batchId"]
        still, seen = (still + 1, seen) if now == seen and not query.status["isTriggerActive"] else (0, now)
    query.stop()
