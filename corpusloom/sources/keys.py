"""Which keys have ever been stored: a table of keys in buckets, with a Bloom filter for each of its files.

A batch of keys falls into some buckets; only the filters of their files are read, and only
files whose filter lets a key of the batch pass are opened, to make sure.  So what a batch
reads follows the batch, not the history, and no key is taken for stored that is not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.storage import cut_lineage
from corpusloom.sources.versions import Snapshot, Table, own_path

FILTER = "file string, bits binary"


def places(h1: np.ndarray, h2: np.ndarray, size: int, n: int) -> np.ndarray:
    """``n`` bits of a filter of ``size`` bits for each key, by two hashes; a column for each bit."""
    steps = np.arange(n, dtype=np.uint64)
    return (h1.astype(np.uint64)[:, None] + steps * (h2.astype(np.uint64) | np.uint64(1))[:, None]) % np.uint64(size)


def bloom(h1: np.ndarray, h2: np.ndarray, bits_per_key: int, n: int) -> bytes:
    size = 8 * max(1, -(-len(h1) * bits_per_key // 8))
    bits = np.zeros(size, bool)
    bits[places(h1, h2, size, n).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, h1: np.ndarray, h2: np.ndarray, n: int) -> np.ndarray:
    at = places(h1, h2, 8 * len(bits), n).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (7 - (at & 7)) & 1).all(axis=1)


def hashes() -> tuple:
    return F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")


class KeyStore:
    """Keys (texts) in ``folder``; batches have numbers, and a batch that runs again replaces what its first try stored."""

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 256, bits_per_key: int = 12, bits_set: int = 8):
        self.spark, self.folder, self.bits_per_key, self.bits_set = spark, folder.rstrip("/"), bits_per_key, bits_set
        self.table = Table(spark, f"{self.folder}/keys", "key", "key string", buckets=buckets)
        self.opened: list[str] = []

    def add(self, keys: DataFrame, batch: int) -> None:
        """Store the keys of a batch; nulls are left out."""
        chosen = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key IS NOT NULL").distinct()
        before = self.table.snapshot()
        self._filter(before, self.table.append(chosen, tag=batch))

    def _filter(self, before: Snapshot, after: Snapshot) -> None:
        """Filters for files that are new; each stands with its bucket's others, by the file's path."""
        new = [p for p in after.files if p not in before.files]
        if not new:
            return
        per, n = self.bits_per_key, self.bits_set

        def build(own: pd.DataFrame) -> pd.DataFrame:
            bits = bloom(own["h1"].to_numpy(), own["h2"].to_numpy(), per, n)
            return pd.DataFrame({"file": [own["file"].iloc[0]], "bits": [bits], "_bucket": [own["_bucket"].iloc[0]]})

        rows = self.table.read(after, paths=new).select(own_path().alias("file"), self.table.bucket(F.col("key")).alias("_bucket"), *hashes())
        made = rows.groupBy("file").applyInPandas(build, f"{FILTER}, _bucket int")
        made.write.partitionBy("_bucket").mode("append").parquet(f"{self.folder}/filters")

    def known(self, keys: DataFrame, *, before: int | None = None) -> DataFrame:
        """Those of ``keys`` (its first column, as ``key``) that batches below ``before`` have stored, each once.

        ``opened`` then lists the files of keys that were read.
        """
        asked = cut_lineage(keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn("bucket", self.table.bucket(F.col("key"))))
        snapshot, self.opened = self.table.snapshot(), []
        touched = {r[0] for r in asked.select("bucket").distinct().collect()}
        live = snapshot.paths(touched, before)
        if not live:
            return asked.select("key").limit(0)
        there = {f["bucket"] for f in snapshot.files.values()} & touched
        filters = self.spark.read.schema(FILTER).parquet(*(f"{self.folder}/filters/_bucket={b}" for b in sorted(there)))
        # Old filters of files that no longer count are skipped here; the names come from the log, some for each touched bucket.
        filters = filters.join(F.broadcast(self.spark.createDataFrame([(p, snapshot.files[p]["bucket"]) for p in live], "file string, bucket int")), "file")
        n = self.bits_set

        def test(own: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = own["h1"].to_numpy(), own["h2"].to_numpy()
            hits = [np.flatnonzero(may_hold(b, h1, h2, n)) for b in bits["bits"]]
            at = np.concatenate([*hits, np.zeros(0, int)]).astype(int)
            files = np.repeat(bits["file"].to_numpy(object), [len(x) for x in hits])
            return pd.DataFrame({"h1": h1[at], "h2": h2[at], "file": pd.Series(files, dtype=object)})

        hashed = asked.select("bucket", *hashes())
        maybe = cut_lineage(hashed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "h1 long, h2 long, file string"))
        self.opened = [r[0] for r in maybe.select("file").distinct().collect()]
        stored = self.table.read(snapshot, paths=self.opened)
        return asked.select("key").join(stored, "key", "left_semi")

    def compact(self, *, most_files: int = 8, before: int | None = None) -> None:
        """Buckets of many files, one for each small batch, become one file with one filter."""
        old = self.table.snapshot()
        self._filter(old, self.table.compact(most_files=most_files, before=before))

