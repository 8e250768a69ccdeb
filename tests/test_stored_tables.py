import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import labelling
from corpusloom.sources import keys, storage, versions
from corpusloom.streaming import incremental

ROW = "k long, v string, w long"


@pytest.fixture
def table(spark, tmp_path):
    return versions.Table(spark, f"file://{tmp_path}/t", "k", ROW, buckets=8)


def rows(spark, ids, v="a", w=1):
    return spark.createDataFrame([(i, f"{v}{i}", w) for i in ids], ROW)


def held(df):
    return {r["k"]: (r["v"], r["w"]) for r in df.collect()}


def test_versions_are_whole_and_stay_readable(spark, table):
    assert table.read().collect() == [] and table.snapshot().version == 0
    first = table.append(rows(spark, range(100)))
    second = table.merge(spark.createDataFrame([(5, "new"), (200, "more")], "k long, v string"))
    third = table.delete(spark.createDataFrame([(7,), (999,)], "k long"))
    want = {i: (f"a{i}", 1) for i in range(100)}
    assert held(table.read(first)) == want
    want |= {5: ("new", 1), 200: ("more", None)}
    assert held(table.read(second)) == held(table.read(table.snapshot(2))) == want
    del want[7]
    assert held(table.read()) == held(table.read(third)) == want and table.snapshot().version == 3
    with pytest.raises(ValueError, match="no version 9"):
        table.snapshot(9)


def test_a_merge_writes_only_files_that_hold_its_keys(spark, table):
    base = table.append(rows(spark, range(400)))
    assert {f["bucket"] for f in base.files.values()} == set(range(8))
    after = table.merge(rows(spark, [3], "b"))
    [b] = table.buckets_of(rows(spark, [3]))
    assert [base.files[p]["bucket"] for p in base.files.keys() - after.files.keys()] == [b] and len(after.files) == 8
    assert held(table.read(after, buckets={b}))[3] == ("b3", 1)


def test_two_writers_that_collide_leave_one_winner(spark, table):
    table.append(rows(spark, range(50)))
    base = table.snapshot()
    mine = table._write(rows(spark, [1], "mine"), None)
    table.merge(rows(spark, [1], "theirs"))
    with pytest.raises(versions.Conflict):
        table.commit(base, mine, base.paths(table.buckets_of(rows(spark, [1]))), touched=table.buckets_of(rows(spark, [1])))
    assert held(table.read())[1] == ("theirs1", 1) and len(held(table.read())) == 50
    # A writer that loses tries again on the new version; both changes of different keys stand.
    threads = [threading.Thread(target=lambda n=n: table.merge(rows(spark, [n], "t"), tries=20)) for n in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = held(table.read())
    assert {n: got[n][0] for n in range(2)} == {n: f"t{n}" for n in range(2)} and len(got) == 50


def test_only_one_claims_a_version(spark, table):
    table.append(rows(spark, [1]))
    won = [table._claim(2, {"come": {}, "gone": []}) for _ in range(3)]
    assert won == [True, False, False]


def test_a_rename_decides_where_there_are_no_links(spark, table, monkeypatch):
    table.append(rows(spark, [1]))

    class Shared:
        """The table's file system under another name, as a cluster's."""

        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "shared"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    real = table._fs()
    monkeypatch.setattr(table, "_fs", lambda: Shared(real))
    assert [table._claim(2, {"come": {}, "gone": []}) for _ in range(2)] == [True, False] and table.snapshot().version == 2


def test_what_is_deleted_is_in_no_file(spark, table, tmp_path):
    table.append(rows(spark, range(100)))
    table.append(rows(spark, range(100, 200)))
    table.delete(rows(spark, range(0, 200, 2)).select("k"))
    on_disk = lambda: {r["k"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t/data").select("k").collect()}
    assert on_disk() == set(range(200))
    assert table.vacuum() > 0 and on_disk() == set(range(1, 200, 2)) == set(held(table.read()))
    assert table.vacuum() == 0


def test_small_files_are_put_together(spark, table, monkeypatch):
    monkeypatch.setattr(versions, "WHOLE_EVERY", 4)
    for n in range(10):
        table.append(rows(spark, [n]), tag=n)
    assert len(table.snapshot().files) == 10
    after = table.compact(most_files=1, before=8)
    assert len(after.files) < 10 and held(table.read()) == {n: (f"a{n}", 1) for n in range(10)}
    assert set(held(table.read(before=8))) == set(range(8))
    # The log holds the whole list now and then, and reads the same before and after.
    assert after.version == 11 and all(held(table.read(table.snapshot(v))) == {n: (f"a{n}", 1) for n in range(v)} for v in (3, 4, 5, 9))
    table.append(rows(spark, [100]), tag=9)
    assert 9 not in held(table.read()) and 100 in held(table.read())


def test_blooms_forget_nothing():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, 20_000), dtype=np.int64)
    bits = keys.bloom(h1[:10_000], h2[:10_000], 12, 8)
    hit = keys.may_hold(bits, h1, h2, 8)
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.01 and len(bits) == 15_000
    assert not keys.may_hold(keys.bloom(h1[:0], h2[:0], 12, 8), h1, h2, 8).any()


def test_a_batch_opens_what_may_hold_its_keys(spark, tmp_path):
    store = keys.KeyStore(spark, f"file://{tmp_path}/k", buckets=32)
    names = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("key"), "id").alias("name"))
    assert store.known(names(0, 5)).collect() == []
    for batch in range(3):
        store.add(names(1000 * batch, 1000 * batch + 1000).unionByName(spark.createDataFrame([(None,)], "name string")), batch)
    found = lambda df, **kw: {r["key"] for r in store.known(df, **kw).collect()}
    assert found(names(2990, 3010)) == {f"key{k}" for k in range(2990, 3000)} and len(store.opened) <= 12
    assert found(names(100_000, 100_010)) == set() and len(store.opened) <= 2
    assert found(names(0, 3100)) == {f"key{k}" for k in range(3000)} and len(store.opened) == 96
    assert found(names(1990, 2010), before=2) == {f"key{k}" for k in range(1990, 2000)}
    # A batch that runs again replaces its first try.
    store.add(names(5000, 5010), 2)
    assert found(names(1990, 5100)) == {f"key{k}" for k in (*range(1990, 2000), *range(5000, 5010))}
    store.compact(most_files=1)
    assert found(names(1990, 5100)) == {f"key{k}" for k in (*range(1990, 2000), *range(5000, 5010))}
    assert found(names(7, 8)) == {"key7"} and len(store.opened) == 1


def test_streams_skip_what_is_stored(spark, tmp_path):
    for k, ids in enumerate(([1, 2, 3], [3, 4, 5], [6])):
        spark.createDataFrame([(10 * k + i, f"Text {i}") for i in ids], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        incremental.dedupe_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [f"Text {i}" for i in range(1, 7)]


def test_update_of_files_and_of_a_database(spark, tmp_path):
    old = spark.createDataFrame([(i, "cleaned", f"t{i}") for i in range(40)], "id int, status string, title string")
    new = spark.createDataFrame([(3, "summarized"), (30, "summarized"), (99, "summarized")], "id int, status string")
    for place in (f"jdbc:derby:{tmp_path}/db;create=true", str(tmp_path / "tables")):
        storage.save(old.repartitionByRange(4, "id"), place, "articles", mode="overwrite")
        storage.update(spark, new, place, "articles", "id")
        got = {r[0]: (r[1], r[2]) for r in storage.load(spark, place, "articles").collect()}
        assert got == {i: ("summarized" if i in (3, 30) else "cleaned", f"t{i}") for i in range(40)}
        storage.update(spark, new.limit(0), place, "articles", "id")


def test_calls_run_at_the_same_time(spark):
    import time

    def call(prompt):
        time.sleep(0.2)
        if prompt == "p3":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([(f"p{k}",) for k in range(20)], "prompt string").coalesce(1)
    began = time.time()
    got = labelling.generate(df, call, concurrency=10).collect()
    assert [r["reply"] for r in got] == [None if k == 3 else f"P{k}" for k in range(20)] and got[3]["call_error"] == "ValueError: no"
    assert time.time() - began < 3
