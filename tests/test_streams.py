import datetime as dt
import random

import numpy as np

from corpusloom.operators import dedupe
from corpusloom.streaming import near_state

NOW = dt.datetime(2024, 1, 10)
ROW = "id long, simhash long, fetched_at timestamp"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashes(seed, n=120, hours=200, far=6):
    rnd, rows = random.Random(seed), []
    bases = [rnd.getrandbits(64) for _ in range(far)] + [0]
    for i in range(n):
        h = rnd.choice(bases)
        for _ in range(rnd.randint(0, 4)):
            h ^= 1 << rnd.randrange(64)
        rows.append(((1 << 60) + i, signed(h), NOW + dt.timedelta(hours=rnd.randint(0, hours))))
    return rows


def test_last_kept_near_a_hash():
    rows = hashes(4, 300)
    kept = np.array([(h, t.timestamp()) for _, h, t in rows[:200]], np.int64)
    asked = np.array([h for _, h, _ in rows[200:]], np.int64)
    got = np.max([near_state.last_near(asked, kept, band, 3) for band in range(4)], axis=0)
    want = [max((t for g, t in kept.tolist() if ((g ^ h) & (1 << 64) - 1).bit_count() <= 3), default=-1) for h in asked.tolist()]
    assert got.tolist() == want and -1 in want and max(want) > 0
    assert near_state.last_near(asked[:0], kept, 0, 3).size == 0 and near_state.last_near(asked, kept[:0], 0, 3).max() == -1


def test_a_band_that_many_hashes_share_is_compared_in_stretches():
    import tracemalloc

    rnd = np.random.default_rng(5)
    # All share band 2; every tenth kept hash is one to three bits from an asked one, by any bits outside the band.
    asked, far = (rnd.integers(0, 1 << 63, n, np.uint64) & ~np.uint64(0xFFFF << 32) | np.uint64(77 << 32) for n in (4000, 4000))
    for k in range(0, 4000, 10):
        far[k] = asked[k] ^ np.bitwise_or.reduce(np.uint64(1) << rnd.choice([*range(32), *range(48, 64)], k // 10 % 3 + 1, replace=False).astype(np.uint64))
    asked, kept = asked.view(np.int64), np.column_stack((far.view(np.int64), rnd.permutation(4000)))
    want = [int(max(kept[np.bitwise_count((kept[:, 0] ^ h).view(np.uint64)) <= 3, 1], default=-1)) for h in asked]
    tracemalloc.start()
    got = near_state.last_near(asked, kept, 2, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All pairs at once would be 16 million.
    assert got.tolist() == want and sum(t >= 0 for t in want) >= 400 and peak < 32 << 20
    # Nor does a piece that all share take more, or one stretch for each pair other results.
    assert near_state.last_near(np.full(4000, 7), np.column_stack((np.full(4000, 7), np.arange(4000))), 2, 3).tolist() == [3999] * 4000
    assert near_state.last_near(asked[:100], kept, 2, 3, most=1).tolist() == want[:100]


def test_a_stream_in_any_order_keeps_what_a_batch_keeps(spark, tmp_path):
    rows = sorted(hashes(1), key=lambda r: r[2])
    odd = [(None, 1, NOW), (1, None, NOW), (2, 1, None)]
    parts = [rows[k : k + 30] for k in range(0, 120, 30)]
    random.Random(2).shuffle(parts[1])
    put = lambda k, part: spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    start = lambda: near_state.near_keep_stream(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in/*"), str(tmp_path), f"{tmp_path}/state", late="10 days", groups=4)
    put(1, parts[1] + odd)
    query = start()
    query.processAllAvailable()
    put(0, parts[0])
    near_state.settle(query)
    # Started again it goes on where it was; a beat far ahead lets all rows go, and a second one the first.
    query = start()
    for k in (3, 2):
        put(k, parts[k])
        query.processAllAvailable()
    for k, days in ((4, 60), (5, 120)):
        put(k, [(k, 12345, NOW + dt.timedelta(days))])
        query.processAllAvailable()
    near_state.settle(query)
    decided = {r["id"]: r["kept"] for r in spark.read.parquet(f"{tmp_path}/decided").collect()}
    want = {r["id"]: r["kept"] for r in dedupe.keep_first(spark.createDataFrame(rows, ROW)).collect()}
    assert decided == want | {4: True} and set(want.values()) == {True, False}
    # State held rows that waited and two days of hashes; now it holds the second beat, which waits, and the first, which is kept.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 2 * held[-1] and held[-1] <= 10


def test_copies_ask_once_and_make_one_row_of_state(spark):
    import pandas as pd

    rows = pd.DataFrame({"id": range(1000), "h": 7, "t": range(1000), "at": pd.Timestamp("2024-01-01"), "back": False})
    [sent] = near_state._messages(8)(iter([rows, rows[:0]]))
    assert (sent["kind"] == "row").sum() == 1000 and (sent["kind"] == "ask").sum() == 4
    assert set(map(tuple, sent[sent["kind"] == "ask"][["h", "t", "until"]].to_numpy().tolist())) == {(7, 0, 999)}
    assert near_state._merged(np.array([[7, 3, 9], [5, 1, 1], [7, 2, 4]])).tolist() == [[5, 1, 1], [7, 2, 9]]


def test_decisions_run_adaptively_and_state_has_the_partitions_of_the_cores(spark, tmp_path):
    spark.createDataFrame(hashes(3, 40), ROW).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    look = lambda decided, number: seen.append((decided.sparkSession.conf.get("spark.sql.adaptive.enabled"), decided.rdd.getNumPartitions()))
    try:
        query = near_state.near_keep_stream(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in/*"), str(tmp_path), f"{tmp_path}/state", late="1 second", groups=4, on_batch=look)
        query.processAllAvailable()
        near_state.settle(query)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "31"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # A batch's own session is not adaptive, and there the few rows would come in 31 parts.
    assert seen and {adaptive for adaptive, _ in seen} == {"true"} and max(parts for _, parts in seen) < 31
    assert {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress if p["stateOperators"]} == {8}
