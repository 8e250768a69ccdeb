import json
import os
import pathlib
import random
import tempfile
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import feed_stream, feeds

ROBOTS = "host string, body string, status int"


def random_robots(rnd):
    lines = []
    for _ in range(rnd.randint(0, 14)):
        path = "".join(rnd.choice(("/", "a", "b", "private", "%41", "?x=", "c d", "é", "%2F")) for _ in range(rnd.randint(0, 4)))
        # The standard parser takes what follows two slashes for a host.
        path = "a" if "//" in f"/{path}".replace("%2F", "/") else path
        lines.append(rnd.choice(("User-agent: *", "user-agent: Loom", "User-Agent:LOOMBOT/2", "User-agent: other", f"Disallow: {path}", f"Disallow: /{path}", f"Allow: /{path} # why", f" Allow : /{path}", "", "# only", "Crawl-delay: 3", "nonsense", "Sitemap: http://x/", "Disallow:", "  ")))
    return rnd.choice(("\n", "\r\n")).join(lines)


@pytest.mark.parametrize("agent", ["*", "LoomBot/1.0"])
def test_robots_rules_are_those_of_the_standard_parser(spark, agent):
    rnd = random.Random(7)
    bodies = {f"h{k}.vn": random_robots(rnd) for k in range(120)}
    paths = ["", "/", "/a", "/ab", "/private/a", "/private?x=1", "/A/b", "/%41/b", "/c d", "/c%20d", "/b/é", "/b/%C3%A9", "/a?", "/a#b", "?x=", "/b/a/b"]
    urls = [(f"https://{h}{p}",) for h in bodies for p in paths] + [(f"https://{h}/{rnd.choice('ab')}{rnd.choice(('/a', 'private', '?x='))}",) for h in bodies]
    got = feeds.robots_allow(spark.createDataFrame(urls, "url string"), spark.createDataFrame([(h, b, 200) for h, b in bodies.items()], ROBOTS), agent=agent).collect()
    for r in got:
        parser = RobotFileParser()
        parser.parse(bodies[r["url"].split("/")[2].split("?")[0]].splitlines())
        assert r["allowed"] == parser.can_fetch(agent, r["url"]), (r["url"], bodies[r["url"].split("/")[2].split("?")[0]])
    assert {True, False} == {r["allowed"] for r in got}


def test_the_longest_robots_rule_and_its_patterns(spark):
    body = "User-agent: *\nDisallow: /\nAllow: /open/\nDisallow: /open/*/secret\nAllow: /*.html$\nDisallow: /same\nAllow: /same"
    want = {"/": False, "/x": False, "/open/x": True, "/open/y/secret/z": False, "/x.html": True, "/x.html?q": False, "/same": True, "/open/a.html": True, "/a+b.htmlx": False}
    urls = spark.createDataFrame([(f"https://a.vn{p}",) for p in want], "url string")
    got = feeds.robots_allow(urls, spark.createDataFrame([("a.vn", body, 200)], ROBOTS), longest=True).collect()
    assert {r["url"][12:]: r["allowed"] for r in got} == want
    rules = feeds.robots_rules(spark.createDataFrame([("a", None, 200), ("b", body, 404), ("c", "", 200)], ROBOTS)).collect()
    assert [r["rules"] for r in rules] == [None, None, []]


def test_robots_need_no_python_worker(spark):
    urls = spark.createDataFrame([("https://a.vn/x",)], "url string")
    plan = feeds.robots_allow(urls, spark.createDataFrame([("a.vn", "User-agent: *\nDisallow: /", 200)], ROBOTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


CLOCK = os.path.join(tempfile.gettempdir(), f"loom-test-clock-{os.getuid()}")


def clock():
    """The time stands in a file, so that this session and Spark's reader see the same."""
    with open(CLOCK) as f:
        return float(f.read())


def fetch(address):
    if address.endswith("down"):
        raise OSError("no answer")
    return 200, f"<rss><channel><item><title>T {address[-1]}</title><link>https://a.vn/{address[-1]}</link></item></channel></rss>"


def test_feeds_are_polled_in_rounds(spark, tmp_path):
    at = lambda t: pathlib.Path(CLOCK).write_text(str(t))
    feed_stream.register(spark)
    options = {"feeds": json.dumps([["a", "https://a.vn/1"], ["a", "https://a.vn/2"], ["b", "https://b.vn/down"]]), "fetch": "tests.test_discovery:fetch", "clock": "tests.test_discovery:clock", "interval": "100", "since": "1000", "tries": "2"}
    seen = []

    def run():
        got = spark.readStream.format("feeds").options(**options).load()
        query = got.writeStream.foreachBatch(lambda df, n: seen.append(sorted((r["source_id"], r["feed"], r["status"], r["round"]) for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()

    one = lambda n: [("a", "https://a.vn/1", 200, n), ("a", "https://a.vn/2", 200, n), ("b", "https://b.vn/down", None, n)]
    at(900)
    run()
    assert [b for b in seen if b] == []
    at(1001)
    run()
    run()
    assert [b for b in seen if b] == [one(1)]
    # Rounds 2 to 5 fell due while nothing ran.
    at(1450)
    run()
    assert [b for b in seen if b] == [one(1), one(5)]


def test_feeds_are_read_once(spark):
    feed_stream.register(spark)
    rows = spark.read.format("feeds").options(feeds=json.dumps([["a", "https://a.vn/1"], ["b", "https://b.vn/down"]]), fetch="tests.test_discovery:fetch").load()
    assert {(r["feed"], r["status"], r["error"]) for r in rows.collect()} == {("https://a.vn/1", 200, None), ("https://b.vn/down", None, "OSError: no answer")}
    items = feeds.candidates(feeds.parse_feeds(rows)).collect()
    assert [(r["source_id"], r["title"], r["url"]) for r in items] == [("a", "T 1", "https://a.vn/1")]
    with pytest.raises(Exception, match="no_such"):
        spark.read.format("feeds").options(feeds="[]", fetch="no_such:f").load().collect()


def test_a_list_of_feeds_in_files(spark, tmp_path):
    feed_stream.register(spark)
    spark.createDataFrame([(f"s{k}", f"https://a{k % 3}.vn/{k}") for k in range(9)], "source_id string, feed string").repartition(3).write.parquet(f"file://{tmp_path}/list")
    rows = spark.read.format("feeds").options(feeds=f"file://{tmp_path}/list", fetch="tests.test_discovery:fetch").load()
    assert rows.rdd.getNumPartitions() == 3 and {r["source_id"] for r in rows.where("status = 200").collect()} == {f"s{k}" for k in range(9)}


def test_stored_documents_as_a_web(spark, tmp_path):
    spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1).write.text(f"file://{tmp_path}/doc")
    spark.createDataFrame([("a/1", "x"), ("b", "y")], "name string, text string").write.parquet(f"file://{tmp_path}/rows/bucket=3")
    assert [feed_stream.stored(f"file://{tmp_path}/rows/bucket=3#{n}") for n in ("a/1", "b", "c")] == [(200, "x"), (200, "y"), (404, "")]
    assert feed_stream.stored(f"file://{tmp_path}/doc") == (200, "one\ntwo\n") and feed_stream.stored(f"file://{tmp_path}/none") == (404, "")


def test_missed_rounds_of_a_schedule_are_one():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    due = feed_stream.rounds(10, clock=lambda: now[0], sleep=sleep)
    took = {0: 3, 1: 25, 3: 1, 4: 0}
    got = []
    for _ in range(4):
        n = next(due)
        got.append((n, now[0]))
        now[0] += took[n]
    # The second round ran over those of 20 and 30, which are made up for at once.
    assert got == [(0, 0.0), (1, 10.0), (3, 35.0), (4, 40.0)] and slept == [7.0, 4.0]
