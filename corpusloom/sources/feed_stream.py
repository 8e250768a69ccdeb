"""Feeds as a source of Spark: ``spark.readStream.format("feeds")`` polls them, ``spark.read.format("feeds")`` reads them once.

Options: ``feeds``, a JSON list of ``[source_id, address]``, or the address of a folder of
Parquet files with these two columns, each of which is a task, so that a long list passes
no one place; ``fetch``, ``module:function``
that gives (status, text) of an address; ``interval``, the seconds between two rounds, and
``since``, the time in seconds since 1970 at which the first is due (now, if not given);
``delay``, ``tries`` and ``wait`` as for ``feeds.Polite``; ``clock``, ``module:function``
that tells the time.

The offset is the number of rounds that are due.  Rounds that nobody was there to run are
run as one, and a round that failed is run again, since it is in the query's log.  Of a
list, the feeds of one host are one task, so that calls keep their distance; who writes a
folder keeps them in one file.
"""

from __future__ import annotations

import functools
import importlib
import json
import math
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusloom.sources.feeds import Polite

FEEDS = "source_id string, feed string, xml string, status int, error string, round long"


def imported(target: str) -> Callable:
    module, function = target.split(":", 1)
    return getattr(importlib.import_module(module), function)


def host_of(address: str) -> str:
    return address.split("://", 1)[-1].split("/", 1)[0].lower()


class SomeFeeds(InputPartition):
    """Feeds, or the file that lists them."""

    def __init__(self, number: int, feeds: list[tuple[str, str]], file: str | None = None):
        self.number, self.feeds, self.file = number, feeds, file


def opened(address: str):
    """(file system, path) of an address that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def files_of(address: str) -> list[str]:
    from pyarrow import fs

    system, path = opened(address)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._")


class _Feeds:
    """What both readers do."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        imported(options["fetch"])

    def parts(self, number: int) -> list[SomeFeeds]:
        listed = self.options["feeds"]
        if not listed.lstrip().startswith("["):
            return [SomeFeeds(number, [], file) for file in files_of(listed)]
        hosts: dict[str, list[tuple[str, str]]] = {}
        for source, feed in json.loads(listed):
            hosts.setdefault(host_of(feed), []).append((source, feed))
        return [SomeFeeds(number, own) for own in hosts.values()]

    def read(self, partition: SomeFeeds) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        feeds = partition.feeds
        if partition.file:
            held = pq.read_table(partition.file, filesystem=opened(self.options["feeds"])[0], columns=["source_id", "feed"])
            feeds = zip(held["source_id"].to_pylist(), held["feed"].to_pylist(), strict=True)
        number = lambda name, default: float(self.options.get(name, default))
        call = Polite(imported(self.options["fetch"]), tries=int(number("tries", 3)), interval=number("delay", 0), wait=number("wait", 0))
        for source, feed in feeds:
            status, body, error = call(feed, host_of(feed))
            yield source, feed, body if status == 200 else None, status, error, partition.number


class FeedReader(_Feeds, DataSourceReader):
    def partitions(self) -> list[SomeFeeds]:
        return self.parts(1)


class FeedStreamReader(_Feeds, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.clock = imported(options["clock"]) if "clock" in options else time.time
        self.interval = float(options.get("interval", 1800))
        self.since = float(options["since"]) if "since" in options else self.clock()

    def initialOffset(self) -> dict:
        return {"rounds": 0}

    def latestOffset(self) -> dict:
        """One round is due at ``since``, and another after each interval."""
        return {"rounds": max(0, math.floor((self.clock() - self.since) / self.interval) + 1)}

    def partitions(self, start: dict, end: dict) -> list[SomeFeeds]:
        return self.parts(end["rounds"]) if end["rounds"] > start["rounds"] else []


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FEEDS

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Let a session read ``format("feeds")``."""
    spark.dataSource.register(FeedSource)


@functools.lru_cache(maxsize=2)
def _named(folder: str) -> dict[str, str]:
    """The texts of a folder of Parquet files by their names."""
    import pyarrow.parquet as pq

    system, _ = opened(folder)
    held = [pq.read_table(f, filesystem=system, columns=["name", "text"], partitioning=None) for f in files_of(folder)]
    return {n: t for part in held for n, t in zip(part["name"].to_pylist(), part["text"].to_pylist(), strict=True)}


def stored(address: str) -> tuple[int, str]:
    """A fetcher of kept documents: ``folder`` of text files, or ``folder#name`` for a row of its Parquet files ``(name, text)``.

    Addresses are ``file:``, ``hdfs:``, and what else pyarrow opens.  A folder of rows is read
    once for the addresses in it that follow each other, so it should fit a task.
    """
    folder, _, name = address.partition("#")
    if name:
        text = _named(folder).get(name)
        return (404, "") if text is None else (200, text)
    system, _ = opened(folder)
    found = files_of(folder)
    return (200, "\n".join(system.open_input_file(f).read().decode() for f in found)) if found else (404, "")


def rounds(interval: float, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[int]:
    """Numbers of the rounds of a schedule, each when it is due; those missed while the caller was busy are one, given at once."""
    began, number = clock(), 0
    while True:
        yield number
        due = math.floor((clock() - began) / interval) if interval > 0 else number + 1
        if due <= number:
            sleep(began + (number + 1) * interval - clock())
            due = number + 1
        number = due
