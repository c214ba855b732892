"""Feeds as a stream: what was read last of each source is the offset, so that an unchanged feed is no data.

The offset of a source is the validators (etag, last-modified) of its feed. At each trigger the sources' headers are asked
for, a few at a time; only sources whose validators moved become partitions, which fetch the body where they run, saying
what they have. A 304 gives no row and moves nothing, a failure gives a row with its code and keeps the validators. A feed
that changes between the two requests is read again at the next trigger, so rows come at least once; first_seen drops
repeated items.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from broadsheet.sources.fetching import SCHEMA, Policy, fetch

#: Sources whose headers are asked for at once.
PROBES = 16
_NOTHING = {"etag": "", "last_modified": "", "polled": 0}


class _Changed(InputPartition):
    def __init__(self, source_id: str, url: str, known: dict):
        self.source_id, self.url, self.known = source_id, url, known


class FeedStreamReader(DataSourceStreamReader):
    """environment() gives resolve, request, sleep (as fetch takes them) and head, a request that brings no body."""

    def __init__(self, sources: list[tuple[str, str]], environment: Callable[[], tuple], policy: Policy, clock: Callable[[], int]):
        self.sources, self.environment, self.policy, self.clock = sources, environment, policy, clock
        self.last: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {source: dict(_NOTHING) for source, _ in self.sources}

    def latestOffset(self) -> dict:
        resolve, _, sleep, head = self.environment()

        def probe(one: tuple[str, str]) -> tuple[str, dict]:
            source, url = one
            known = self.last.get(source, _NOTHING)
            try:
                row = fetch(source, url, resolve, head, sleep, self.policy, known)
            except Exception:  # noqa: BLE001  a source's trouble is told by its partition
                return source, known | {"polled": self.clock()}
            if row[1] == "not-modified":
                return source, known
            if row[1] != "success":
                return source, known | {"polled": self.clock()}
            etag, modified = row[7] or "", row[8] or ""
            return source, {"etag": etag, "last_modified": modified, "polled": 0 if etag or modified else self.clock()}

        with ThreadPoolExecutor(PROBES) as pool:
            self.last = dict(pool.map(probe, self.sources))
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for source, known in end.items():  # after a restart, what the last run had read
            self.last.setdefault(source, known)
        return [_Changed(s, url, start.get(s) or _NOTHING) for s, url in self.sources if end.get(s) != start.get(s)]

    def read(self, partition: _Changed) -> Iterator[tuple]:
        resolve, request, sleep, _ = self.environment()
        try:
            row = fetch(partition.source_id, partition.url, resolve, request, sleep, self.policy, partition.known)
        except Exception:  # noqa: BLE001
            row = (partition.source_id, "failure", "network-error", None, partition.url, None, None, None, None, 1, 0)
        if row[1] != "not-modified":
            yield row


def stream_feeds(spark: SparkSession, sources: list[tuple[str, str]], environment: Callable[[], tuple], policy: Policy = Policy(), clock: Callable[[], int] = lambda: int(time.time() * 1000)) -> DataFrame:
    """A stream of fetched feeds of (source_id, url), as rows of fetching.SCHEMA: a row for each change and each failure."""

    class FeedStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return "broadsheet_feed_stream"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return FeedStreamReader(sources, environment, policy, clock)

    spark.dataSource.register(FeedStream)
    return spark.readStream.format("broadsheet_feed_stream").load()
