"""Feeds over HTTPS as a Spark data source: one partition a source, the transport handed in.

A partition asks for its source's feed under the policy: every hop's URL and every resolved address is checked, redirects
and retries are counted, bodies are capped. What goes wrong is a row with a code, never a failed task.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from broadsheet.functions.urls import _V4_NETS, canonical_url, ipv6_reach_of
from broadsheet.sources.feeds import BODY_CAP, FEED_TYPES

SCHEMA = "source_id string, kind string, code string, status int, final_url string, content_type string, body string, etag string, last_modified string, attempts int, redirects int"


@dataclass(frozen=True)
class Policy:
    redirects: int = 3
    retries: int = 2
    delay_ms: int = 250
    timeout_ms: int = 10_000
    body_cap: int = BODY_CAP


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


class FetchError(Exception):
    """network-error, dns-error or timeout: these are tried again."""


def address_is_public(text: str) -> bool:
    if ":" in text:
        return ipv6_reach_of(text) == "public"
    try:
        a = ipaddress.IPv4Address(text)
    except ValueError:
        return False
    return not any(a in net for net, _ in _V4_NETS)


def url_code(url: str) -> str | None:
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return "invalid-url"
    host = (u.hostname or "").rstrip(".")
    if u.scheme.lower() != "https":
        return "not-https"
    if not 1 <= len(host) <= 253 or len(url) > 2048 or canonical_url(url) is None:
        return "invalid-url" if u.username is None else "credentials"
    if (port and port != 443) or u.fragment:
        return "unsafe-url"
    named = host not in ("localhost",) and not host.endswith((".localhost", ".local", ".internal", ".home.arpa", ".invalid", ".test", ".example"))
    reserved = any(host == d or host.endswith("." + d) for d in ("example.com", "example.net", "example.org"))
    literal = ":" in host or all(p.isdigit() for p in host.split("."))
    return None if named and not reserved and not literal else "unsafe-host"


def fetch(source_id: str, url: str, resolve: Callable[[str], list[str]], request: Callable[[str, list[str], dict[str, str]], Response], sleep: Callable[[int], None], policy: Policy = Policy(), cached: dict[str, str] | None = None) -> tuple:
    """One source's feed as a row of SCHEMA. The count of retries starts anew at each hop."""
    attempts = hops = 0
    asked = {"accept": ", ".join(FEED_TYPES)}
    if cached:
        asked |= {h: cached[k] for k, h in (("etag", "if-none-match"), ("last_modified", "if-modified-since")) if cached.get(k)}

    def row(kind: str, code: str | None = None, r: Response | None = None, body: str | None = None) -> tuple:
        low = {k.lower(): v for k, v in r.headers.items()} if r else {}
        return (source_id, kind, code, r.status if r else None, url, low.get("content-type"), body, low.get("etag") or None, low.get("last-modified") or None, attempts, hops)

    while True:
        if bad := url_code(url):
            return row("failure", bad)
        tries = 0
        while True:
            attempts += 1
            try:
                addresses = resolve(urlsplit(url).hostname or "")
                if not addresses:
                    raise FetchError("dns-error")
                if not all(map(address_is_public, addresses)):
                    return row("failure", "unsafe-address")
                r = request(url, addresses, asked)
                again = r.status in (408, 425, 429) or r.status >= 500
                code = "http-error" if again else None
            except FetchError as e:
                r, again, code = None, True, str(e) or "network-error"
            if not again:
                break
            if tries >= policy.retries:
                return row("failure", code, r)
            tries += 1
            sleep(policy.delay_ms)
        low = {k.lower(): v for k, v in r.headers.items()}
        length = low.get("content-length")
        if length is not None and not length.isdigit():
            return row("failure", "invalid-content-length", r)
        if (length is not None and int(length) > policy.body_cap) or len(r.body) > policy.body_cap:
            return row("failure", "response-too-large", r)
        if r.status == 304:
            return row("not-modified", None, r)
        if 300 <= r.status < 400:
            if not low.get("location"):
                return row("failure", "redirect-without-location", r)
            if hops >= policy.redirects:
                return row("failure", "too-many-redirects", r)
            hops, url = hops + 1, urljoin(url, low["location"])
            continue
        if not 200 <= r.status < 300:
            return row("failure", "http-error", r)
        kind = low.get("content-type", "").split(";")[0].strip().lower()
        if not kind:
            return row("failure", "missing-content-type", r)
        if kind not in FEED_TYPES:
            return row("failure", "unsupported-content-type", r)
        return row("success", None, r, r.body.decode("utf-8", "replace"))


class _One(InputPartition):
    def __init__(self, source_id: str, url: str):
        self.source_id, self.url = source_id, url


class FeedReader(DataSourceReader):
    def __init__(self, sources: list[tuple[str, str]], environment: Callable[[], tuple]):
        self.sources, self.environment = sources, environment

    def partitions(self) -> list[InputPartition]:
        return [_One(*s) for s in self.sources]

    def read(self, partition: _One) -> Iterator[tuple]:
        resolve, request, sleep = self.environment()
        try:
            yield fetch(partition.source_id, partition.url, resolve, request, sleep)
        except Exception:  # noqa: BLE001  a source's trouble is a row
            yield (partition.source_id, "failure", "network-error", None, partition.url, None, None, None, None, 1, 0)


def read_feeds(spark: SparkSession, sources: list[tuple[str, str]], environment: Callable[[], tuple]) -> DataFrame:
    """Feeds of (source_id, url): environment() gives resolve, request and sleep where a partition is read."""

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return "broadsheet_feeds"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return FeedReader(sources, environment)

    spark.dataSource.register(Feeds)
    return spark.read.format("broadsheet_feeds").load()
