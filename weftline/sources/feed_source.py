"""Feeds as a data source of Spark: `spark.read.format("feeds")` and
`spark.readStream.format("feeds")`.

Every feed is a partition, so feeds are fetched side by side by the workers; one
that fails is a row with an error and stops no other.  A fetch writes what it
gets into the cache, a folder that all workers can open; offline, the cache is
all that is read.  A stream numbers its fetches and keeps each in a folder of its
own: its offset is the number of the last, and a batch that runs again reads the
same payloads.

Options: cache; feeds (names, by comma; the default feeds if none are given);
catalog (JSON: [[name, url, adapter], ...] in place of the built-in one);
offline (true, false); timeout (seconds); for streams interval (seconds between
fetches) and start (the first fetch to read).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from weftline.functions.staging import stage
from weftline.sources.feeds import CATALOG, DEFAULT_FEEDS, HttpClient, first_reports, payload_reports

PAYLOADS = "feed string, feed_ord int, source string, adapter string, fetch long, fetched timestamp, content string, error string"


@dataclass
class Fetch(InputPartition):
    """One feed in one fetch; fetch -1 is that of a batch read."""

    feed: str
    order: int
    url: str | None
    adapter: str | None
    number: int = -1


class _Feeds:
    """What the options say, for either kind of reader."""

    def __init__(self, options):
        self.cache = options.get("cache", "feed-cache").removeprefix("file://")
        self.offline, self.timeout = options.get("offline", "false") == "true", float(options.get("timeout", "30"))
        rows = json.loads(options["catalog"]) if "catalog" in options else [(r[0], r[2], r[4]) for r in CATALOG]
        self.known = {name: (url, adapter) for name, url, adapter in rows}
        default = self.known if "catalog" in options else DEFAULT_FEEDS
        self.names = [n for n in options.get("feeds", "").split(",") if n] or list(default)

    def fetches(self, number: int = -1) -> list[Fetch]:
        return [Fetch(n, k, *self.known.get(n, (None, None)), number) for k, n in enumerate(self.names)]

    def folder(self, number: int) -> Path:
        return Path(self.cache) if number < 0 else Path(self.cache) / f"fetch-{number:08d}"

    def rows(self, fetch: Fetch) -> Iterator[tuple]:
        content = error = when = None
        try:
            if fetch.url is None:
                raise KeyError(f"no such feed: {fetch.feed}")
            client = HttpClient(str(self.folder(fetch.number)), self.offline, self.timeout)
            at = client.place(fetch.url)
            kept = fetch.number >= 0 and at.exists()  # a fetch that is read again
            content = (at.read_bytes() if kept else client.get(fetch.url)).decode("utf-8", "replace")
            when = datetime.fromtimestamp(at.stat().st_mtime, timezone.utc)
        except Exception as e:  # whatever a feed may raise is reported by feed
            error = f"{type(e).__name__}: {e}"
        yield fetch.feed, fetch.order, fetch.feed, fetch.adapter, fetch.number, when or datetime.now(timezone.utc), content, error


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return PAYLOADS

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:  # noqa: N802
        return FeedStream(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.feeds = _Feeds(options)

    def partitions(self) -> list[Fetch]:
        return self.feeds.fetches()

    def read(self, partition: Fetch) -> Iterator[tuple]:
        return self.feeds.rows(partition)


class FeedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.feeds = _Feeds(options)
        self.interval, self.start = float(options.get("interval", "60")), int(options.get("start", "0"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"fetch": self.start - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last fetch that is kept; online the next, if the last is old enough."""
        kept = {int(p.name[6:]): p.stat().st_mtime for p in Path(self.feeds.cache).glob("fetch-*") if p.name[6:].isdigit()}
        last = max([self.start - 1, *kept])
        if not self.feeds.offline and time.time() - kept.get(last, 0) >= self.interval:
            last += 1
        return {"fetch": last}

    def partitions(self, start: dict, end: dict) -> list[Fetch]:
        return [f for n in range(start["fetch"] + 1, end["fetch"] + 1) for f in self.feeds.fetches(n)]

    def read(self, partition: Fetch) -> Iterator[tuple]:
        return self.feeds.rows(partition)


def _configured(reader, options: dict):
    return reader.format("feeds").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None})


def fill_cache(documents: DataFrame, cache: str, number: int = -1) -> None:
    """Put documents (url, content) into the cache, as if they had been fetched."""
    folder = str(_Feeds({"cache": cache}).folder(number))

    def put(rows) -> None:
        client = HttpClient(folder)
        for row in rows:
            client.put(row["url"], row["content"].encode())

    documents.select("url", "content").foreachPartition(put)


def payloads(spark: SparkSession, **options) -> DataFrame:
    """A row for each feed: its payload, or an error."""
    spark.dataSource.register(FeedSource)
    return _configured(spark.read, options).load()


def collect(spark: SparkSession, client: HttpClient, feeds: tuple[str, ...] | None = None, limit_per: int = 50, **options) -> tuple[DataFrame, DataFrame]:
    """reports and errors (feed, error) of one fetch of all feeds, which is
    written, so that both tell of the same fetch."""
    got = stage(payloads(spark, cache=str(client.cache), offline=client.offline, timeout=client.timeout, feeds=",".join(feeds or ()) or None, **options), "feed-payloads")
    return first_reports(payload_reports(got.where("error is null"), limit_per)), got.where("error is not null").select("feed", "error")


def stream_reports(spark: SparkSession, within: str = "7 days", limit_per: int | None = None, **options) -> DataFrame:
    """A stream of reports: id, timestamp, source, text, fetched.  A report that
    comes again, in whatever feed or fetch, is left out while the watermark, which
    is `within` behind the last fetch, remembers it."""
    spark.dataSource.register(FeedSource)
    got = _configured(spark.readStream, options).load().where("error is null")
    reports = payload_reports(got, limit_per, "fetched").select("id", "timestamp", "source", "text", "fetched", "key")
    return reports.withWatermark("fetched", within).dropDuplicatesWithinWatermark(["id", "key"]).drop("key")
