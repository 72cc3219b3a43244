"""Pages of sitemaps as a data source of Spark, batch and stream (S8, S11): spark.read.format("paced_http").option("index", url).

The index names sitemaps; all sitemaps of a host are one partition, whose task reads them and fetches their pages one after
another with the pause of HttpFetcher, so no host is asked by two tasks of a read. The planner holds the index only, never the pages' addresses. A host
with most pages is one task of bounded memory: its pause binds it, not Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlsplit
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from rosterline.sources.providers import HttpFetcher

SCHEMA = "host string, url string, listed_at timestamp, body string, error string"
BEGIN = "0001-01-01T00:00:00+00:00"


def _entries(xml: str, kind: str) -> Iterator[tuple[str, str | None]]:
    """Address and time (UTC, ISO; null if there is none that can be read) of the <sitemap> or <url> elements."""
    for element in ElementTree.fromstring(xml).iter():  # noqa: S314
        if element.tag.rsplit("}", 1)[-1] != kind:
            continue
        parts = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in element}
        if parts.get("loc"):
            yield parts["loc"], _time(parts.get("lastmod"))


def _time(text: str | None) -> str | None:
    try:
        found = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return (found if found.tzinfo else found.replace(tzinfo=UTC)).astimezone(UTC).isoformat(timespec="microseconds")


def _host(url: str) -> str:
    return urlsplit(url).netloc.lower()


@dataclass
class HostPartition(InputPartition):
    """The sitemaps of a host with their times; of pages those listed after `after` and up to `until`, if given."""

    host: str
    sitemaps: list[tuple[str, str | None]]
    after: str | None = None
    until: str | None = None


class _Pages:
    """What batch and stream share: options index (address), delay, timeout, attempts."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("index"):
            raise ValueError("option index: the address of a sitemap index or a sitemap")
        self.index = options["index"]
        self.fetcher = HttpFetcher(float(options.get("delay", 1.5)), float(options.get("timeout", 30)), int(options.get("attempts", 3)))
        self.hosts: set[str] | None = None
        self.urls: set[str] | None = None

    def _listed(self) -> list[tuple[str, str | None]]:
        body, error = self.fetcher.fetch(self.index)
        if body is None:
            raise OSError(f"{self.index}: {error}")
        found = list(_entries(body, "sitemap"))
        return found or [(self.index, max((t for _, t in _entries(body, "url") if t), default=None))]  # a sitemap by itself

    def _dealt(self, listed: Iterable[tuple[str, str | None]], after: str | None = None, until: str | None = None) -> list[HostPartition]:
        by_host: dict[str, list[tuple[str, str | None]]] = {}
        for loc, time in listed:
            by_host.setdefault(_host(loc), []).append((loc, time))
        return [HostPartition(h, maps, after, until) for h, maps in sorted(by_host.items()) if self.hosts is None or h in self.hosts]

    def read(self, partition: HostPartition) -> Iterator[tuple]:
        """A row per page; a page or sitemap that fails is a row with its error. Pages of other hosts than their sitemap's aren't fetched and say so."""
        for sitemap, changed in partition.sitemaps:
            body, error = self.fetcher.fetch(sitemap)
            try:
                pages = list(_entries(body, "url")) if body is not None else []
            except ElementTree.ParseError as e:
                pages, error = [], f"no sitemap: {e}"
            if error:
                yield partition.host, sitemap, None, None, error
            for url, time in pages:
                time = time or changed
                if partition.until and not (time and partition.after < time <= partition.until) or self.urls is not None and url not in self.urls:
                    continue
                at = datetime.fromisoformat(time) if time else None
                if _host(url) != partition.host:
                    yield partition.host, url, at, None, "page of another host"
                else:
                    yield partition.host, url, at, *self.fetcher.fetch(url)


class PacedReader(_Pages, DataSourceReader):
    """Batch: all pages. Equality and IN over host and url are taken over: hosts that can't match aren't planned, pages not fetched."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("host",):
                self.hosts = values if self.hosts is None else self.hosts & values
            elif values is not None and f.attribute == ("url",):
                self.urls = values if self.urls is None else self.urls & values
            else:
                yield f

    def partitions(self) -> list[HostPartition]:
        return self._dealt(self._listed())


class PacedStream(_Pages, DataSourceStreamReader):
    """Stream: pages whose time in their sitemap (else their sitemap's) is later than that of the last batch. Sitemaps of no time are left to batches."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": BEGIN}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": max((t for _, t in self._listed() if t), default=BEGIN)}

    def partitions(self, start: dict, end: dict) -> list[HostPartition]:
        return self._dealt([(loc, t) for loc, t in self._listed() if t and t > start["until"]], start["until"], end["until"])

    def commit(self, end: dict) -> None:
        """Nothing is kept on the other side."""


class PacedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PacedReader:
        return PacedReader(self.options)

    def streamReader(self, schema) -> PacedStream:  # noqa: N802
        return PacedStream(self.options)


def register(spark: SparkSession) -> None:
    """The source under its name, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PacedHttp)
