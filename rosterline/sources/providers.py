"""Services outside Spark behind interfaces, with offline stand-ins.

A provider is a picklable object; Spark deals the rows out and calls it once per batch in the tasks.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterline.operators.search import CAPTCHA, broadcast_if_small, has_captcha
from rosterline.sources.markup import markdown, next_markdown


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[str | None, str | None]:
        """(body, error) of a url."""


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class Search(Protocol):
    def hits(self, query: str) -> list[tuple[str, str, str]]:
        """(title, link, snippet) of each hit."""


@dataclass
class HttpFetcher:
    """GET with a pause between calls and up to three attempts, each waiting longer."""

    delay: float = 1.5
    timeout: float = 30.0
    attempts: int = 3

    def fetch(self, url: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(1, self.attempts + 1):
            time.sleep(self.delay if n == 1 else 2.0 * n)
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:  # noqa: S310
                    return answer.read().decode("utf-8", "replace"), None
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
            except (OSError, ValueError) as e:
                error = str(e)
        return None, error


@dataclass
class StealthFetcher:
    """A command that writes a url's page to a file; allowed hosts and their subdomains only, a pause per host, one more try after a failure.

    The command is called with the url and the file's name. Rows of one host meet in one task (see fetched()), so its
    pause holds for the host.
    """

    command: list[str]
    allowed: list[str]
    delay: float = 3.0
    retry_after: float = 15.0
    timeout: float = 60.0
    last: dict[str, float] = field(default_factory=dict)

    def fetch(self, url: str) -> tuple[str | None, str | None]:
        host = (urlsplit(url).hostname or "").lower()
        if not any(host == a or host.endswith("." + a) for a in self.allowed):
            return None, f"host not allowed: {host}"
        error = None
        for attempt in range(2):
            time.sleep(self.retry_after if attempt else max(0.0, self.last.get(host, 0.0) + self.delay - time.monotonic()))
            self.last[host] = time.monotonic()
            with tempfile.TemporaryDirectory() as folder:  # the command's output, read at once by this task
                path = os.path.join(folder, "page.html")
                try:
                    done = subprocess.run([*self.command, url, path], capture_output=True, text=True, timeout=self.timeout, check=False)  # noqa: S603
                except (OSError, subprocess.TimeoutExpired) as e:
                    error = str(e)
                    continue
                if done.returncode:
                    error = done.stderr.strip() or f"Exit code {done.returncode}"
                elif not os.path.exists(path):
                    error = "Output file not created"
                else:
                    with open(path, encoding="utf-8", errors="replace") as page:
                        if body := page.read():
                            return body, None
                    error = "Output file is empty"
        return None, error


class RateLimited(RuntimeError):
    """A search service refuses further queries."""


def _json_of(request: urllib.request.Request, timeout: float, limits: dict[int, str]) -> dict:
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code in limits:
            raise RateLimited(f"RATE_LIMIT: {limits[e.code]} (HTTP {e.code})") from e
        raise RuntimeError(f"HTTP {e.code} {e.reason}") from e


@dataclass
class WebSearch:
    """A web-search service: up to 20 hits; 403 and 429 are limits of the service."""

    url: str
    key: str
    key_header: str = "X-Subscription-Token"
    most: int = 20

    def hits(self, query: str) -> list[tuple[str, str, str]]:
        asked = urlencode({"q": query, "count": self.most, "search_lang": "en", "country": "US"})
        request = urllib.request.Request(f"{self.url}?{asked}", headers={"Accept": "application/json", self.key_header: self.key})
        found = _json_of(request, 15.0, {429: "rate limit exceeded", 403: "quota exceeded"})
        return [(x.get("title", ""), x.get("url", ""), x.get("description", "")) for x in (found.get("web") or {}).get("results") or []]


@dataclass
class NeuralSearch:
    """A neural search service: the snippet of a hit is its highlights, one a line."""

    url: str
    key: str
    domains: list[str] = field(default_factory=list)
    most: int = 5

    def hits(self, query: str) -> list[tuple[str, str, str]]:
        asked = {"query": query, "numResults": self.most, "type": "auto", "contents": {"highlights": {"numSentences": 5, "highlightsPerUrl": 3}}}
        asked |= {"includeDomains": self.domains} if self.domains else {}
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json", "x-api-key": self.key, "Accept": "application/json"})
        return [(x.get("title") or "", x.get("url", ""), "\n".join(x.get("highlights") or [])) for x in _json_of(request, 30.0, {429: "rate limit exceeded"}).get("results", [])]


@dataclass
class FixedModel:
    """Answers by the first key that occurs in the prompt."""

    answers: dict[str, str] = field(default_factory=dict)

    def complete(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), "{}")


@dataclass
class FixedSearch:
    found: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)

    def hits(self, query: str) -> list[tuple[str, str, str]]:
        return self.found.get(query, [])


def _more(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with further columns."""
    schema = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def fetched(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """urls(url, ...) with body and error; hosts are dealt out so that one task paces one host."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fetcher.fetch(u) for u in batch.column("url").to_pylist()]
            for k, name in enumerate(("body", "error")):
                batch = batch.append_column(name, pa.array([f[k] for f in found], pa.string()))
            yield batch

    return urls.repartition(host).mapInArrow(get, _more(urls, body="string", error="string"))


def checked(pages: DataFrame, gatsby: DataFrame | None = None, least: int = 50) -> DataFrame:
    """pages(url, body, error) with markdown: a challenge page becomes an error that names what gave it away; a thin
    one takes what its embedded data say if that is longer, else the page data of gatsby(url, body)."""
    low = F.lower("body")
    sign = F.coalesce(*(F.when(low.contains(c), c) for c in CAPTCHA))
    rows = pages.withColumns({"error": F.coalesce("error", F.concat(F.lit("CAPTCHA detected: "), sign)), "markdown": markdown(F.col("body"))})
    thin = lambda c: F.coalesce(F.length(c), F.lit(0)) < least
    data = next_markdown(F.col("body"))
    longer = F.coalesce(F.length(data), F.lit(0)) > F.coalesce(F.length("markdown"), F.lit(0))
    rows = rows.withColumn("markdown", F.when(thin("markdown") & longer, data).otherwise(F.col("markdown")))
    if gatsby is not None:
        own = gatsby.groupBy(F.col("url").alias("_u")).agg(F.min("body").alias("_g"))
        rows = rows.join(own, F.col("url") == F.col("_u"), "left")
        better = thin("markdown") & F.col("body").contains("___gatsby") & (F.length("_g") > F.coalesce(F.length("markdown"), F.lit(0)))
        rows = rows.withColumn("markdown", F.when(better, F.col("_g")).otherwise(F.col("markdown"))).drop("_u", "_g")
    return rows.withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown")))


def fetched_offline(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """S8 without a network: bodies from a table of pages(url, html)."""
    own = pages.groupBy(F.col("url").alias("_u")).agg(F.min("html").alias("body"))
    out = urls.join(own, urls.url == own._u, "left").drop("_u")
    return out.withColumn("error", F.when(F.col("body").isNull(), "not found"))


def routed(entries: DataFrame, pages: DataFrame, stealth_pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """Bodies by fetch method: http, scrapling (allowed hosts and their subdomains only), auto (http, else stealth for thin pages); browser and manual have none."""
    http = fetched_offline(entries, pages).withColumn("plain", F.col("body")).drop("body", "error")
    hosts = broadcast_if_small(allowed.select(F.col("host").alias("_h")))
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    ok = entries.select("url").distinct().join(hosts, (host == F.col("_h")) | host.endswith(F.concat(F.lit("."), F.col("_h"))), "left_semi").withColumn("_ok", F.lit(True))
    stealth = stealth_pages.groupBy("url").agg(F.min("html").alias("_s"))
    both = http.join(ok, "url", "left").join(stealth, "url", "left").withColumn("_s", F.when(F.col("_ok"), F.col("_s")))
    thin = F.coalesce(F.length("plain"), F.lit(0)) < 200
    body = F.when(F.col("fetch_method") == "http", F.col("plain")).when(F.col("fetch_method") == "scrapling", F.col("_s")).when(F.col("fetch_method") == "auto", F.when(thin, F.coalesce("_s", "plain")).otherwise(F.col("plain")))
    out = both.withColumn("body", body).drop("plain", "_ok", "_s")
    return out.withColumns({"blocked": F.coalesce(has_captcha(F.col("body")), F.lit(False)), "markdown": markdown(F.col("body"))})


def completed(rows: DataFrame, prompt: str, model: Model, answer: str = "answer") -> DataFrame:
    """Rows with the model's answers to a prompt column; a null prompt has none."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else model.complete(p) for p in batch.column(prompt).to_pylist()]
            yield batch.append_column(answer, pa.array(found, pa.string()))

    return rows.mapInArrow(ask, _more(rows, **{answer: "string"}))


# Levels and templates of the queries by which sources of a state are sought, and the siblings that names are mistaken for.
QUERY_TEMPLATES = {
    "supreme": '"{state}" supreme court justices roster site:gov',
    "appellate": '"{state}" court of appeal judges roster site:gov',
    "trial": '"{state}" circuit OR superior OR district court judges roster site:gov',
    "supreme_org": '"{state}" supreme court justices roster site:org',
    "appellate_org": '"{state}" court of appeal judges roster site:org',
    "trial_org": '"{state}" circuit OR superior OR district court judges roster site:org',
}
AMBIGUOUS = {
    "South Carolina": "North Carolina", "North Carolina": "South Carolina", "South Dakota": "North Dakota", "North Dakota": "South Dakota",
    "West Virginia": "Virginia", "Virginia": "West Virginia",
}


def queries_of(states: DataFrame) -> DataFrame:
    """states(name) with level and query, one for each template; ambiguous names exclude their sibling."""
    excluded = F.coalesce(F.create_map(*(F.lit(x) for k, v in AMBIGUOUS.items() for x in (k, f' -"{v}"')))[F.col("name")], F.lit(""))
    each = states.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(t).alias("text")) for k, t in QUERY_TEMPLATES.items()))))
    query = F.concat(F.replace("_t.text", F.lit("{state}"), F.col("name")), excluded)
    return each.withColumns({"level": F.col("_t.level"), "query": query}).drop("_t")


def hits(queries: DataFrame, search: Search) -> DataFrame:
    """queries(query, ...) with position, title, link, snippet of every hit."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, k, *h) for n, q in enumerate(batch.column("query").to_pylist()) for k, h in enumerate(search.hits(q))]
            rows = batch.take(pa.array([f[0] for f in found], pa.int64()))
            for at, (name, kind) in enumerate((("position", pa.int32()), ("title", pa.string()), ("link", pa.string()), ("snippet", pa.string())), 1):
                rows = rows.append_column(name, pa.array([f[at] for f in found], kind))
            yield rows

    return queries.mapInArrow(ask, _more(queries, position="integer", title="string", link="string", snippet="string"))


def encyclopaedia_page(people: DataFrame, pages: DataFrame, base: str = "https://ballotpedia.org/", most: int = 15_000) -> DataFrame:
    """people(name, state) with the first of four spellings whose page speaks of a judge, cut to its first characters.

    Blanks of a name become underscores, full stops and commas go; the spellings are plain, with the state, with the state and judge, with judge.
    """
    under = F.url_encode(F.translate(F.regexp_replace("name", r"\s+", "_"), ".,", ""))
    for written, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # as encodeURIComponent leaves them
        under = F.replace(under, F.lit(written), F.lit(char))
    state = F.col("state")
    tries = F.array(under, F.concat(under, F.lit("_("), state, F.lit(")")), F.concat(under, F.lit("_("), state, F.lit("_judge)")), F.concat(under, F.lit("_(judge)")))
    asked = people.select("name", "state", F.posexplode(tries).alias("_n", "_t")).withColumn("url", F.concat(F.lit(base), "_t"))
    found = asked.join(pages.select("url", "html"), "url").filter(F.lower("html").rlike("judge|justice|court"))
    best = found.groupBy("name", "state").agg(F.min_by("url", "_n").alias("page_url"), F.left(F.min_by("html", "_n"), F.lit(most)).alias("page"))
    return people.join(best, ["name", "state"], "left")
