"""Directory queries: filters, ranking, pages, facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class SearchParams:
    q: str | None = None
    state: str | None = None
    county: str | None = None
    court_type: str | None = None
    page: int = 1
    limit: int = 20
    errors: list[str] = field(default_factory=list)


def _whole(text: str | None, default: int, least: int, most: int | None) -> int:
    match = re.match(r"\s*(-?\d+)", text or "")
    value = int(match[1]) if match else default
    return max(least, min(value, most) if most else value) if match else default


def validate(raw: dict[str, str | None]) -> SearchParams:
    """Raw parameters to SearchParams; what is wrong is in errors."""
    out = SearchParams()
    q = (raw.get("q") or "").strip()
    if len(q) > 100:
        out.errors.append("q must be at most 100 characters")
    state = (raw.get("state") or "").strip().upper()
    if state and not re.fullmatch("[A-Z]{2}", state):
        out.errors.append("state must be two letters")
    out.q, out.state = q or None, state or None
    out.county, out.court_type = (raw.get("county") or "").strip() or None, (raw.get("courtType") or "").strip() or None
    out.page, out.limit = _whole(raw.get("page"), 1, 1, None), _whole(raw.get("limit"), 20, 1, 100)
    if (raw.get("limit") or "").strip() == "0":
        out.limit = 20
    return out


def contains_ci(c: Column, part: str) -> Column:
    """substring whatever the case; % and _ are plain characters."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def search_filter(chain: DataFrame, p: SearchParams) -> DataFrame:
    """verified judges by name, court type, county slug and state; chain has the joined hierarchy."""
    out = chain.filter("status = 'VERIFIED'")
    out = out.filter(contains_ci(F.col("full_name"), p.q)) if p.q else out.filter("full_name <> ''")
    for name, value in (("court_type", p.court_type), ("county_slug", p.county), ("state_abbr", p.state)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def most_specific(chain: DataFrame, court: str | None = None, county: str | None = None, state: str | None = None) -> DataFrame:
    """by court, else county, else state."""
    for name, value in (("court_id", court), ("county_id", county), ("state_id", state)):
        if value is not None:
            return chain.filter(F.col(name) == value)
    return chain


#: Pages that begin further back are read off numbered ranges, since a sorted prefix of so many rows would pass through the driver.
DEEP = 100_000


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in an order, from 1; one sort over ranges, no single task.

    The sorted rows are kept on the executors' disks, so that both the ranges' sizes and the rows' places come from one
    deal into ranges; the caller may clear the cache afterwards.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select(F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return placed.withColumn(name, F.col("_start") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_p", "_first", "_start")


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def page_of(df: DataFrame, order: list[Column], page: int, limit: int, deep: int = DEEP) -> DataFrame:
    """L1: one page, with its rows' places over the whole as `position` (from 1)."""
    first = (max(1, page) - 1) * limit
    if first > deep:
        whole = numbered(df, order, "position")
        return whole.filter(F.col("position").between(first + 1, first + limit)).withColumn("position", F.col("position").cast("int"))
    rows = df.orderBy(*order).offset(first).limit(limit)
    return rows.withColumn("position", F.lit(first) + F.row_number().over(Window.orderBy(*order)))  # at most one page


def reranked(rows: DataFrame, name: str, q: str) -> DataFrame:
    """L3: within one page, names that start with the query, then those with such a word, then the others, by name."""
    low, part = F.lower(F.col(name)), q.lower()
    by_word = F.exists(F.split(low, r"\s+"), lambda w: w.startswith(part))
    order = [F.desc(low.startswith(part)), F.desc(by_word), F.asc(name), F.asc("position")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most one page


def search(chain: DataFrame, p: SearchParams) -> tuple[DataFrame, DataFrame]:
    """The page and a row with total and total_pages."""
    found = search_filter(chain, p)
    rows = page_of(found, [F.asc("full_name"), F.asc("judge_id")], p.page, p.limit)
    total = found.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / p.limit))
    return (reranked(rows, "full_name", p.q) if p.q else rows.withColumn("rank", F.col("position"))), total


def suggestions(chain: DataFrame, q: str) -> DataFrame | None:
    """Five results for two characters or more."""
    return search(chain, SearchParams(q=q, limit=5))[0] if len(q.strip()) >= 2 else None


def sorted_by(df: DataFrame, allowed: dict[str, str], field_: str | None, direction: str | None, default: str) -> list[Column]:
    """L2: an allowed sort column, nulls after values ascending and before them descending."""
    c = F.col(allowed.get(field_ or "", allowed[default]))
    return [c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()]


def with_verified(parents: DataFrame, chain: DataFrame, key: str) -> DataFrame:
    """Parents with a verified judge somewhere below."""
    return parents.join(chain.filter("status = 'VERIFIED'").select(key).distinct(), key, "left_semi")


def neighbours(counties: DataFrame, chain: DataFrame, county_id: object, k: int = 5) -> DataFrame:
    """Other counties of the same state with verified judges, by name."""
    own = counties.filter(F.col("county_id") == county_id).select(F.col("state_id").alias("_s"))
    near = counties.join(own, F.col("state_id") == F.col("_s"), "left_semi").filter(F.col("county_id") != county_id)
    return with_verified(near, chain, "county_id").orderBy("name").limit(k)


def hierarchy(states: DataFrame, counties: DataFrame, courts: DataFrame, judges: DataFrame) -> DataFrame:
    """Judges with their court, county and state; Spark broadcasts the dimensions if they are small enough."""
    dims = (
        courts.select("court_id", "county_id", F.col("type").alias("court_type"), F.col("slug").alias("court_slug"))
        .join(counties.select("county_id", "state_id", F.col("name").alias("county"), F.col("slug").alias("county_slug")), "county_id")
        .join(states.select("state_id", F.col("name").alias("state"), F.col("slug").alias("state_slug"), F.col("abbr").alias("state_abbr")), "state_id")
    )
    return judges.join(dims, "court_id")


def nested(chain: DataFrame) -> DataFrame:
    """Judge with court, county and state as nested structs."""
    state = F.struct(F.col("state").alias("name"), F.col("state_abbr").alias("abbr"))
    county = F.struct(F.col("county").alias("name"), F.col("county_slug").alias("slug"), state.alias("state"))
    return chain.select("judge_id", "full_name", F.struct(F.col("court_type").alias("type"), F.col("court_slug").alias("slug"), county.alias("county")).alias("court"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array; meant for children of bounded number."""
    kids = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    return parents.join(kids, key, "left")


def prioritized(urls: DataFrame, as_of: Column, stale_days: int = 7, skip_unhealthy: bool = False) -> DataFrame:
    """Urls with health columns (or nulls) in buckets, what to scrape first with the least priority.

    Urls with a success within stale_days are left out, with skip_unhealthy also stale ones with a score below 0.3.
    """
    since = as_of.cast("double") - F.col("last_success_at").cast("timestamp").cast("double")
    bucket = (
        F.when(F.coalesce("total_scrapes", F.lit(0)) == 0, "never-scraped")
        .when(since < stale_days * 86400.0, "fresh")
        .when(F.col("health_score") >= 0.7, "stale-healthy")
        .when(F.col("health_score") >= 0.3, "stale-moderate")
        .otherwise("stale-unhealthy")
    )
    order = {"stale-healthy": 1, "never-scraped": 2, "stale-moderate": 3, "stale-unhealthy": 4, "fresh": 5}
    ordinal = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("bucket")]
    out = urls.withColumn("bucket", bucket).withColumn("priority", ordinal).filter("bucket <> 'fresh'")
    return out.filter("bucket <> 'stale-unhealthy'") if skip_unhealthy else out


def other_state_hosts(hits: DataFrame, fragments: DataFrame) -> DataFrame:
    """hits(host, state_abbr) whose host holds no fragment(fragment, abbr) of another state."""
    theirs = broadcast_if_small(fragments)
    return hits.join(theirs, F.contains(hits.host, theirs.fragment) & (theirs.abbr != hits.state_abbr), "left_anti")


# Substrings that give away a challenge page.
CAPTCHA = [
    "captcha", "verify you are human", "challenge-platform", "cf-browser-verification", "cf-chl-bypass", "hcaptcha", "recaptcha",
    "g-recaptcha", "turnstile", "just a moment", "checking your browser", "bot detection", "access denied",
]


def has_captcha(html: Column) -> Column:
    """F14."""
    return F.exists(F.array(*(F.lit(x) for x in CAPTCHA)), lambda x: F.contains(F.lower(html), x))
