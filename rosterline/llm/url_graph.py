"""URL verdicts: host and path rules first, else trust and distrust that flow along links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import any_true, forget, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, ASCII letters in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) that fits, else nulls.

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, each page's link counted once."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]+)"), 1))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(F.col("link")).alias("dst"))
        .filter("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, max_rounds: int | None = None) -> DataFrame:
    """(host, score): personalised PageRank from seeds(host, seed) along edges(src, dst, weight).

    A host's mass goes out in proportion to its edges' weights; that of hosts without any goes
    nowhere, so scores only ever say what has been reached. Rounds end when no host's score
    grows by more than tolerance of itself (so a host that was just reached hands on, however small
    its score), or after max_rounds if given. What a round moves is pre-aggregated per host, and
    each round is a written table.
    """
    out = materialize(edges.groupBy("src").agg(F.sum("weight").alias("_all")))  # written, so that a hub's join can be split
    shares = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")))
    forget(out)
    score = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    moving, total, old = score, score, []
    if shares.isEmpty():
        return total
    for _ in count() if max_rounds is None else range(max_rounds):
        moving = materialize(
            moving.join(shares, moving.host == shares.src)
            .groupBy(F.col("dst").alias("host"))
            .agg((F.sum(F.col("score") * F.col("share")) * damping).alias("score"))
            .filter("score > 0")
        )
        total = materialize(total.union(moving).groupBy("host").agg(F.sum("score").alias("score")))
        old.append((moving, total))
        grown = moving.select("host", F.col("score").alias("_grown")).join(total, "host").agg(F.max(F.col("_grown") / F.col("score")))
        if (grown.first()[0] or 0.0) < tolerance:
            break
        if len(old) > 2:
            for x in old.pop(0):
                forget(x)
    return total


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    damping: float = 0.85,
    threshold: float = 0.5,
    tolerance: float = 1e-4,
    max_rounds: int | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict and trust of every page.

    A host's seed of trust is its share of all pages that an allow rule decides, its seed of
    distrust its share of those that a block rule decides, so each sums to 1 however rare its
    pages are. Trust follows links; distrust follows them backwards, to
    hosts that link to blocked ones. A url that no rule fits is blocked when its host's trust
    / (trust + distrust) is below threshold; a host that neither reaches is allowed, as is a
    url without a host. Null urls and html, urls of any length, repeated rows (each is judged, and counts as
    a page) and tables without links are fine; other columns are not looked at; an empty table gives an empty one.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_ruled": verdict})
    counts = judged.filter("_ruled is not null").groupBy("host").agg(
        F.sum(F.when(F.col("_ruled") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.sum(F.when(F.col("_ruled") == "block", 1.0).otherwise(0.0)).alias("bad"),
    )
    counts = materialize(counts)
    ruled = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    edges = materialize(host_edges(pages))
    seeds = {k: counts.filter(F.col(k) > 0).select("host", (F.col(k) / (ruled[k] or 1.0)).alias("seed")) for k in ("good", "bad")}
    trust = propagate(seeds["good"], edges, damping, tolerance, max_rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(seeds["bad"], back, damping, tolerance, max_rounds)
    both = (
        trust.select("host", F.col("score").alias("t"), F.lit(0.0).alias("d"))
        .union(distrust.select("host", F.lit(0.0).alias("t"), F.col("score").alias("d")))
        .groupBy("host")
        .agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        .select(F.col("host").alias("_host"), (F.col("t") / (F.col("t") + F.col("d"))).alias("trust"))
    )
    both = materialize(both)
    found = judged.join(both, (F.col("host") == F.col("_host")) & (F.col("host") != ""), "left")
    by_graph = F.when(any_true([F.col("trust").isNull(), F.col("trust") >= threshold]), "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_graph).alias("verdict"), "trust")
