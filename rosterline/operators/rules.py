"""Rules and reports: quality gate, failures, court levels, state machines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.text import county_alnum, county_key, slug
from rosterline.functions.values import safe_divide
from rosterline.operators.search import broadcast_if_small, has_captcha

# Metric -> (warning, critical).
GATE = {"failed_page": (0.1, 0.25), "zero_judge_page": (0.15, 0.3), "missing_county": (0.2, 0.4), "core_incomplete": (0.02, 0.05), "schema_failure": (0.1, 0.2)}
SEVERITIES = ["PASS", "WARNING", "CRITICAL"]
#: Fixed order and substrings of the failure classes; body is looked at before parse errors.
BY_MESSAGE = [
    ("HTTP_403", ["http 403", "403 forbidden"]), ("HTTP_429", ["http 429", "429 too many"]),
    ("TIMEOUT", ["timeouterror", "aborterror", "timed out", "timeout"]), ("SSL_ERROR", ["cert_", "ssl", "certificate", "unable_to_verify"]),
    ("DNS_FAILURE", ["enotfound", "eai_again", "getaddrinfo"]),
]
PARSE = ["parse", "zod", "validation"]
TRANSITIONS = [("UNVERIFIED", "verify", "VERIFIED"), ("UNVERIFIED", "reject", "REJECTED"), ("VERIFIED", "unverify", "UNVERIFIED"), ("REJECTED", "unverify", "UNVERIFIED")]


def severity(value: Column, warning: float, critical: float) -> Column:
    """Strictly above a threshold."""
    return F.when(value > critical, 2).when(value > warning, 1).otherwise(0)


def quality_gate(counts: DataFrame) -> DataFrame:
    """Counts has <metric>_n and <metric>_d for each metric; adds rates, severities and the worst as verdict."""
    df = counts
    for m, (w, c) in GATE.items():
        df = df.withColumn(f"{m}_rate", safe_divide(F.col(f"{m}_n"), F.col(f"{m}_d")))
        df = df.withColumn(f"{m}_severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), severity(F.col(f"{m}_rate"), w, c) + 1))
    worst = F.greatest(*(severity(F.col(f"{m}_rate"), *t) for m, t in GATE.items()))
    return df.withColumn("verdict", F.element_at(F.array(*map(F.lit, SEVERITIES)), worst + 1))


def failure_class(message: Column, status: Column, body: Column) -> Column:
    """By status, message, a challenge page in the body, parse errors, in this order."""
    low = F.lower(message)
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    out = F.when(status == 403, "HTTP_403").when(status == 429, "HTTP_429")
    for name, words in BY_MESSAGE:
        out = out.when(any_of(words), name)
    return out.when(has_captcha(body), "CAPTCHA_DETECTED").when(any_of(PARSE), "PARSE_ERROR").otherwise("UNKNOWN")


def court_level(kind: Column) -> Column:
    """R17."""
    low = F.lower(kind)
    appeal = low.contains("district court of appeal") | low.contains("court of appeals") | low.contains("appellate")
    return F.when(low.contains("supreme"), "SUPREME").when(appeal, "APPELLATE")


def is_appellate(kind: Column) -> Column:
    """R17."""
    low = F.lower(kind)
    return low.contains("supreme court") | low.contains("district court of appeal") | low.contains("court of appeals") | low.contains("appellate court")


def resolved_county(rows: DataFrame, counties: DataFrame) -> DataFrame:
    """county_id of rows(county, state_id): by slug, else by letters and digits alone, else null."""
    by_slug = counties.groupBy(F.col("state_id").alias("_s1"), F.col("slug").alias("_slug")).agg(F.min("county_id").alias("_by_slug"))
    by_name = counties.groupBy(F.col("state_id").alias("_s2"), county_alnum(F.col("name")).alias("_name")).agg(F.min("county_id").alias("_by_name"))
    out = rows.join(by_slug, (F.col("state_id") == F.col("_s1")) & (slug(F.col("county")) == F.col("_slug")), "left")
    out = out.join(by_name, (F.col("state_id") == F.col("_s2")) & (county_alnum(F.col("county")) == F.col("_name")), "left")
    return out.withColumn("county_id", F.coalesce("_by_slug", "_by_name")).drop("_s1", "_slug", "_by_slug", "_s2", "_name", "_by_name")


def resolved_court(rows: DataFrame, counties: DataFrame, seats: DataFrame) -> DataFrame:
    """rows(row_id, state_id, county, court_type) with county_id and placeholder, or error.

    Appellate courts, and courts without a county, lie in the county of their seat by seats(state_id, court_type,
    hq), else in the state's placeholder county "Statewide"; other courts need a known county.
    """
    hq = seats.groupBy(F.col("state_id").alias("_s"), F.lower("court_type").alias("_t")).agg(F.min("hq").alias("_hq"))
    own = is_appellate(F.col("court_type")) | F.col("county").isNull() | (F.col("county") == "")
    asked = rows.join(hq, (F.col("state_id") == F.col("_s")) & (F.lower("court_type") == F.col("_t")), "left").withColumns({"_own": own, "_asked": F.col("county")})
    found = resolved_county(asked.withColumn("county", F.when(own, F.col("_hq")).otherwise(F.col("county"))), counties)
    lost = F.col("county_id").isNull()
    return found.withColumns(
        {"county": F.col("_asked"), "placeholder": F.when(F.col("_own") & lost, "Statewide"), "error": F.when(~F.col("_own") & lost, F.concat(F.lit("County not found: "), F.col("_asked")))}
    ).drop("_s", "_t", "_hq", "_own", "_asked")


def aliased(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows(county) with canonical and alias_applied by aliases(alias, canonical, ordinal), the first alias first."""
    first = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min_by("canonical", "ordinal").alias("_canonical"))
    out = rows.join(first, F.lower(F.trim("county")) == F.col("_alias"), "left")
    return out.withColumns({"canonical": F.coalesce("_canonical", F.trim("county")), "alias_applied": F.col("_alias").isNotNull()}).drop("_alias", "_canonical")


def headquarters(rows: DataFrame, courts: DataFrame) -> DataFrame:
    """For rows(row_id, court_type) the county of the first of courts(type, label, hq, ordinal) of that type or labelled with it."""
    hits = rows.join(broadcast_if_small(courts), (F.lower("court_type") == F.lower("type")) | F.contains(F.lower("label"), F.lower("court_type")), "left")
    return hits.groupBy("row_id").agg(F.min_by("hq", "ordinal").alias("hq"))  # courts: the entries of one state's configuration


def configured_hosts(rows: DataFrame, courts: DataFrame) -> DataFrame:
    """rows(url) with configured: whether their host is that of a configured court(url)."""
    hosts = courts.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("_host")).filter("_host is not null").distinct()
    host = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    return rows.withColumn("_h", host).join(hosts, F.col("_h") == F.col("_host"), "left").withColumn("configured", F.col("_host").isNotNull()).drop("_h", "_host")


def zero_counties(configured: DataFrame, judges: DataFrame) -> DataFrame:
    """configured(county) without a judge(county)."""
    seen = judges.filter("county is not null").select(F.lower("county").alias("_c")).distinct()
    return configured.join(seen, F.lower("county") == F.col("_c"), "left_anti")


def missing_courts(counties: DataFrame, types: list[str], courts: DataFrame) -> DataFrame:
    """Counties times the listed court types, without the courts that there are."""
    wanted = counties.select("county_id").withColumn("type", F.explode(F.array(*map(F.lit, types)))).withColumn("slug", slug(F.col("type")))
    return wanted.join(courts.select("county_id", "slug"), ["county_id", "slug"], "left_anti")


def transitions(items: DataFrame) -> DataFrame:
    """items(id, status, action) with new_status, or error for a step that isn't allowed."""
    allowed = F.create_map(*(F.lit(x) for a, b, c in TRANSITIONS for x in (f"{a}>{b}", c)))
    new = F.try_element_at(allowed, F.concat_ws(">", "status", "action"))
    error = F.when(F.col("status").isNull(), "not found").when(new.isNull(), F.format_string("cannot %s from %s", "action", "status"))
    return items.withColumns({"new_status": F.when(error.isNull(), new), "error": error})


def auto_status(worthy: Column) -> Column:
    """R21."""
    return F.when(worthy, "APPROVED").when(~worthy, "REJECTED").otherwise("DISCOVERED")


def worthy(confidence: Column, roster: Column) -> Column:
    """True, false or null for undecided."""
    return F.when((confidence >= 0.7) & roster, True).when((confidence < 0.3) | ~roster, False)


def downgraded(candidates: DataFrame) -> DataFrame:
    """Worthy ones that twice or more yielded nothing become unworthy."""
    empty = F.col("scrape_worthy") & (F.col("last_yield") == 0) & (F.col("harvest_attempts") >= 2)
    return candidates.withColumn("scrape_worthy", F.when(empty, False).otherwise(F.col("scrape_worthy")))


def coverage(records: DataFrame) -> DataFrame:
    """For every column how many values are there (not null, empty or false), in one pass."""
    def there(c: str, kind: str) -> Column:
        x = F.col(c)
        return F.count_if(F.coalesce((x != "") if kind == "string" else x if kind == "boolean" else x.isNotNull(), F.lit(False)))

    one = records.agg(F.count("*").alias("_total"), *(there(c, t).alias(c) for c, t in records.dtypes))
    long = one.unpivot(["_total"], records.columns, "field", "filled")
    return long.withColumn("percent", F.floor(safe_divide(F.col("filled"), F.col("_total")) * 1000 + 0.5).cast("double") / 10).withColumnRenamed("_total", "total")


def exploded_by_county(records: DataFrame) -> DataFrame:
    """records(county, counties, level, deterministic) of trial courts without a county, one per county of their entry."""
    many = F.col("county").isNull() & ~F.col("level").isin("supreme", "appellate") & ~F.col("deterministic") & (F.size("counties") > 0)
    return records.withColumn("county", F.explode(F.when(many, F.col("counties")).otherwise(F.array("county")))).drop("counties")


def carried_forward(rows: DataFrame, page: str, position: str, header: str) -> DataFrame:
    """The last header seen on the page so far; a page is one document, so its window is bounded by it."""
    so_far = Window.partitionBy(page).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("current", F.last(header, ignorenulls=True).over(so_far))


def county_counts(judges: DataFrame) -> DataFrame:
    """Distinct counties with judges, by their key."""
    return judges.agg(F.countDistinct(county_key(F.col("county"))).alias("counties"))
