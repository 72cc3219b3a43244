"""Queries of the public directory and its dashboards, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.text import highlight
from rosterline.functions.values import domain, host, iso, round_half_up, safe_divide
from rosterline.operators import name_index, ranked, rules, search, slugs
from rosterline.operators.search import SearchParams
from rosterline.sources.standins import AS_OF, CHAIN_SQL, chain, read, sql

NOW = f"TIMESTAMP '{AS_OF}'"


def a2_status_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Judges by state and status, most first."""
    status = lambda s: F.count_if(F.col("status") == s)
    out = chain(spark, d).groupBy("state").agg(F.count("*").alias("total"), status("VERIFIED").alias("verified"), status("UNVERIFIED").alias("unverified"), status("REJECTED").alias("rejected"))
    return out.orderBy(F.desc("total"), "state")


def s3_sql_scan(spark: SparkSession, d: str) -> DataFrame:
    """S3: the same as parameterised SQL."""
    chain(spark, d).createOrReplaceTempView("chain_s3")
    return spark.sql("SELECT state, count(*) AS n FROM chain_s3 WHERE status = :status GROUP BY state", args={"status": "VERIFIED"})


def f1_search_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of the verified judges that a name finds, re-ranked within the page."""
    rows, _ = search.search(chain(spark, d), SearchParams(q="lee", page=2, limit=50))
    return rows.select("judge_id", "full_name", "state_abbr", "position", "rank")


def f1_search_total(spark: SparkSession, d: str) -> DataFrame:
    """F1, A1: totals of a search by court type and state."""
    return search.search(chain(spark, d), SearchParams(court_type="BUILDING", state="EU", limit=20))[1]


def _indexed(spark: SparkSession, d: str) -> tuple[ranked.RankedTable, name_index.NameIndex]:
    """The directory in order of names, and the index of its names, both written."""
    rows = chain(spark, d).select("judge_id", "full_name", "status", "court_type", "county_slug", "state_abbr")
    table = ranked.write_ranked(rows, [F.asc("full_name"), F.asc("judge_id")], ranked.shared_path(spark, "ranked"))
    return table, name_index.write_index(table.rows, "full_name", [ranked.RANGE, ranked.PLACE], ranked.shared_path(spark, "index"))


def f1_indexed_page(spark: SparkSession, d: str) -> DataFrame:
    """F1, F2, L1, L3: the page of f1_search_page by the index of names, which is built here first."""
    rows, _ = name_index.search_indexed(*_indexed(spark, d), SearchParams(q="lee", page=2, limit=50))
    return rows.select("judge_id", "full_name", "state_abbr", F.col("position").cast("int").alias("position"), "rank")


TYPED = ["le", "AN", "o", "eva ", "ngu", "%"]


def l9_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    """What five typed texts of two characters or more suggest, by the index of names."""
    table, index = _indexed(spark, d)
    found = [(q, name_index.suggestions_indexed(table, index, q)) for q in TYPED]
    return reduce(DataFrame.union, [s.select(F.lit(q).alias("typed"), "judge_id", "full_name", "rank") for q, s in found if s is not None])


def l12_ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    """An early and a late page of all judges and a late one of the verified, off ranges written in order."""
    j = read(spark, d, "judges").select("judge_id", "source_url", "status")
    order = [*search.sorted_by(j, {"source": "source_url"}, "source", "desc", "source"), F.asc("judge_id")]
    table = ranked.write_ranked(j, order, ranked.shared_path(spark, "ranked"))
    verified = table.rows.filter("status = 'VERIFIED'")
    pages = {"early": table.page(2, 20), "late": table.page(60, 20), "verified": table.page(30, 15, verified)}
    return reduce(DataFrame.union, [rows.select(F.lit(name).alias("asked"), "judge_id", "source_url", "position") for name, rows in pages.items()])


def p1_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested projection, flattened again."""
    return search.nested(chain(spark, d)).select("judge_id", F.col("court.county.state.abbr").alias("abbr"), F.col("court.county.name").alias("county"), F.col("court.type").alias("type"))


def p4_profile_urls(spark: SparkSession, d: str) -> DataFrame:
    """Profile paths and ISO times."""
    return chain(spark, d).select("judge_id", F.concat_ws("/", F.lit("/judges"), "state_slug", "county_slug", "court_slug").alias("path"), iso(F.col("created_at")).alias("created"))


def f3_most_specific(spark: SparkSession, d: str) -> DataFrame:
    """the narrowest of court, county and state filters, among listed states of review."""
    return search.most_specific(chain(spark, d), county=3, state=1).filter(F.col("status").isin("UNVERIFIED", "NEEDS_REVIEW")).select("judge_id", "county_id", "status")


def f7_states_with_verified(spark: SparkSession, d: str) -> DataFrame:
    """States with a verified judge of one court type."""
    c = chain(spark, d).filter("court_type = 'BUILDING' AND flagged AND photo_url = ''")
    return search.with_verified(read(spark, d, "counties"), c, "county_id").select("county_id", "name")


def j6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Up to five sibling counties with verified judges."""
    return search.neighbours(read(spark, d, "counties"), chain(spark, d), 3).select("county_id", "name")


def j4_children(spark: SparkSession, d: str) -> DataFrame:
    """States with their counties as a sorted list."""
    out = search.with_children(read(spark, d, "states"), read(spark, d, "counties"), "state_id", "name", ["slug"], "kids")
    return out.select("name", F.size("kids").alias("n_counties"), F.array_join(F.transform("kids", lambda k: k.slug), ",").alias("slugs"))


def a3_candidates_by_status(spark: SparkSession, d: str) -> DataFrame:
    """A3, A4: candidates by state, pivoted to the known statuses, with the total."""
    known = ["DISCOVERED", "APPROVED", "REJECTED"]
    counts = [F.count_if(F.col("status") == k).alias(k.lower()) for k in known]
    return read(spark, d, "candidates").groupBy("state_abbr").agg(*counts, F.count("*").alias("total"))


def a5_sources(spark: SparkSession, d: str) -> DataFrame:
    """Judges by source url with the authority seen first, most first."""
    j = read(spark, d, "judges").filter("source_url is not null")
    return j.groupBy("source_url").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "VERIFIED").alias("verified"), F.min_by("source_authority", "judge_id").alias("authority")
    ).orderBy(F.desc("total"), "source_url")


def a9_court_types(spark: SparkSession, d: str) -> DataFrame:
    """Distinct court types in order."""
    return read(spark, d, "courts").select("type").distinct().orderBy("type")


def a10_latest_per_state(spark: SparkSession, d: str) -> DataFrame:
    """A10: the newest judge of every state."""
    return chain(spark, d).groupBy("state_abbr").agg(F.max_by("judge_id", F.struct("created_at", "judge_id")).alias("judge_id"), F.max("created_at").alias("created_at"))


def x7_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the four tables."""
    parts = [read(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("states", "counties", "courts", "judges")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def a20_target_percent(spark: SparkSession, d: str) -> DataFrame:
    """Verified judges as a percentage of a target, one decimal."""
    n = F.count_if(F.col("status") == "VERIFIED")
    return read(spark, d, "judges").agg(n.alias("verified"), round_half_up(safe_divide(n * 100, F.lit(1500)), 1).alias("percent"))


def l2_sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """L1, L2: a page sorted by an allowed column, nulls first when descending."""
    j = read(spark, d, "judges")
    order = [*search.sorted_by(j, {"source": "source_url", "name": "full_name"}, "source", "desc", "name"), F.asc("judge_id")]
    return search.page_of(j.select("judge_id", "source_url", "full_name"), order, 3, 40)


def l4_recent(spark: SparkSession, d: str) -> DataFrame:
    """The five newest judges."""
    return read(spark, d, "judges").orderBy(F.desc("created_at"), F.desc("judge_id")).limit(5).select("judge_id", "created_at")


def l7_custom_order(spark: SparkSession, d: str) -> DataFrame:
    """Court types with their frequency in a fixed order, the rest after it."""
    fixed = F.create_map(*(F.lit(x) for p in {"MACHINERY": 1, "BUILDING": 2}.items() for x in p))
    out = chain(spark, d).groupBy("court_type").agg(F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce(fixed[F.col("court_type")], F.lit(99)), "court_type")))  # a row per court type


def f8_tri_state(spark: SparkSession, d: str) -> DataFrame:
    """Undecided candidates, and those null or true."""
    c = read(spark, d, "candidates")
    return c.select("candidate_id", F.col("scrape_worthy").isNull().alias("undecided"), F.coalesce("scrape_worthy", F.lit(True)).alias("usable"))


def f10_stale(spark: SparkSession, d: str) -> DataFrame:
    """Candidates discovered over 30 days ago and not looked at."""
    stale = (F.col("status") == "DISCOVERED") & (F.col("discovered_at").cast("timestamp") < F.expr(f"{NOW} - INTERVAL 30 DAYS"))
    return read(spark, d, "candidates").select("candidate_id", stale.alias("is_stale"))


def f12_other_states(spark: SparkSession, d: str) -> DataFrame:
    """candidates whose host doesn't name another state."""
    fragments = spark.createDataFrame([("example.com", "EU"), ("example.net", "AF"), ("example.org", "AS")], "fragment string, abbr string")
    c = read(spark, d, "candidates").withColumn("host", host(F.col("url")))
    return search.other_state_hosts(c, fragments).select("candidate_id", "host")


def u1_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages by domain."""
    return read(spark, d, "candidates").groupBy(domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def j9_missing_courts(spark: SparkSession, d: str) -> DataFrame:
    """Counties times court types, without those that a county has."""
    have = read(spark, d, "courts").select("county_id", F.lower("type").alias("slug")).distinct()
    return rules.missing_courts(read(spark, d, "counties"), ["Building", "Probate", "Furniture"], have).select("county_id", "type")


def j10_harvest_status(spark: SparkSession, d: str) -> DataFrame:
    """States with when their urls were last scraped: fresh, stale or never."""
    last = read(spark, d, "logs").filter("success").groupBy("state_abbr").agg(F.max("scraped_at").alias("last"))
    kind = F.when(F.col("last").isNull(), "never").when(F.col("last") < F.expr("TIMESTAMP_NTZ '2024-01-30 23:00:00'"), "stale").otherwise("fresh")
    return read(spark, d, "states").join(last, F.col("abbr") == F.col("state_abbr"), "left").select("abbr", kind.alias("state_of_data"))


def t22_highlight(spark: SparkSession, d: str) -> DataFrame:
    """Names with the query marked."""
    return read(spark, d, "judges").filter(search.contains_ci(F.col("full_name"), "LEE")).select("judge_id", highlight(F.col("full_name"), "LEE").alias("marked"))


def r28_noindex(spark: SparkSession, d: str) -> DataFrame:
    """Courts with fewer than three verified judges."""
    return chain(spark, d).groupBy("court_id").agg((F.count_if(F.col("status") == "VERIFIED") < 3).alias("noindex"))


def w4_positions(spark: SparkSession, d: str) -> DataFrame:
    """Item positions of each court's list of judges."""
    w = Window.partitionBy("court_id").orderBy("full_name", "judge_id")
    return read(spark, d, "judges").filter("status = 'VERIFIED'").select("court_id", "judge_id", F.row_number().over(w).alias("position"))


_NUMBERED = "CASE WHEN judge_id % 7 < 2 THEN concat(full_name, ' 2') WHEN judge_id % 7 = 2 THEN concat(full_name, '-2-2') ELSE full_name END"


def w6_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Unique slugs of the judges of a court; some have a number in their name, and one in four courts holds slugs already."""
    j = read(spark, d, "judges").withColumn("full_name", F.expr(_NUMBERED))
    held = j.filter("court_id % 4 = 0 AND judge_id % 5 = 0").select("court_id", F.lit("bo-lee-3").alias("slug")).distinct()
    return slugs.unique_slugs(j, "court_id", "full_name", "judge_id", held).select("judge_id", "slug")


QUERIES = {f.__name__: f for f in (
    a2_status_by_state, s3_sql_scan, f1_search_page, f1_search_total, f1_indexed_page, l9_autocomplete, l12_ranked_pages, p1_nested, p4_profile_urls, f3_most_specific, f7_states_with_verified, j6_neighbours, j4_children,
    a3_candidates_by_status, a5_sources, a9_court_types, a10_latest_per_state, x7_table_counts, a20_target_percent, l2_sorted_page, l4_recent, l7_custom_order,
    f8_tri_state, f10_stale, f12_other_states, u1_hosts, j9_missing_courts, j10_harvest_status, t22_highlight, r28_noindex, w4_positions, w6_slugs,
)}

_C, _W = f"WITH {CHAIN_SQL} ", lambda *n: f"WITH {sql(*n)} "
_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
SQL = {
    "a2_status_by_state": _C + "SELECT state, count(*) AS total, count_if(status = 'VERIFIED') AS verified, count_if(status = 'UNVERIFIED') AS unverified, count_if(status = 'REJECTED') AS rejected FROM chain GROUP BY state",
    "s3_sql_scan": _C + "SELECT state, count(*) AS n FROM chain WHERE status = 'VERIFIED' GROUP BY state",
    "f1_search_page": _C + """, p AS (SELECT *, row_number() OVER (ORDER BY full_name, judge_id) AS position FROM chain WHERE status = 'VERIFIED' AND contains(lower(full_name), 'lee'))
      SELECT judge_id, full_name, state_abbr, CAST(position AS INT) AS position, CAST(row_number() OVER (ORDER BY starts_with(lower(full_name), 'lee') DESC,
        len(list_filter(string_split(lower(full_name), ' '), lambda w: starts_with(w, 'lee'))) > 0 DESC, full_name, position) AS INT) AS rank FROM p WHERE position BETWEEN 51 AND 100""",
    "l9_autocomplete": _C + ", typed AS (SELECT unnest(['le', 'an', 'eva ', 'ngu', '%']) AS q), " + """five AS (SELECT q, judge_id, full_name, row_number() OVER (PARTITION BY q ORDER BY full_name, judge_id) AS position
        FROM chain, typed WHERE status = 'VERIFIED' AND contains(lower(full_name), q))
      SELECT CASE q WHEN 'an' THEN 'AN' ELSE q END AS typed, judge_id, full_name, CAST(row_number() OVER (PARTITION BY q ORDER BY starts_with(lower(full_name), q) DESC,
        len(list_filter(string_split(lower(full_name), ' '), lambda w: starts_with(w, q))) > 0 DESC, full_name, position) AS INT) AS rank FROM five WHERE position <= 5""",
    "l12_ranked_pages": _W("judges") + """, placed AS (SELECT *, row_number() OVER (ORDER BY source_url DESC NULLS FIRST, judge_id) AS position FROM judges),
        verified AS (SELECT *, row_number() OVER (ORDER BY source_url DESC NULLS FIRST, judge_id) AS position FROM judges WHERE status = 'VERIFIED')
      SELECT CASE WHEN position <= 40 THEN 'early' ELSE 'late' END AS asked, judge_id, source_url, position FROM placed WHERE position BETWEEN 21 AND 40 OR position BETWEEN 1181 AND 1200
      UNION ALL SELECT 'verified', judge_id, source_url, position FROM verified WHERE position BETWEEN 436 AND 450""",
    "f1_search_total": _C + "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM chain WHERE status = 'VERIFIED' AND full_name <> '' AND court_type = 'BUILDING' AND state_abbr = 'EU'",
    "p1_nested": _C + "SELECT judge_id, state_abbr AS abbr, county, court_type AS type FROM chain",
    "p4_profile_urls": _C + "SELECT judge_id, concat_ws('/', '/judges', state_slug, county_slug, court_slug) AS path, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created FROM chain",
    "f3_most_specific": _C + "SELECT judge_id, county_id, status FROM chain WHERE county_id = 3 AND status IN ('UNVERIFIED', 'NEEDS_REVIEW')",
    "f7_states_with_verified": _C + "SELECT county_id, name FROM counties k WHERE EXISTS (SELECT 1 FROM chain c WHERE c.county_id = k.county_id AND status = 'VERIFIED' AND court_type = 'BUILDING' AND flagged AND photo_url = '')",
    "j6_neighbours": _C + "SELECT county_id, name FROM counties k WHERE state_id = (SELECT state_id FROM counties WHERE county_id = 3) AND county_id <> 3 AND EXISTS (SELECT 1 FROM chain c WHERE c.county_id = k.county_id AND status = 'VERIFIED') ORDER BY name LIMIT 5",
    "j4_children": _W("states", "counties") + "SELECT s.name, CAST(count(*) AS INT) AS n_counties, string_agg(k.slug, ',' ORDER BY k.name) AS slugs FROM states s JOIN counties k USING (state_id) GROUP BY s.name",
    "a3_candidates_by_status": _W("candidates") + "SELECT state_abbr, count_if(status = 'DISCOVERED') AS discovered, count_if(status = 'APPROVED') AS approved, count_if(status = 'REJECTED') AS rejected, count(*) AS total FROM candidates GROUP BY state_abbr",
    "a5_sources": _W("judges") + "SELECT source_url, count(*) AS total, count_if(status = 'VERIFIED') AS verified, arg_min(source_authority, judge_id) AS authority FROM judges WHERE source_url IS NOT NULL GROUP BY source_url",
    "a9_court_types": _W("courts") + "SELECT DISTINCT type FROM courts",
    "a10_latest_per_state": _C + "SELECT state_abbr, judge_id, created_at FROM chain QUALIFY row_number() OVER (PARTITION BY state_abbr ORDER BY created_at DESC, judge_id DESC) = 1",
    "x7_table_counts": _C + "SELECT 'states' AS name, count(*) AS n FROM states UNION ALL SELECT 'counties', count(*) FROM counties UNION ALL SELECT 'courts', count(*) FROM courts UNION ALL SELECT 'judges', count(*) FROM judges",
    "a20_target_percent": _W("judges") + "SELECT count_if(status = 'VERIFIED') AS verified, floor(count_if(status = 'VERIFIED') * 100 / 1500 * 10 + 0.5) / 10 AS percent FROM judges",
    "l2_sorted_page": _W("judges") + "SELECT judge_id, source_url, full_name, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (ORDER BY source_url DESC NULLS FIRST, judge_id) AS position FROM judges) WHERE position BETWEEN 81 AND 120",
    "l4_recent": _W("judges") + "SELECT judge_id, created_at FROM judges ORDER BY created_at DESC, judge_id DESC LIMIT 5",
    "l7_custom_order": _C + "SELECT court_type, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE court_type WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 99 END, court_type) AS INT) AS place FROM chain GROUP BY court_type",
    "f8_tri_state": _W("candidates") + "SELECT candidate_id, scrape_worthy IS NULL AS undecided, coalesce(scrape_worthy, true) AS usable FROM candidates",
    "f10_stale": _W("candidates") + f"SELECT candidate_id, status = 'DISCOVERED' AND discovered_at < {NOW} - INTERVAL 30 DAY AS is_stale FROM candidates",
    "f12_other_states": _W("candidates") + f"SELECT candidate_id, {_HOST} AS host FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('example.com', 'EU'), ('example.net', 'AF'), ('example.org', 'AS')) f(fragment, abbr) WHERE contains({_HOST}, fragment) AND abbr <> c.state_abbr)",
    "u1_hosts": _W("candidates") + rf"SELECT regexp_replace({_HOST}, '^www\.', '') AS domain, count(*) AS n FROM candidates GROUP BY 1",
    "j9_missing_courts": _W("counties", "courts") + "SELECT county_id, type FROM counties k, (VALUES ('Building'), ('Probate'), ('Furniture')) t(type) WHERE NOT EXISTS (SELECT 1 FROM courts c WHERE c.county_id = k.county_id AND lower(c.type) = lower(t.type))",
    "j10_harvest_status": _W("states", "logs") + """SELECT abbr, CASE WHEN last IS NULL THEN 'never' WHEN last < TIMESTAMP '2024-01-30 23:00:00' THEN 'stale' ELSE 'fresh' END AS state_of_data
      FROM states LEFT JOIN (SELECT state_abbr, max(scraped_at) AS last FROM logs WHERE success GROUP BY 1) l ON abbr = state_abbr""",
    "t22_highlight": _W("judges") + r"SELECT judge_id, regexp_replace(full_name, '(LEE)', '<mark>\1</mark>', 'gi') AS marked FROM judges WHERE contains(lower(full_name), 'lee')",
    "r28_noindex": _C + "SELECT court_id, count_if(status = 'VERIFIED') < 3 AS noindex FROM chain GROUP BY court_id",
    "w4_positions": _W("judges") + "SELECT court_id, judge_id, CAST(row_number() OVER (PARTITION BY court_id ORDER BY full_name, judge_id) AS INT) AS position FROM judges WHERE status = 'VERIFIED'",
    # row by row over the courts' judges, as asking one after another: i-th rows of all courts at once
    "w6_slugs": "WITH RECURSIVE " + sql("judges") + f""", j AS (SELECT judge_id, court_id, trim(regexp_replace(lower({_NUMBERED}), '[\\s-]+', '-', 'g'), '-') AS base, row_number() OVER (PARTITION BY court_id ORDER BY judge_id) AS i FROM judges),
      t(court_id, i, judge_id, slug, taken) AS (SELECT court_id, 0, NULL::BIGINT, NULL::VARCHAR, CASE WHEN court_id % 4 = 0 AND bool_or(judge_id % 5 = 0) THEN ['bo-lee-3'] ELSE []::VARCHAR[] END FROM judges GROUP BY court_id
        UNION ALL SELECT court_id, i, judge_id, free, list_append(taken, free) FROM (SELECT t.court_id, j.i, j.judge_id, taken,
          list_filter(list_concat([base], list_transform(range(2, len(taken) + 3), lambda n: base || '-' || n)), lambda x: NOT list_contains(taken, x))[1] AS free FROM t JOIN j ON j.court_id = t.court_id AND j.i = t.i + 1))
      SELECT judge_id, slug FROM t WHERE i > 0""",
}
SQL["f1_indexed_page"] = SQL["f1_search_page"]
