"""The domain tables, read from the generated star schema (S1): states, counties, courts, judges, logs, candidates, records.

Columns are written in SQL that Spark and DuckDB read alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Queries are asked as of this time.
AS_OF = "2024-02-01 00:00:00"

_FIRST = "CASE o_orderkey % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Carla' WHEN 3 THEN 'Dov' WHEN 4 THEN 'Eva' ELSE 'Finn' END"
_LAST = "CASE o_custkey % 7 WHEN 0 THEN 'Lee' WHEN 1 THEN 'Smith' WHEN 2 THEN 'Leeds' WHEN 3 THEN 'Ortiz' WHEN 4 THEN 'Nguyen' WHEN 5 THEN 'Adams' ELSE 'Brown' END"
_SITE = "CASE WHEN o_custkey % 3 = 0 THEN concat('https://www.court', o_custkey % 40, '.gov/judges') WHEN o_custkey % 3 = 1 THEN concat('https://court', o_custkey % 40, '.org/bench') END"
_NAME = "CASE l_suppkey % 5 WHEN 0 THEN 'Hon. ' WHEN 1 THEN 'Judge ' ELSE '' END"

#: table -> (source, [(expression, column)])
TABLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "states": ("region", [("r_regionkey", "state_id"), ("r_name", "name"), ("replace(lower(r_name), ' ', '-')", "slug"), ("upper(substr(r_name, 1, 2))", "abbr")]),
    "counties": ("nation", [("n_nationkey", "county_id"), ("n_regionkey", "state_id"), ("n_name", "name"), ("replace(lower(n_name), '_', '-')", "slug")]),
    "courts": ("customer", [("c_custkey", "court_id"), ("c_nationkey", "county_id"), ("c_mktsegment", "type"), ("concat('court-', c_custkey)", "slug")]),
    "judges": ("orders", [
        ("o_orderkey", "judge_id"), ("o_custkey", "court_id"), (f"CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE concat({_FIRST}, ' ', {_LAST}) END", "full_name"),
        ("CASE WHEN o_orderkey % 10 = 0 THEN 'NEEDS_REVIEW' WHEN o_orderstatus = 'F' THEN 'VERIFIED' WHEN o_orderstatus = 'O' THEN 'UNVERIFIED' ELSE 'REJECTED' END", "status"),
        (_SITE, "source_url"),
        ("CASE WHEN o_custkey % 3 = 0 THEN 'OFFICIAL_GOV' WHEN o_custkey % 3 = 1 THEN 'COURT_WEBSITE' END", "source_authority"),
        ("CASE WHEN o_orderkey % 2 = 0 THEN 'deterministic' ELSE 'llm' END", "extraction_method"),
        ("CASE WHEN o_orderkey % 3 = 0 THEN 'p.jpg' WHEN o_orderkey % 3 = 1 THEN '' END", "photo_url"),
        ("CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority END", "education"), ("CASE WHEN o_orderkey % 7 < 3 THEN 'bar' END", "prior_experience"),
        ("o_totalprice / 1000000", "confidence"), ("o_orderdate", "created_at"), ("o_orderkey % 20 = 0", "flagged"),
    ]),
    "logs": ("events", [
        ("event_id", "log_id"), ("concat('https://site', user_id, '.gov/roster')", "url"), ("CASE user_id % 5 WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 2 THEN 'AS' ELSE 'EU' END", "state_abbr"),
        ("event_type <> 'error'", "success"), ("CAST(floor(value / 10) AS INT)", "judges_found"), ("ts", "scraped_at"),
        ("CASE WHEN event_type = 'error' THEN concat(CASE event_id % 5 WHEN 0 THEN 'HTTP 403 Forbidden' WHEN 1 THEN 'request timed out' WHEN 2 THEN 'getaddrinfo ENOTFOUND' WHEN 3 THEN 'zod validation' ELSE 'odd' END, ' at ', user_id) END", "message"),
    ]),
    "candidates": ("pages", [
        ("page_id", "candidate_id"), ("url", "url"), ("CASE page_id % 5 WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' ELSE 'MI' END", "state_abbr"),
        ("CASE page_id % 4 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' ELSE 'PROMOTED' END", "status"),
        ("CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END", "scrape_worthy"), ("CAST(page_id % 4 AS INT)", "last_yield"), ("CAST(page_id % 3 + 1 AS INT)", "harvest_attempts"),
        ("CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' ELSE TIMESTAMP '2024-01-20 00:00:00' END", "discovered_at"),
    ]),
    "records": ("lineitem", [
        ("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + CAST(l_quantity AS INT)", "seq"),
        (f"concat({_NAME}, CASE l_partkey % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Carla' WHEN 3 THEN 'Dov' WHEN 4 THEN 'Eva' ELSE 'Finn' END, ' ', CASE l_orderkey % 900 % 7 WHEN 0 THEN 'Lee' WHEN 1 THEN 'Smith' WHEN 2 THEN 'Ortiz' ELSE 'Brown' END)", "full_name"),
        ("CASE l_linenumber % 3 WHEN 0 THEN 'Circuit Court' WHEN 1 THEN 'County Court' ELSE 'Supreme Court' END", "court_type"),
        ("CASE WHEN l_orderkey % 4 > 0 THEN concat('County ', l_orderkey % 25) END", "county"), ("CASE l_orderkey % 5 WHEN 0 THEN 'AF' WHEN 1 THEN 'AM' ELSE 'EU' END", "state"),
        ("CASE WHEN l_orderkey % 11 = 0 THEN concat('Harvard Law School, ', 1950 + l_orderkey % 60) WHEN l_orderkey % 11 = 1 THEN 'Stetson College of Law 1988' WHEN l_orderkey % 11 = 2 THEN '' WHEN l_orderkey % 11 = 3 THEN 'University of Miami School of Law, J.D. 1975' WHEN l_orderkey % 11 = 4 THEN 'JD, Ohio State University 2001' WHEN l_orderkey % 11 = 5 THEN 'UF Law' END", "education"),
        ("CASE WHEN l_linenumber = 2 THEN concat(1970 + l_orderkey % 40, '-05-01') END", "bar_admission_date"), ("CASE WHEN l_linenumber = 3 THEN concat('in ', 1980 + l_orderkey % 30) END", "appointment_date"),
        ("CASE WHEN l_linenumber % 2 = 0 THEN 'x.jpg' WHEN l_linenumber = 5 THEN '' END", "photo_url"), ("CASE WHEN l_tax > 0.04 THEN l_returnflag END", "division"), ("l_quantity / 100", "confidence"),
    ]),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS {c}" for e, c in columns))


def sql(*names: str) -> str:
    """A WITH clause (without WITH) of the tables for DuckDB."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for e, c in TABLES[n][1])} FROM {TABLES[n][0]})" for n in names)


CHAIN_SQL = (
    sql("states", "counties", "courts", "judges")
    + """, chain AS (SELECT j.*, c.county_id, c.type AS court_type, c.slug AS court_slug, k.state_id, k.name AS county, k.slug AS county_slug,
  s.name AS state, s.slug AS state_slug, s.abbr AS state_abbr
  FROM judges j JOIN courts c USING (court_id) JOIN counties k USING (county_id) JOIN states s USING (state_id))"""
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterline.operators.search import hierarchy

    return hierarchy(*(read(spark, sf_dir, n) for n in ("states", "counties", "courts", "judges")))
