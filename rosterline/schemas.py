"""Explicit schemas of the domain tables, and assertions for the keys that Spark does not enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = "state_id string, name string, slug string, abbr string, fips string"
COUNTIES = "county_id string, state_id string, name string, slug string, fips string"
COURTS = "court_id string, county_id string, type string, slug string, level string"
JUDGES = (
    "judge_id string, court_id string, full_name string, slug string, status string, confidence double, term_start string, "
    "term_end string, selection_method string, appointing_authority string, photo_url string, education string, "
    "prior_experience string, courthouse_address string, courthouse_phone string, is_chief boolean, source_url string, "
    "roster_url string, source_authority string, extraction_method string, anomaly_flags array<string>, job_id string"
)
SCRAPE_LOGS = (
    "log_id long, url string, state_abbr string, success boolean, judges_found int, failure_type string, "
    "http_status int, resolved_at timestamp, scraped_at timestamp"
)
URL_HEALTH = (
    "url string, domain string, state_abbr string, health_score double, total_scrapes long, successful_scrapes long, "
    "last_yield int, avg_yield double, yield_trend string, anomaly boolean, anomaly_message string, "
    "last_scraped_at timestamp, last_success_at timestamp, active boolean"
)
CANDIDATES = (
    "url string, domain string, state_abbr string, status string, scrape_worthy boolean, confidence double, "
    "hints string, last_yield int, harvest_attempts int, discovered_at timestamp"
)
COURT_ENTRY = (
    "struct<url:string,court_type:string,label:string,level:string,counties:array<string>,fetch_method:string,"
    "headquarters_county:string,deterministic:boolean>"
)
STATE_CONFIG = f"state string, abbreviation string, rate_limit struct<delay_ms:int,max_concurrent:int>, county_aliases map<string,string>, courts array<{COURT_ENTRY}>"


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty for a table that keeps its key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent; a null key refers to nothing and is no orphan."""
    keys = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return children.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")
