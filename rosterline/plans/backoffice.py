"""Queries of the back office: validation, reviews, look-ups, labels, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions import values
from rosterline.operators import admin, health, slugs
from rosterline.sources import reference
from rosterline.sources.standins import AS_OF, CHAIN_SQL, chain, read, sql

def now() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Harvest jobs: an order is a job of its customer's state."""
    own = chain(spark, d).select(F.col("judge_id").alias("job_id"), "state_abbr", "status", "created_at", "court_id")
    return own.withColumn("status", F.when(F.col("status") == "VERIFIED", "COMPLETED").when(F.col("status") == "REJECTED", "FAILED").otherwise("RUNNING"))


def r27_validated(spark: SparkSession, d: str) -> DataFrame:
    """Judges submitted anew: fields that are missing, courts that aren't there."""
    j = read(spark, d, "judges").select("judge_id", F.concat(F.lit(" "), "full_name").alias("full_name"), "court_id", "source_url", "education")
    courts = read(spark, d, "courts").filter("type <> 'MACHINERY'")
    out = admin.validated(j, courts)
    messages = F.array_join(F.transform("errors", lambda e: F.concat(e.field, F.lit(": "), e.message)), "; ")
    return out.select("judge_id", messages.alias("errors"), "slug", "education", F.col("full_name").alias("name"))


def r27_updated(spark: SparkSession, d: str) -> DataFrame:
    """Partial updates: names taken from judges (refused), new names with new slugs, photos that are taken away, an unknown judge."""
    j = slugs.unique_slugs(read(spark, d, "judges"), "court_id", "full_name", "judge_id").select("judge_id", "full_name", "photo_url", "court_id", "slug")
    given = F.when(F.col("full_name") == "", F.array(F.lit("full_name"))).when(F.col("judge_id") % 11 == 0, F.array(F.lit("full_name"), F.lit("photo_url"))).otherwise(F.array(F.lit("photo_url")))
    changes = j.select("judge_id", given.alias("set"), F.when(F.col("full_name") == "", " ").otherwise(" Gus Roe ").alias("full_name"), F.lit("").alias("photo_url"))
    new = spark.createDataFrame([(-1, ["full_name"], "New", "")], changes.schema)
    return admin.partially_updated(j, changes.unionByName(new)).drop("court_id")


def r22_batches(spark: SparkSession, d: str) -> DataFrame:
    """Requests to verify all judges of a court; over fifty are refused."""
    j = read(spark, d, "judges").select(F.col("court_id").alias("batch"), F.col("judge_id").alias("n"), F.col("judge_id").alias("id"), "status", F.lit("verify").alias("action"))
    return admin.batch_transitions(j, 10).select("batch", "id", "new_status", "error")


def r24_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of candidates: a rejection needs a reason."""
    c = read(spark, d, "candidates")
    action = F.when(F.col("status") == "DISCOVERED", "approve").when(F.col("status") == "PROMOTED", "delete").otherwise("reject")
    asked = c.select("candidate_id", action.alias("action"), F.when(F.col("scrape_worthy"), "too old").alias("reason"))
    return admin.reviewed(c.filter("last_yield < 3 or status <> 'APPROVED'"), asked, now()).select("candidate_id", "status", "rejection_reason", values.iso(F.col("promoted_at")).alias("promoted"), "error")


def r25_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Failed logs resolved by hand: those that a later success has resolved already are in conflict."""
    logs = read(spark, d, "logs")
    known = health.resolved_failures(logs).select("log_id", "resolved_at")
    asked = logs.select("log_id", F.when(F.col("judges_found") > 3, "eve").alias("resolved_by"), F.lit("seen").alias("notes"))
    return admin.resolved_by_hand(known, asked, now()).select("log_id", "code", "resolved_by", "notes")


def r25_actions(spark: SparkSession, d: str) -> DataFrame:
    """Sites after dismissal of their anomaly or being switched off and on."""
    logs = read(spark, d, "logs")
    sites = logs.groupBy("url").agg(F.bool_or("success").alias("active"), F.bool_or(~F.col("success")).alias("anomaly"), F.max("message").alias("anomaly_message"))
    both = F.array(F.when(F.col("message").contains("403"), "deactivate"), F.when(F.col("message").contains("odd"), "dismiss-anomaly"))  # one message may ask for both
    return admin.health_actions(sites, logs.select("url", F.explode(both).alias("action")).filter("action is not null"))


def j3_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Judges with the job that found them, if it is completed."""
    done = _jobs(spark, d).filter("status = 'COMPLETED'").withColumnRenamed("job_id", "judge_id")
    out = admin.with_optional_parent(read(spark, d, "judges").select("judge_id"), done, "judge_id", ["status", "state_abbr"], "job")
    return out.select("judge_id", F.col("job.status").alias("status"), F.col("job.state_abbr").alias("state_abbr"))


def j13_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Names and slugs of a state's counties, taken together by place."""
    k = read(spark, d, "counties").groupBy("state_id").agg(F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_list("slug")).alias("slugs"))
    return admin.aligned(k.withColumn("slugs", F.slice("slugs", 1, 3)), "names", "slugs")


def j18_labels(spark: SparkSession, d: str) -> DataFrame:
    """Counties with the first circuit that holds them; a state is a circuit here, but for the last two."""
    entries = read(spark, d, "counties").groupBy(F.col("state_id").alias("ordinal")).agg(F.collect_list(F.upper("name")).alias("counties"))
    entries = entries.select("ordinal", F.when(F.col("ordinal") > 2, "County Court").otherwise("Circuit Court").alias("court_type"), F.concat(F.lit("Circuit "), "ordinal").alias("label"), "counties")
    return admin.circuit_labels(read(spark, d, "counties").select(F.col("name").alias("county")), entries).select("county", "circuit", "line")


def l6_states(spark: SparkSession, d: str) -> DataFrame:
    """States, those with a running job first; their place is kept as a column."""
    running = _jobs(spark, d).filter("status = 'RUNNING'").select(F.col("state_abbr").alias("_a")).distinct()
    states = read(spark, d, "states").join(running, F.col("abbr") == F.col("_a"), "left").withColumn("active", F.col("_a").isNotNull())
    place = F.row_number().over(Window.orderBy(F.desc("active"), "name"))  # a row per state
    return admin.active_first(states.select("abbr", "name", "active")).withColumn("place", place)


def l12_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A page of one state's running and failed jobs."""
    return admin.job_page(_jobs(spark, d), "eu", "running, failed", limit=30, offset=45).select("job_id", "status")


def r30_courts(spark: SparkSession, d: str) -> DataFrame:
    """The courts of one county."""
    return admin.lookup(read(spark, d, "counties"), read(spark, d, "courts"), "county_id", 3, ["court_id", "type"], "type")


def s2_state(spark: SparkSession, d: str) -> DataFrame:
    """A county by its state and slug."""
    return admin.found_by_key(read(spark, d, "counties"), state_id=1, slug="nation-1").select("county_id", "name")


def r29_freshness(spark: SparkSession, d: str) -> DataFrame:
    """States whose last harvest is over 20 days old, or that have none."""
    done = read(spark, d, "logs").filter("success").groupBy(F.lower("state_abbr").alias("slug")).agg(F.max("scraped_at").alias("last_completed_at"), F.sum("judges_found").alias("judge_count"))
    states = read(spark, d, "states").select(F.lower("abbr").alias("slug"))
    return admin.freshness(states, done, now(), 20).select("slug", "has_manifest", "days_since", "is_stale", "judge_count")


def w7_batches(spark: SparkSession, d: str) -> DataFrame:
    """Judges in batches of a hundred by id."""
    return admin.batch_numbers(read(spark, d, "judges").select("judge_id"), ["judge_id"]).groupBy("batch").agg(F.count("*").alias("n"), F.min("judge_id").alias("first"))


def p6_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of judges as pages show them."""
    t = F.col("created_at")
    return read(spark, d, "judges").select("judge_id", values.long_date(t).alias("day"), values.year_of(t).alias("year"), values.month_year(t).alias("month"))


def s22_states(spark: SparkSession, d: str) -> DataFrame:
    """The reference rows of the states, counted by the first letter of their slugs."""
    return reference.states(spark).groupBy(F.left("slug", F.lit(1)).alias("letter")).agg(F.count("*").alias("n"), F.max("fips").alias("last_fips"))


QUERIES = {f.__name__: f for f in (
    r27_validated, r27_updated, r22_batches, r24_reviewed, r25_resolved, r25_actions, j3_jobs, j13_aligned, j18_labels, l6_states, l12_jobs, r30_courts, s2_state, r29_freshness, w7_batches, p6_dates, s22_states,
)}

_W = lambda *n: f"WITH {sql(*n)} "
_T = f"TIMESTAMP '{AS_OF}'"
_SLUG = "regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_JOBS = f"WITH {CHAIN_SQL}, jobs AS (SELECT judge_id AS job_id, state_abbr, CASE status WHEN 'VERIFIED' THEN 'COMPLETED' WHEN 'REJECTED' THEN 'FAILED' ELSE 'RUNNING' END AS status, created_at FROM chain) "
SQL = {
    "r27_validated": _W("judges", "courts") + f""", v AS (SELECT j.*, array_to_string(list_filter([CASE WHEN full_name = '' THEN 'full_name: Full name is required' END, CASE WHEN coalesce(trim(source_url), '') = '' THEN 'source_url: Source URL is required' END], lambda x: x IS NOT NULL), '; ') AS m,
      c.court_id IS NULL AS lost FROM judges j LEFT JOIN (SELECT * FROM courts WHERE type <> 'MACHINERY') c USING (court_id)), w AS (SELECT *, CASE WHEN m <> '' THEN m WHEN lost THEN 'court_id: Court not found' ELSE '' END AS errors FROM v)
      SELECT judge_id, errors, CASE WHEN errors = '' THEN {_SLUG} END AS slug, nullif(education, '') AS education, full_name AS name FROM w""",
    "r27_updated": _W("judges") + """, b AS (SELECT *, trim(regexp_replace(lower(full_name), '[\\s-]+', '-', 'g'), '-') AS base, full_name <> '' AND judge_id % 11 = 0 AS new FROM judges),
      n AS (SELECT *, row_number() OVER (PARTITION BY court_id, base ORDER BY judge_id) AS n, row_number() OVER (PARTITION BY court_id, new ORDER BY judge_id) AS m FROM b)
      SELECT judge_id, CASE WHEN new THEN 'Gus Roe' ELSE full_name END AS full_name, CASE WHEN full_name = '' THEN photo_url END AS photo_url, CASE WHEN new THEN CASE WHEN m > 1 THEN 'gus-roe-' || m ELSE 'gus-roe' END WHEN n > 1 THEN base || '-' || n ELSE base END AS slug,
      CASE WHEN full_name = '' THEN 'Full name cannot be empty' END AS error FROM n UNION ALL SELECT -1, NULL, NULL, NULL, 'Judge not found'""",
    "r22_batches": _W("judges") + """SELECT court_id AS batch, judge_id AS id, CASE WHEN n <= 10 AND status = 'UNVERIFIED' THEN 'VERIFIED' END AS new_status,
      CASE WHEN n > 10 THEN 'Maximum 10 judges per batch request.' WHEN status <> 'UNVERIFIED' THEN 'cannot verify from ' || status END AS error FROM (SELECT *, count(*) OVER (PARTITION BY court_id) AS n FROM judges)""",
    "r24_reviewed": _W("candidates") + """, a AS (SELECT *, CASE status WHEN 'DISCOVERED' THEN 'approve' WHEN 'PROMOTED' THEN 'delete' ELSE 'reject' END AS action FROM candidates),
      e AS (SELECT *, CASE WHEN action = 'delete' THEN 'Invalid action. Must be ''approve'' or ''reject''.' WHEN action = 'reject' AND scrape_worthy IS DISTINCT FROM true THEN 'Rejection reason is required'
        WHEN NOT (last_yield < 3 OR status <> 'APPROVED') THEN 'Candidate not found' END AS error FROM a)
      SELECT candidate_id, CASE WHEN error IS NULL THEN CASE action WHEN 'approve' THEN 'APPROVED' ELSE 'REJECTED' END END AS status, CASE WHEN error IS NULL AND action = 'reject' THEN 'too old' END AS rejection_reason,
        CASE WHEN error IS NULL AND action = 'approve' THEN '2024-02-01T00:00:00.000Z' END AS promoted, error FROM e""",
    "r25_resolved": _W("logs") + """, n AS (SELECT *, min(CASE WHEN success THEN scraped_at END) OVER (PARTITION BY url ORDER BY scraped_at, log_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM logs),
      c AS (SELECT *, CASE WHEN success THEN 404 WHEN later IS NOT NULL THEN 409 ELSE 200 END AS code FROM n)
      SELECT log_id, code, CASE WHEN code = 200 THEN CASE WHEN judges_found > 3 THEN 'eve' ELSE 'admin' END END AS resolved_by, CASE WHEN code = 200 THEN 'seen' END AS notes FROM c""",
    "r25_actions": _W("logs") + """, s AS (SELECT url, bool_or(success) AS active, bool_or(NOT success) AS anomaly, max(message) AS m, coalesce(bool_or(contains(message, '403')), false) AS off, coalesce(bool_or(contains(message, 'odd')), false) AS dismissed FROM logs GROUP BY url)
      SELECT url, CASE WHEN off THEN false ELSE active END AS active, CASE WHEN dismissed THEN false ELSE anomaly END AS anomaly, CASE WHEN NOT dismissed THEN m END AS anomaly_message FROM s""",
    "j3_jobs": _JOBS + ", d AS (SELECT * FROM jobs WHERE status = 'COMPLETED') SELECT judge_id, d.status, d.state_abbr FROM judges LEFT JOIN d ON judge_id = job_id",
    "j13_aligned": _W("counties") + """, r AS (SELECT state_id, name, row_number() OVER (PARTITION BY state_id ORDER BY name) - 1 AS pos FROM counties), t AS (SELECT state_id, slug, row_number() OVER (PARTITION BY state_id ORDER BY slug) - 1 AS pos FROM counties)
      SELECT state_id, CAST(r.pos AS INT) AS pos, name AS names, slug AS slugs FROM r LEFT JOIN (SELECT * FROM t WHERE pos < 3) t USING (state_id, pos)""",
    "j18_labels": _W("counties") + "SELECT name AS county, CASE WHEN state_id <= 2 THEN 'Circuit ' || state_id END AS circuit, '- ' || name || CASE WHEN state_id <= 2 THEN ' (Circuit ' || state_id || ')' ELSE '' END AS line FROM counties",
    "l6_states": _JOBS + ", s AS (SELECT abbr, name, abbr IN (SELECT state_abbr FROM jobs WHERE status = 'RUNNING') AS active FROM states) SELECT *, CAST(row_number() OVER (ORDER BY active DESC, name) AS INT) AS place FROM s",
    "l12_jobs": _JOBS + "SELECT job_id, status FROM jobs WHERE state_abbr = 'EU' AND status IN ('RUNNING', 'FAILED') ORDER BY created_at DESC, job_id DESC LIMIT 30 OFFSET 45",
    "r30_courts": _W("courts") + "SELECT court_id, type FROM courts WHERE county_id = 3",
    "s2_state": _W("counties") + "SELECT county_id, name FROM counties WHERE state_id = 1 AND slug = 'nation-1'",
    "r29_freshness": _W("states", "logs") + f""", m AS (SELECT lower(state_abbr) AS slug, max(scraped_at) AS at, sum(judges_found) AS judge_count FROM logs WHERE success GROUP BY 1), a AS (SELECT lower(abbr) AS slug, m.slug IS NOT NULL AS has_manifest,
      CAST(floor((epoch({_T}) - epoch(m.at)) / 86400) AS BIGINT) AS days_since, CAST(judge_count AS BIGINT) AS judge_count FROM states LEFT JOIN m ON lower(abbr) = m.slug) SELECT *, coalesce(days_since > 20, true) AS is_stale FROM a""",
    "w7_batches": _W("judges") + ", r AS (SELECT judge_id, CAST(ceil(row_number() OVER (ORDER BY judge_id) / 100) AS INT) AS batch FROM judges) SELECT batch, count(*) AS n, min(judge_id) AS first FROM r GROUP BY batch",
    "p6_dates": _W("judges") + "SELECT judge_id, strftime(created_at, '%B %-d, %Y') AS day, strftime(created_at, '%Y') AS year, strftime(created_at, '%b %Y') AS month FROM judges",
    "s22_states": f"SELECT substr(lower(name), 1, 1) AS letter, count(*) AS n, max(fips) AS last_fips FROM (VALUES {', '.join(f'''('{n}', '{f}')''' for n, _, f in reference.STATES)}) s(name, fips) GROUP BY 1",
}
