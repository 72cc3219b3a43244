"""Queries over harvested records: identity, merging, scoring, quality, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions import text, values
from rosterline.operators import bucketed, identity, maintained, rules, similar_names, writes
from rosterline.operators.ranked import shared_path
from rosterline.sources.standins import CHAIN_SQL, chain, read, sql


def _records(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "records").filter("seq is not null")


def r6_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity keys and tiers of all records."""
    return identity.with_identity(_records(spark, d)).select("seq", "identity", "tier")


def r7_merged(spark: SparkSession, d: str) -> DataFrame:
    """One record per identity, gaps filled by the next richest."""
    out = identity.merged_by_identity(_records(spark, d))
    return out.select("identity", "full_name", "education", "photo_url", "division", "kept_seq", "merged")


def r7_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Which record went into which."""
    return identity.duplicates_by_identity(_records(spark, d))


def r10_stats(spark: SparkSession, d: str) -> DataFrame:
    """Records by tier."""
    return identity.identity_stats(_records(spark, d)).groupBy("tier").agg(F.sum("n").alias("n"))


def r8_merged(spark: SparkSession, d: str) -> DataFrame:
    """One record per name, court and county: the base by the running score, its gaps filled."""
    return identity.merged_by_key(_records(spark, d))


def r8_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Every record that went into another, as it was then, with the record it went into."""
    return identity.folded_by_key(_records(spark, d)).filter("duplicate_of is not null").drop("merged")


def r12_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Waiting judges with their new score and whether it promotes them."""
    flags = F.when(F.col("flagged"), F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    j = read(spark, d, "judges").withColumn("anomaly_flags", flags)
    fields = identity.bio_fields(["photo_url", "education", "prior_experience"])
    return identity.rescored(j, fields).select("judge_id", F.round("new_score", 6).alias("new_score"), "promoted")


def a21_tally(spark: SparkSession, d: str) -> DataFrame:
    """Promotions by authority, by state and in all."""
    c = chain(spark, d).withColumn("anomaly_flags", F.array().cast("array<string>"))
    fields = identity.bio_fields(["photo_url", "education", "prior_experience"])
    return identity.promotion_tally(identity.rescored(c, fields))


def a14_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many values each field has."""
    return rules.coverage(read(spark, d, "records").select("county", "education", "photo_url", "division"))


def r15_gate(spark: SparkSession, d: str) -> DataFrame:
    """The quality gate of each state's records."""
    n = lambda c: F.count_if(c).alias
    counts = _records(spark, d).groupBy("state").agg(
        n(F.col("division").isNull())("failed_page_n"), F.count("*").alias("failed_page_d"), n(F.col("photo_url") == "")("zero_judge_page_n"), F.count("*").alias("zero_judge_page_d"),
        n(F.col("county").isNull())("missing_county_n"), F.count("*").alias("missing_county_d"), n(F.col("confidence") < 0.02)("core_incomplete_n"), F.count("*").alias("core_incomplete_d"),
        F.lit(0).alias("schema_failure_n"), F.lit(0).alias("schema_failure_d"),
    )
    return rules.quality_gate(counts).select("state", "missing_county_severity", "core_incomplete_severity", "verdict")


def j7_zero_counties(spark: SparkSession, d: str) -> DataFrame:
    """Counties without a record of one division."""
    configured = spark.range(0, 30).select(F.concat(F.lit("COUNTY "), "id").alias("county"))
    return rules.zero_counties(configured, _records(spark, d).filter("division = 'N'"))


def j16_counties(spark: SparkSession, d: str) -> DataFrame:
    """County names resolved by slug or by letters and digits."""
    rows = read(spark, d, "counties").select("state_id", F.upper(F.regexp_replace("name", "_", " ")).alias("county"), "county_id").withColumnRenamed("county_id", "expected")
    return rules.resolved_county(rows, read(spark, d, "counties")).select("county", "county_id", (F.col("county_id") == F.col("expected")).alias("right"))


def r17_courts(spark: SparkSession, d: str) -> DataFrame:
    """Counties of courts: their own, that of an appellate court's seat, or the placeholder."""
    counties = read(spark, d, "counties")
    seats = counties.groupBy("state_id").agg(F.min("name").alias("hq")).filter("state_id < 3").withColumn("court_type", F.lit("Supreme Court"))
    kind = F.when(F.col("type") == "BUILDING", "Supreme Court").when(F.col("type") == "MACHINERY", "Appellate Court").otherwise("County Court")
    own = F.when(F.col("type") == "FURNITURE", "Nowhere").when(F.col("type") != "HOUSEHOLD", F.upper("name"))
    rows = read(spark, d, "courts").join(counties.select("county_id", "state_id", "name"), "county_id").select(F.col("court_id").alias("row_id"), "state_id", own.alias("county"), kind.alias("court_type"))
    return rules.resolved_court(rows, counties, seats).select("row_id", "county_id", "placeholder", "error")


def j19_authority(spark: SparkSession, d: str) -> DataFrame:
    """Judges by the authority of their source."""
    courts = spark.createDataFrame([("https://court1.org/",), ("https://court10.org/x",), ("bad url",)], "url string")
    rows = read(spark, d, "judges").select("judge_id", F.col("source_url").alias("url"))
    out = rules.configured_hosts(rows, courts)
    return out.select("judge_id", values.source_authority(F.col("url"), F.col("configured")).alias("authority"))


def _reviewed(judges: DataFrame) -> DataFrame:
    """What is upserted: a photo for judges to be reviewed; those that have no photo give a further judge each, told from the first by `added`."""
    added = F.col("photo_url").isNull()
    further = F.col("judge_id") + F.when(added, 10_000_000).otherwise(0)
    return judges.filter("status = 'NEEDS_REVIEW'").select(further.alias("judge_id"), added.alias("added"), F.lit(None).cast("string").alias("full_name"), F.lit("new.jpg").alias("photo_url"))


def k1_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K1: judges after an upsert, by change."""
    t = read(spark, d, "judges").select("judge_id", F.lit(False).alias("added"), "full_name", "status", "photo_url", "confidence")
    return writes.upserted(t, _reviewed(t), ["judge_id", "added"]).groupBy("change", "status").agg(F.count("*").alias("n"), F.count("full_name").alias("named"), F.count_if(F.col("photo_url") == "new.jpg").alias("photos"))


def k1_bucketed_writes(spark: SparkSession, d: str) -> DataFrame:
    """Judges in buckets after an upsert, an update and a delete that touch only their buckets."""
    t = read(spark, d, "judges").select("judge_id", F.lit(False).alias("added"), "full_name", "status", "photo_url")
    table = bucketed.write_bucketed(t, ["judge_id", "added"], shared_path(spark, "judges"), 16)
    table.upsert(_reviewed(t))
    table.update(F.col("full_name") == "Ann Lee", {"status": F.lit("VERIFIED")})
    table.delete(F.col("status") == "REJECTED")
    return table.rows.drop("added")


def a2_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Judges by state of court and status, kept up to date while a third of them come, change and go."""
    rows = chain(spark, d).select("judge_id", "state", "status", "flagged")
    verified = F.when(F.col("status") == "VERIFIED", 1).otherwise(0)
    kept = maintained.MaintainedAggregate(rows, ["state"], {"verified": verified, "flagged": F.col("flagged").cast("int")}, shared_path(spark, "kept"))
    part = F.col("judge_id") % 3
    kept.rebuild(rows.filter(part != 0))  # the others come later
    kept.apply(0, inserted=rows.filter(part == 0))
    kept.apply(1, inserted=rows.filter((part == 1) & (F.col("status") == "UNVERIFIED")).withColumn("status", F.lit("VERIFIED")), deleted=rows.filter((part == 1) & (F.col("status") == "UNVERIFIED")))
    kept.apply(2, deleted=rows.filter("status = 'REJECTED'"))
    return kept.current()


def k7_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are not known yet."""
    c = read(spark, d, "candidates")
    return writes.inserted_if_absent(c.filter("status = 'PROMOTED'"), c.select("url", "candidate_id"), "url")


def k10_downgraded(spark: SparkSession, d: str) -> DataFrame:
    """Worthy candidates that yield nothing."""
    return rules.downgraded(read(spark, d, "candidates")).select("candidate_id", "scrape_worthy")


def k12_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Judges that are left when courts are deleted."""
    _, left = writes.deleted_cascade(read(spark, d, "courts"), read(spark, d, "judges"), "court_id", F.col("type") == "BUILDING")
    return left.groupBy("status").agg(F.count("*").alias("n"))


def k14_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Approved candidates that the configuration lacks, with their first health."""
    c = read(spark, d, "candidates")
    return writes.promoted(c, c.filter("scrape_worthy is null").select("url"))[2]


def r22_transitions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each judge when asked to be verified or rejected."""
    items = read(spark, d, "judges").select(F.col("judge_id").alias("id"), "status", F.when(F.col("judge_id") % 2 == 0, "verify").otherwise("reject").alias("action"))
    return rules.transitions(items).groupBy("new_status", "error").agg(F.count("*").alias("n"))


def r21_auto_status(spark: SparkSession, d: str) -> DataFrame:
    """Status by worthiness."""
    return read(spark, d, "candidates").select("candidate_id", rules.auto_status(F.col("scrape_worthy")).alias("status"))


def e10_worthy(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on documents by their labels, undecided without one."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = docs.select("doc_id").join(labels.groupBy("doc_id").agg(F.avg("quality").alias("q"), F.max("toxic").alias("t")), "doc_id", "left")
    return out.select("doc_id", rules.worthy(F.col("q"), F.col("t") == 0).alias("worthy"))


def j20_similar_people(spark: SparkSession, d: str) -> DataFrame:
    """Names in a county that are alike to 0.7, with the records of either."""
    out = similar_names.people_alike(_records(spark, d), ["state", "county"], 0.7)
    return out.withColumn("similarity", F.round("similarity", 6))


def t16_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Names of suppliers next to each other, compared."""
    s = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    a, b = F.col("p_name"), F.lower("p_type")
    return s.select("p_partkey", F.round(text.edit_similarity(a, b), 6).alias("edit"), F.round(text.word_overlap(a, F.concat(b, F.lit(" ring bolt"))), 6).alias("overlap"))


def t5_names(spark: SparkSession, d: str) -> DataFrame:
    """Record names without titles."""
    return _records(spark, d).select("seq", text.judge_name(F.col("full_name")).alias("name"), text.roster_name(F.col("full_name")).alias("roster"))


def t9_courts(spark: SparkSession, d: str) -> DataFrame:
    """Court types in canonical form, and their level."""
    c = F.concat(F.lower("court_type"), F.when(F.col("seq") % 2 == 0, " of Texas").otherwise(""))
    return _records(spark, d).select("seq", text.court_type(c, F.lit("TX")).alias("kind"), rules.court_level(c).alias("level"))


def t11_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Names of counties and slugs."""
    n = F.concat("name", F.lit(" County"))
    return read(spark, d, "counties").select("county_id", text.county_key(n).alias("key"), text.county_alnum(n).alias("alnum"), text.county_seed(n).alias("seed"), text.slug(n).alias("slug"), text.title_of_slug(F.col("slug")).alias("title"))


def m2_rounding(spark: SparkSession, d: str) -> DataFrame:
    """M-1, M-2, M-4, M-5, M-7: rounding, clamping and defaults."""
    j = read(spark, d, "judges")
    return j.select("judge_id", values.round_half_up(F.col("confidence")).alias("r"), values.clamp01(F.col("confidence") * 4 - 1).alias("c"), values.safe_divide(F.col("confidence"), F.col("judge_id") % 2).alias("q"), values.filled(F.col("photo_url"), F.lit("none")).alias("photo"))


def c1_by_county(spark: SparkSession, d: str) -> DataFrame:
    """Records of courts for several counties, one per county."""
    r = _records(spark, d).select("seq", "county", F.array(F.lit("A"), F.lit("B")).alias("counties"), F.when(F.col("seq") % 3 == 0, "supreme").otherwise("trial").alias("level"), (F.col("seq") % 2 == 0).alias("deterministic"))
    return rules.exploded_by_county(r).select("seq", "county")


QUERIES = {f.__name__: f for f in (
    r6_identity, r7_merged, r7_duplicates, r10_stats, r8_merged, r8_duplicates, r12_rescored, a21_tally, a14_coverage, r15_gate, j7_zero_counties, j16_counties, r17_courts, j19_authority, k1_upsert, k1_bucketed_writes, a2_maintained, k7_insert_if_absent,
    k10_downgraded, k12_cascade, k14_promotion, r22_transitions, r21_auto_status, e10_worthy, j20_similar_people, t16_similarity, t5_names, t9_courts, t11_scalars, m2_rounding, c1_by_county,
)}

_W = lambda *n: f"WITH {sql(*n)} "
_N = "regexp_replace(regexp_replace(lower(full_name), '^(hon[.]|judge) ', ''), '[.]', '', 'g')"
_IDENTITY = _W("records") + f""", p AS (SELECT *, {_N} AS n, CASE WHEN education LIKE 'Harvard%' THEN 'harvard law' WHEN education LIKE 'Stetson%' THEN 'stetson college of law'
  WHEN education LIKE '%Miami%' THEN 'miami school of law' WHEN education LIKE 'JD, Ohio%' THEN 'jd ohio state university' END AS s,
  nullif(regexp_extract(education, '(\\d{{4}})$', 1), '') AS y, substr(bar_admission_date, 1, 4) AS b, substr(appointment_date, 4, 4) AS a FROM records),
  k AS (SELECT *, CASE WHEN s IS NOT NULL THEN 'edu' WHEN b IS NOT NULL THEN 'bar-year' WHEN a IS NOT NULL THEN 'appt' ELSE 'name' END AS kind,
    (CASE WHEN coalesce(county, '') <> '' THEN 1 ELSE 0 END) + (coalesce(education, '') <> '')::INT + (bar_admission_date IS NOT NULL)::INT + (appointment_date IS NOT NULL)::INT
    + (coalesce(photo_url, '') <> '')::INT + (division IS NOT NULL)::INT AS rich FROM p),
  i AS (SELECT *, kind || ':' || substr(sha256(lower(CASE kind WHEN 'edu' THEN concat_ws('|', n, s, y) WHEN 'bar-year' THEN concat_ws('|', n, b, state) WHEN 'appt' THEN concat_ws('|', n, a, court_type)
    ELSE concat_ws('|', n, court_type, county) END)), 1, 16) AS identity, CASE kind WHEN 'appt' THEN 'medium' WHEN 'name' THEN 'low' ELSE 'high' END AS tier FROM k) """
_SCORED = """, scored AS (SELECT *, least(0.95, CASE source_authority WHEN 'OFFICIAL_GOV' THEN 0.65 WHEN 'COURT_WEBSITE' THEN 0.55 ELSE 0.45 END::DOUBLE + CASE WHEN extraction_method = 'deterministic' THEN 0.1 ELSE 0 END::DOUBLE
  + 0.05::DOUBLE * ((coalesce(photo_url, '') <> '')::INT + (coalesce(education, '') <> '')::INT + (coalesce(prior_experience, '') <> '')::INT)) AS new_score FROM base),
  out AS (SELECT *, new_score >= CASE source_authority WHEN 'OFFICIAL_GOV' THEN 0.7 WHEN 'COURT_WEBSITE' THEN 0.75 ELSE 0.8 END::DOUBLE AS promoted FROM scored) """
# The fold of R8 as a recursion: the i-th records of all keys meet what was merged before them.
_FIELDS = ["full_name", "court_type", "county", "state", "education", "bar_admission_date", "appointment_date", "photo_url", "division", "confidence"]
_RECORD = ", ".join(_FIELDS)
_SCORE = lambda r: " + ".join(f"CASE WHEN coalesce({r}.{c}, '') <> '' THEN 1 ELSE 0 END" for c in _FIELDS if c not in ("state", "confidence"))
_FILL = ["education", "bar_admission_date", "appointment_date", "photo_url", "division"]
_PICK = lambda a, b: ", ".join(f"'{c}': " + (f"coalesce({a}.{c}, {b}.{c})" if c in _FILL else f"greatest({a}.{c}, {b}.{c})" if c == "confidence" else f"{a}.{c}") for c in ["seq", *_FIELDS])
_FOLDED = (
    "WITH RECURSIVE " + sql("records") + f""", k AS (SELECT lower(trim(full_name)) || '|' || lower(trim(court_type)) || '|' || coalesce(county, '') AS key, * FROM records WHERE seq IS NOT NULL),
  r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, count(*) OVER (PARTITION BY key) AS size, {{{', '.join(f"'{c}': {c}" for c in ["seq", *_FIELDS])}}} AS r FROM k),
  s(key, i, size, m, d) AS (SELECT key, i, size, r, NULL::STRUCT({', '.join(f"{c} {'BIGINT' if c == 'seq' else 'DOUBLE' if c == 'confidence' else 'VARCHAR'}" for c in ["seq", *_FIELDS])}) FROM r WHERE i = 1
    UNION ALL SELECT r.key, r.i, r.size, CASE WHEN ({_SCORE('r.r')}) > ({_SCORE('s.m')}) THEN {{{_PICK('r.r', 's.m')}}} ELSE {{{_PICK('s.m', 'r.r')}}} END, CASE WHEN ({_SCORE('r.r')}) > ({_SCORE('s.m')}) THEN s.m ELSE r.r END
    FROM s JOIN r ON r.key = s.key AND r.i = s.i + 1), f AS (SELECT key, i, size, d, unnest(m) FROM s) """
)
SQL = {
    "r6_identity": _IDENTITY + "SELECT seq, identity, tier FROM i",
    "r7_merged": _IDENTITY + """, o AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rich DESC, seq) AS k FROM i)
      SELECT identity, arg_min(full_name, k) AS full_name, arg_min(education, k) FILTER (education <> '') AS education, arg_min(photo_url, k) FILTER (photo_url <> '') AS photo_url, arg_min(division, k) FILTER (division IS NOT NULL) AS division,
      arg_min(seq, k) AS kept_seq, count(*) - 1 AS merged FROM o GROUP BY identity""",
    "r7_duplicates": _IDENTITY + ", o AS (SELECT identity, seq, first_value(seq) OVER (PARTITION BY identity ORDER BY rich DESC, seq) AS kept_seq FROM i) SELECT * FROM o WHERE seq <> kept_seq",
    "r10_stats": _IDENTITY + "SELECT tier, count(*) AS n FROM i GROUP BY tier",
    "r8_merged": _FOLDED + f"SELECT {_RECORD}, seq AS kept_seq, i - 1 AS merged FROM f WHERE i = size",
    "r8_duplicates": _FOLDED + f"SELECT {', '.join(f'd.{c} AS {c}' for c in _FIELDS)}, d.seq AS seq, seq AS duplicate_of FROM f WHERE i > 1".replace("d.seq AS seq, seq AS", "d.seq AS seq, f.seq AS"),
    "r12_rescored": _W("judges") + ", base AS (SELECT * FROM judges WHERE status = 'UNVERIFIED' OR status = 'NEEDS_REVIEW' AND NOT flagged)" + _SCORED + "SELECT judge_id, round(new_score, 6) AS new_score, promoted FROM out",
    "a21_tally": f"WITH {CHAIN_SQL}, base AS (SELECT * FROM chain WHERE status IN ('UNVERIFIED', 'NEEDS_REVIEW'))" + _SCORED + "SELECT source_authority, state_abbr, count(*) AS seen, count_if(promoted) AS promoted FROM out GROUP BY GROUPING SETS ((source_authority), (state_abbr), ())",
    "a14_coverage": _W("records") + """, u AS (SELECT 'county' AS field, count_if(county <> '') AS filled, count(*) AS total FROM records UNION ALL SELECT 'education', count_if(education <> ''), count(*) FROM records
      UNION ALL SELECT 'photo_url', count_if(photo_url <> ''), count(*) FROM records UNION ALL SELECT 'division', count_if(division <> ''), count(*) FROM records)
      SELECT total, field, filled, floor(filled::DOUBLE / total * 1000 + 0.5) / 10 AS percent FROM u""",
    "r15_gate": _W("records") + """, r AS (SELECT state, avg((division IS NULL)::INT) AS f, avg(coalesce(photo_url = '', false)::INT) AS z, avg((county IS NULL)::INT) AS m, avg((confidence < 0.02)::INT) AS c FROM records GROUP BY state),
      s AS (SELECT state, CASE WHEN f > 0.25 THEN 2 WHEN f > 0.1 THEN 1 ELSE 0 END AS f, CASE WHEN z > 0.3 THEN 2 WHEN z > 0.15 THEN 1 ELSE 0 END AS z, CASE WHEN m > 0.4 THEN 2 WHEN m > 0.2 THEN 1 ELSE 0 END AS m, CASE WHEN c > 0.05 THEN 2 WHEN c > 0.02 THEN 1 ELSE 0 END AS c FROM r)
      SELECT state, ['PASS', 'WARNING', 'CRITICAL'][m + 1] AS missing_county_severity, ['PASS', 'WARNING', 'CRITICAL'][c + 1] AS core_incomplete_severity, ['PASS', 'WARNING', 'CRITICAL'][greatest(f, z, m, c) + 1] AS verdict FROM s""",
    "j7_zero_counties": _W("records") + "SELECT 'COUNTY ' || i AS county FROM range(30) t(i) WHERE lower('COUNTY ' || i) NOT IN (SELECT lower(county) FROM records WHERE county IS NOT NULL AND division = 'N')",
    "j16_counties": _W("counties") + "SELECT upper(replace(name, '_', ' ')) AS county, county_id, true AS right FROM counties",
    "r17_courts": _W("counties", "courts") + """, h AS (SELECT state_id, min(name) AS hq FROM counties WHERE state_id < 3 GROUP BY 1), r AS (SELECT c.*, k.name, k.state_id, q.county_id AS seat FROM courts c JOIN counties k USING (county_id)
      LEFT JOIN (SELECT h.state_id, k2.county_id FROM h JOIN counties k2 ON k2.name = h.hq AND k2.state_id = h.state_id) q ON q.state_id = k.state_id)
      SELECT court_id AS row_id, CASE type WHEN 'BUILDING' THEN seat WHEN 'AUTOMOBILE' THEN county_id END AS county_id, CASE WHEN type IN ('MACHINERY', 'HOUSEHOLD') OR type = 'BUILDING' AND seat IS NULL THEN 'Statewide' END AS placeholder,
      CASE WHEN type = 'FURNITURE' THEN 'County not found: Nowhere' END AS error FROM r""",
    "j19_authority": _W("judges") + "SELECT judge_id, CASE WHEN source_url IS NULL THEN 'SECONDARY' WHEN contains(source_url, '.gov/') THEN 'OFFICIAL_GOV' WHEN contains(source_url, '//court1.org/') OR contains(source_url, '//court10.org/') THEN 'COURT_WEBSITE' ELSE 'SECONDARY' END AS authority FROM judges",
    "k1_upsert": _W("judges") + """, a AS (SELECT judge_id, full_name, photo_url, CASE WHEN status = 'NEEDS_REVIEW' AND photo_url IS NOT NULL THEN 'updated' ELSE 'kept' END AS change, status FROM judges),
      b AS (SELECT change, status, full_name, CASE WHEN change = 'updated' THEN 'new.jpg' ELSE photo_url END AS photo FROM a UNION ALL SELECT 'new', 'UNVERIFIED', NULL, 'new.jpg' FROM judges WHERE status = 'NEEDS_REVIEW' AND photo_url IS NULL)
      SELECT change, status, count(*) AS n, count(full_name) AS named, count_if(coalesce(photo, '') = 'new.jpg') AS photos FROM b GROUP BY 1, 2""",
    "k1_bucketed_writes": _W("judges") + """, a AS (SELECT judge_id, full_name, status, CASE WHEN status = 'NEEDS_REVIEW' AND photo_url IS NOT NULL THEN 'new.jpg' ELSE photo_url END AS photo_url FROM judges
        UNION ALL SELECT judge_id + 10000000, NULL, 'UNVERIFIED', 'new.jpg' FROM judges WHERE status = 'NEEDS_REVIEW' AND photo_url IS NULL),
      b AS (SELECT judge_id, full_name, CASE WHEN full_name = 'Ann Lee' THEN 'VERIFIED' ELSE status END AS status, photo_url FROM a) SELECT * FROM b WHERE status <> 'REJECTED'""",
    "a2_maintained": f"WITH {CHAIN_SQL}" + """, c AS (SELECT state, flagged, CASE WHEN judge_id % 3 = 1 AND status = 'UNVERIFIED' THEN 'VERIFIED' ELSE status END AS status FROM chain WHERE status <> 'REJECTED')
      SELECT state, count_if(status = 'VERIFIED') AS verified, count_if(flagged) AS flagged, count(*) AS n FROM c GROUP BY state""",
    "k7_insert_if_absent": _W("candidates") + "SELECT url, min(candidate_id) AS candidate_id FROM candidates WHERE url NOT IN (SELECT url FROM candidates WHERE status = 'PROMOTED') GROUP BY url",
    "k10_downgraded": _W("candidates") + "SELECT candidate_id, CASE WHEN scrape_worthy AND last_yield = 0 AND harvest_attempts >= 2 THEN false ELSE scrape_worthy END AS scrape_worthy FROM candidates",
    "k12_cascade": _W("courts", "judges") + "SELECT status, count(*) AS n FROM judges JOIN courts USING (court_id) WHERE type <> 'BUILDING' GROUP BY status",
    "k14_promotion": _W("candidates") + "SELECT url, min(state_abbr) AS state_abbr, 0.5::DOUBLE AS health_score FROM candidates WHERE status = 'APPROVED' AND url NOT IN (SELECT url FROM candidates WHERE scrape_worthy IS NULL) GROUP BY url",
    "r22_transitions": _W("judges") + """, t AS (SELECT CASE WHEN status = 'UNVERIFIED' THEN CASE WHEN judge_id % 2 = 0 THEN 'VERIFIED' ELSE 'REJECTED' END END AS new_status,
      CASE WHEN status <> 'UNVERIFIED' THEN 'cannot ' || CASE WHEN judge_id % 2 = 0 THEN 'verify' ELSE 'reject' END || ' from ' || status END AS error FROM judges) SELECT new_status, error, count(*) AS n FROM t GROUP BY 1, 2""",
    "r21_auto_status": _W("candidates") + "SELECT candidate_id, CASE WHEN scrape_worthy THEN 'APPROVED' WHEN NOT scrape_worthy THEN 'REJECTED' ELSE 'DISCOVERED' END AS status FROM candidates",
    "e10_worthy": "SELECT d.doc_id, CASE WHEN q >= 0.7 AND t = 0 THEN true WHEN q < 0.3 OR t <> 0 THEN false END AS worthy FROM documents d LEFT JOIN (SELECT doc_id, avg(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
    "j20_similar_people": _W("records") + f""", n AS (SELECT state, county, {_N} AS name, count(*) AS n FROM records WHERE full_name IS NOT NULL GROUP BY ALL),
      p AS (SELECT a.state, a.county, a.name AS name_a, b.name AS name_b, a.n AS records_a, b.n AS records_b, 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS s
        FROM n a JOIN n b ON a.state = b.state AND a.county IS NOT DISTINCT FROM b.county AND a.name < b.name)
      SELECT state, county, name_a, name_b, records_a, records_b, round(s, 6) AS similarity FROM p WHERE s >= 0.7 - 1e-12""",
    "t16_similarity": """WITH w AS (SELECT *, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type) || ' ring bolt', ' ')) AS b FROM part)
      SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS edit, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)), 6) AS overlap FROM w""",
    "t5_names": _W("records") + "SELECT seq, regexp_replace(full_name, '^(Hon[.]|Judge) ', '') AS name, regexp_replace(full_name, '^(Hon[.]|Judge) ', '') AS roster FROM records",
    "t9_courts": _W("records") + """SELECT seq, CASE court_type WHEN 'Supreme Court' THEN 'Supreme Court' WHEN 'Circuit Court' THEN 'Circuit Court' ELSE 'County Court' END
      AS kind, CASE WHEN court_type = 'Supreme Court' THEN 'SUPREME' END AS level FROM (SELECT *, seq % 2 = 0 AS even FROM records)""",
    "t11_scalars": _W("counties") + "SELECT county_id, lower(name) AS key, lower(replace(name, '_', '')) || 'county' AS alnum, name AS seed, lower(replace(name, '_', '-')) || '-county' AS slug, upper(slug[1]) || replace(slug[2:], '-', ' ') AS title FROM counties",
    "m2_rounding": _W("judges") + "SELECT judge_id, floor(confidence * 100 + 0.5) / 100 AS r, greatest(0, least(1, confidence * 4 - 1)) AS c, CASE WHEN judge_id % 2 > 0 THEN confidence / (judge_id % 2) ELSE 0 END AS q, coalesce(nullif(photo_url, ''), 'none') AS photo FROM judges",
    "c1_by_county": _W("records") + "SELECT seq, unnest(CASE WHEN county IS NULL AND seq % 3 > 0 AND seq % 2 > 0 THEN ['A', 'B'] ELSE [county] END) AS county FROM records",
}
