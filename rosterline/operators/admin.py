"""What the back office does: validation, reviews, look-ups, labels and small listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import slug
from rosterline.operators.rules import transitions
from rosterline.operators.search import broadcast_if_small, numbered
from rosterline.operators.slugs import renamed

#: Most judges in a batch, days after which a harvest is stale, most jobs on a page.
BATCH, FRESH_DAYS, JOB_PAGE = 50, 90, 100
OPTIONAL = ["term_start", "term_end", "selection_method", "appointing_authority", "education", "prior_experience", "political_affiliation"]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def validated(submissions: DataFrame, courts: DataFrame) -> DataFrame:
    """submissions(full_name, court_id, source_url, ...) with errors, an array of (field, message), empty for valid ones.

    The court is only looked up where the required fields are there. Names and urls are trimmed, empty optional
    fields become null; a valid one gets a slug before collisions are settled.
    """
    known = courts.select(F.col("court_id").alias("_court")).distinct()
    rows = submissions.join(known, F.col("court_id") == F.col("_court"), "left")
    needs = [("full_name", _blank("full_name"), "Full name is required"), ("court_id", F.col("court_id").isNull(), "Court is required"), ("source_url", _blank("source_url"), "Source URL is required")]
    error = lambda field, message: F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))
    missing = F.filter(F.array(*(F.when(bad, error(field, message)) for field, bad, message in needs)), lambda x: x.isNotNull())
    rows = rows.withColumn("errors", F.when(F.size(missing) > 0, missing).when(F.col("_court").isNull(), F.array(error("court_id", "Court not found"))).otherwise(F.array().cast(missing_type())))
    cleaned = {c: F.nullif(F.col(c), F.lit("")) for c in OPTIONAL if c in submissions.columns}
    cleaned |= {c: F.trim(c) for c in ("full_name", "source_url")}
    return rows.withColumns(cleaned).withColumn("slug", F.when(F.size("errors") == 0, slug(F.col("full_name")))).drop("_court")


def missing_type() -> str:
    return "array<struct<field:string,message:string>>"


def partially_updated(judges: DataFrame, changes: DataFrame) -> DataFrame:
    """Judges after changes(judge_id, set array of the fields that are given, values); only given fields change, given empty ones become null.

    A given but empty name is refused: error tells so and nothing of that row changes; a change without a judge has an error too.
    Where judges have slug and court_id, a row that is given a name gets the least free slug in its (new) court, one after
    another by judge_id. At most one change per judge.
    """
    given = [c for c in changes.columns if c not in ("judge_id", "set")]
    new = changes.select(F.col("judge_id").alias("_id"), F.col("set").alias("_set"), *(F.col(c).alias(f"_{c}") for c in given))
    rows = judges.join(new, F.col("judge_id") == F.col("_id"), "full")
    refused = F.coalesce(F.array_contains("_set", "full_name"), F.lit(False)) & _blank("_full_name") if "full_name" in given else F.lit(False)
    error = F.when(F.col("judge_id").isNull(), "Judge not found").when(refused, "Full name cannot be empty")
    change = lambda c: F.coalesce(F.array_contains("_set", c), F.lit(False)) & error.isNull()
    columns = {c: F.when(change(c), F.nullif(F.trim(f"_{c}"), F.lit(""))).otherwise(F.col(c)) for c in given}
    out = rows.withColumn("error", error).withColumns(columns).select(F.coalesce("judge_id", "_id").alias("judge_id"), *(c for c in judges.columns if c != "judge_id"), "error")
    if not {"slug", "court_id"} <= set(judges.columns) or "full_name" not in given:
        return out
    told = lambda c, value: F.when(F.array_contains("_set", c), value) if c in given else F.lit(None).cast("string")
    name = told("full_name", F.trim("_full_name"))
    court = told("court_id", F.col("_court_id")) if "court_id" in given else F.lit(None).cast(judges.schema["court_id"].dataType)
    asked = new.filter(~(F.coalesce(F.array_contains("_set", "full_name"), F.lit(False)) & _blank("_full_name"))).select(F.col("_id").alias("judge_id"), court.alias("new_scope"), name.alias("new_name"))
    found = renamed(judges.select("judge_id", "court_id", "slug"), asked.filter("new_name is not null or new_scope is not null"), "judge_id", "court_id").select(F.col("id").alias("_id"), F.col("slug").alias("_new"))
    return out.join(found, F.col("judge_id") == F.col("_id"), "left").withColumn("slug", F.coalesce("_new", "slug")).drop("_id", "_new")


def batch_transitions(items: DataFrame, most: int = BATCH) -> DataFrame:
    """items(batch, n, id, status, action) in their order n; a batch of more than `most` is refused as a whole."""
    sizes = items.groupBy(F.col("batch").alias("_batch")).agg(F.count("*").alias("_size"))
    rows = transitions(items).join(sizes, F.col("batch") == F.col("_batch")).drop("_batch")
    late = F.col("_size") > most
    error = F.when(late, f"Maximum {most} judges per batch request.").otherwise(F.col("error"))
    return rows.withColumns({"new_status": F.when(~late, F.col("new_status")), "error": error}).drop("_size")


def reviewed(candidates: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """reviews(candidate_id, action, reason) with the candidate's new status, times, and error; a rejection needs a reason."""
    known = candidates.select(F.col("candidate_id").alias("_id"))
    rows = reviews.join(known, F.col("candidate_id") == F.col("_id"), "left")
    error = (
        F.when(~F.coalesce(F.col("action").isin("approve", "reject"), F.lit(False)), "Invalid action. Must be 'approve' or 'reject'.")
        .when((F.col("action") == "reject") & F.coalesce(F.col("reason") == "", F.lit(True)), "Rejection reason is required")
        .when(F.col("_id").isNull(), "Candidate not found")
    )
    approved = error.isNull() & (F.col("action") == "approve")
    return rows.select(
        "candidate_id",
        F.when(approved, "APPROVED").when(error.isNull(), "REJECTED").alias("status"),
        F.when(error.isNull() & (F.col("action") == "reject"), F.col("reason")).alias("rejection_reason"),
        F.when(error.isNull(), now).alias("reviewed_at"),
        F.when(approved, now).alias("promoted_at"),
        error.alias("error"),
    )


def health_actions(health: DataFrame, actions: DataFrame) -> DataFrame:
    """health(url, active, anomaly, anomaly_message) after actions(url, action): dismiss-anomaly, deactivate, reactivate."""
    asked = actions.groupBy(F.col("url").alias("_u")).agg(F.collect_set("action").alias("_a"))
    rows = health.join(asked, F.col("url") == F.col("_u"), "left")
    has = lambda a: F.coalesce(F.array_contains("_a", a), F.lit(False))
    dismissed = has("dismiss-anomaly")
    columns = {
        "active": F.when(has("deactivate"), False).when(has("reactivate"), True).otherwise(F.col("active")),
        "anomaly": F.when(dismissed, False).otherwise(F.col("anomaly")),
        "anomaly_message": F.when(~dismissed, F.col("anomaly_message")),
    }
    return rows.withColumns(columns).drop("_u", "_a")


def resolved_by_hand(logs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests(log_id, resolved_by, notes) against logs(log_id, resolved_at): code 200, 404 or 409 (already resolved), and what is written."""
    known = logs.select(F.col("log_id").alias("_id"), F.col("resolved_at").alias("_at"))
    rows = requests.join(known, F.col("log_id") == F.col("_id"), "left")
    code = F.when(F.col("_id").isNull(), 404).when(F.col("_at").isNotNull(), 409).otherwise(200)
    done = code == 200
    by = F.coalesce(F.nullif(F.col("resolved_by"), F.lit("")), F.lit("admin"))
    return rows.select("log_id", code.alias("code"), F.when(done, now).otherwise(F.col("_at")).alias("resolved_at"), F.when(done, by).alias("resolved_by"), F.when(done, F.col("notes")).alias("notes"))


def with_optional_parent(rows: DataFrame, parents: DataFrame, on: str, columns: list[str], name: str) -> DataFrame:
    """Rows with a struct of the parent's columns, null for rows without a parent."""
    own = parents.select(F.col(on).alias("_on"), F.struct(*columns).alias(name))
    return rows.join(own, F.col(on) == F.col("_on"), "left").drop("_on")


def job_page(jobs: DataFrame, state: str | None = None, statuses: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Jobs newest first, `limit` (100 at most, no least) from offset on; statuses are parted by commas, in any case."""
    if state:
        jobs = jobs.filter(F.col("state_abbr") == state.upper())
    wanted = [s.strip().upper() for s in (statuses or "").split(",") if s.strip()]
    if wanted:
        jobs = jobs.filter(F.col("status").isin(wanted))
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(min(limit, JOB_PAGE))


def active_first(states: DataFrame) -> DataFrame:
    """States with an active job first, each part by name."""
    return states.orderBy(F.desc("active"), "name")


def lookup(parents: DataFrame, children: DataFrame, key: str, value: object, columns: list[str], order: str) -> DataFrame:
    """The children of one parent in order; none where there is no such parent."""
    one = parents.filter(F.col(key) == F.lit(value)).select(F.col(key).alias("_k"))
    return children.join(broadcast_if_small(one.limit(1)), F.col(key) == F.col("_k"), "left_semi").select(*columns).orderBy(order)


def found_by_key(rows: DataFrame, **key: object) -> DataFrame:
    """The row of a unique key (several columns for a compound one), no row if there is none."""
    for column, value in key.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows.limit(1)


def freshness(states: DataFrame, manifests: DataFrame, as_of: Column, days: int = FRESH_DAYS) -> DataFrame:
    """states(slug) with their manifest(slug, last_completed_at, judge_count): stale after so many whole days, or without one."""
    own = manifests.select(F.col("slug").alias("_slug"), F.col("last_completed_at").cast("timestamp").alias("last_completed_at"), "judge_count")
    rows = states.join(own, F.col("slug") == F.col("_slug"), "left")
    age = F.floor((as_of.cast("double") - F.col("last_completed_at").cast("double")) / 86400.0)
    return rows.withColumns({"has_manifest": F.col("_slug").isNotNull(), "days_since": age, "is_stale": F.coalesce(age > days, F.lit(True))}).drop("_slug")


def circuit_labels(counties: DataFrame, entries: DataFrame) -> DataFrame:
    """counties(county) with the label of the first circuit court of entries(ordinal, court_type, label, counties) that holds it, and the report's line."""
    named = entries.filter("court_type = 'Circuit Court'").select("ordinal", "label", F.explode("counties").alias("_c"))
    first = named.groupBy(F.lower("_c").alias("_county")).agg(F.min_by("label", "ordinal").alias("circuit"))
    rows = counties.join(first, F.lower("county") == F.col("_county"), "left").drop("_county")
    return rows.withColumn("line", F.concat(F.lit("- "), F.col("county"), F.coalesce(F.concat(F.lit(" ("), F.col("circuit"), F.lit(")")), F.lit(""))))


def aligned(rows: DataFrame, first: str, second: str) -> DataFrame:
    """The elements of two arrays that belong together by place: pos, first, second; the shorter one is filled with nulls."""
    pairs = F.posexplode(F.arrays_zip(F.col(first).alias("a"), F.col(second).alias("b")))
    return rows.select(*(c for c in rows.columns if c not in (first, second)), pairs.alias("pos", "_p")).select("*", F.col("_p.a").alias(first), F.col("_p.b").alias(second)).drop("_p")


def batch_numbers(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Rows with the number of their batch of `size`, from 1, in the given order."""
    return numbered(rows, [F.col(c) for c in order], "batch").withColumn("batch", F.ceil(F.col("batch") / size).cast("int"))


def first_rows(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first rows in an order, all without a limit."""
    return rows if most is None else rows.orderBy(*order).limit(most)
