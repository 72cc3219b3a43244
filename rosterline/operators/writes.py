"""Upserts, updates and deletes as rewrites of tables.

Each function returns the table as it is afterwards; the caller writes it. With a catalog
that has MERGE the same conditions go into its clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import slug

#: Columns that an update takes over even when they are null.
PASSED_THROUGH = ["photo_url", "is_chief", "source_url", "roster_url", "source_authority", "extraction_method", "confidence"]
KEEPS_STATUS = ["status"]


def upserted(target: DataFrame, source: DataFrame, keys: list[str], passed: list[str] = PASSED_THROUGH) -> DataFrame:
    """K1: target after an upsert of source, with `change`: new, updated or kept.

    Source rows must be unique in their keys. New rows start as UNVERIFIED; an updated one
    keeps its status, and null values of the source overwrite only the passed columns. Columns that
    source lacks stay.
    """
    s = source.select(*(F.col(c).alias(f"_s_{c}") for c in source.columns), F.lit(True).alias("_new"))
    t = target.withColumn("_old", F.lit(True))
    both = t.join(s, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "full")

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.when(F.col("_old").isNull(), "UNVERIFIED").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
        if c in passed:
            return F.when(F.col("_new"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"_s_{c}", c).alias(c)

    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new"), "updated").otherwise("kept")
    return both.select(*(value(c) for c in target.columns), change.alias("change"))


def inserted_if_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The rows of source to append: keys not in target, one row a key, the first by all columns."""
    fresh = source.join(target.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    others = [c for c in source.columns if c != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in others)).select(source.columns)


def updated_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The table with values set where the condition holds, and `touched`."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({**{c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}, "touched": hit})


def purged(logs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Logs without those whose failure was resolved longer ago than this."""
    old = F.col("resolved_at").cast("timestamp").cast("double") < as_of.cast("double") - days * 86400.0
    return logs.filter(~F.coalesce(old, F.lit(False)))


def deleted_cascade(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Parents without those that fit, children without those of them."""
    gone = parents.filter(condition).select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def set_null(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is gone, with a null reference."""
    there = parents.select(F.col(parent_key).alias("_p")).distinct()
    out = children.join(there, F.col(key) == F.col("_p"), "left")
    return out.withColumn(key, F.when(F.col("_p").isNotNull(), F.col(key))).drop("_p").select(children.columns)


def promoted(candidates: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New configuration entries, the candidates afterwards, and health rows of 0.5 to seed."""
    ready = candidates.filter("status = 'APPROVED'")
    entries = inserted_if_absent(configured.select("url"), ready.select("url", "state_abbr"), "url")
    after = updated_where(candidates, F.col("status") == "APPROVED", status=F.lit("PROMOTED"))
    return entries, after, entries.select("url", "state_abbr", F.lit(0.5).alias("health_score"))


def seeded_courts(config: DataFrame, counties: DataFrame, existing: DataFrame) -> DataFrame:
    """Courts to add from config(state_id, court_type, level, counties, hq): trial courts per county, others at their seat.

    Without a seat the first listed county stands in, then the first of the state by name.
    """
    many = F.col("level").isin("trial", "specialized") & (F.size("counties") > 0)
    seat = F.coalesce("hq", F.get("counties", F.lit(0)))
    rows = config.select("state_id", "court_type", "level", F.explode(F.when(many, F.col("counties")).otherwise(F.array(seat))).alias("county"))
    first = counties.groupBy("state_id").agg(F.min_by("county_id", "name").alias("_any"))
    named = counties.select("state_id", "county_id", F.lower("name").alias("_n"))
    placed = rows.withColumn("_n", F.lower(F.trim("county"))).join(named, ["state_id", "_n"], "left").join(first, "state_id", "left")
    placed = placed.select(F.coalesce("county_id", F.when(F.col("county").isNull(), F.col("_any"))).alias("county_id"), "court_type", "level", slug(F.col("court_type")).alias("slug"))
    return placed.filter("county_id is not null").distinct().join(existing.select("county_id", "slug"), ["county_id", "slug"], "left_anti")
