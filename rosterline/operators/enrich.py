"""Filling records from further sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.values import bar_date

#: Fields whose absence makes a record worth enriching.
WANTED = ["education", "photo_url", "appointing_authority", "prior_experience", "bar_admission_date", "term_start", "political_affiliation"]


def empty(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def with_provenance(records: DataFrame, fields: list[str]) -> DataFrame:
    """from_roster: the names of the fields that the roster gave."""
    return records.withColumn("from_roster", F.filter(F.array(*(F.when(~empty(c), F.lit(c)) for c in fields)), lambda x: x.isNotNull()))


def bio_filled(records: DataFrame, bios: DataFrame, fields: list[str], drop_unfetched: bool = False) -> DataFrame:
    """records(bio_page_url, ...) with the non-empty fields of bios(url, fetched, ...) and from_bio, their names.

    A bio without a body leaves its record as it was; drop_unfetched drops such a record.
    """
    b = bios.select(F.col("url").alias("_url"), "fetched", *(F.nullif(F.col(c), F.lit("")).alias(f"_b_{c}") for c in fields))
    out = records.join(b, records.bio_page_url == F.col("_url"), "left")
    if drop_unfetched:
        out = out.filter(F.col("_url").isNull() | F.col("fetched"))
    took = F.filter(F.array(*(F.when(F.col(f"_b_{c}").isNotNull(), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    out = out.withColumns({**{c: F.coalesce(f"_b_{c}", c) for c in fields}, "from_bio": F.coalesce(took, F.array().cast("array<string>"))})
    return out.drop("_url", "fetched", *(f"_b_{c}" for c in fields))


def needs_enrichment(threshold: float = 0.75, missing: int = 2) -> Column:
    """a score below the threshold and at least so many wanted fields empty."""
    return (F.col("confidence") < threshold) & (sum((empty(c).cast("int") for c in WANTED), F.lit(0)) >= missing)


def filled_from(records: DataFrame, source: DataFrame, keys: list[str], fields: list[str], provenance: str | None = None, unless: str | None = None) -> DataFrame:
    """Empty fields filled from source, one row a key; provenance: an array column that gets their names.

    unless: a column that must be empty for anything to be taken over.
    """
    s = source.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(*(F.min(F.nullif(F.col(c), F.lit(""))).alias(f"_s_{c}") for c in fields))
    out = records.join(s, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left")
    may = empty(unless) if unless else F.lit(True)
    take = {c: may & empty(c) & F.col(f"_s_{c}").isNotNull() for c in fields}
    new = {c: F.when(t, F.col(f"_s_{c}")).otherwise(F.col(c)) for c, t in take.items()}
    if provenance:
        names = F.filter(F.array(*(F.when(t, F.lit(c)) for c, t in take.items())), lambda x: x.isNotNull())
        new[provenance] = F.array_union(F.coalesce(F.col(provenance), F.array().cast("array<string>")), names)
    return out.withColumns(new).drop(*(f"_k_{k}" for k in keys), *(f"_s_{c}" for c in fields))


def bar_filled(records: DataFrame, bar: DataFrame) -> DataFrame:
    """Bar admission from bar(full_name, year, school): the year's first day, and the school as education."""
    rows = bar.select("full_name", bar_date(F.col("year")).alias("bar_admission_date"), F.col("school").alias("education"))
    return filled_from(records, rows, ["full_name"], ["bar_admission_date", "education"])


def highlights(hits: DataFrame) -> DataFrame:
    """hits(url, results array<struct<highlights array<string>>>) with one row per highlight."""
    return hits.select("url", F.explode(F.flatten(F.transform("results", lambda r: r.highlights))).alias("highlight"))
