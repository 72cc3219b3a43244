"""Who is who: identity keys, merging of duplicates, scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from rosterline.functions.text import county_key, edit_similarity, graduation_year, identity_hash, identity_name, law_school
from rosterline.functions.values import loose_year
from rosterline.operators.folds import ordered_fold

# The bases, thresholds and steps of the confidence score.
BASES = {"OFFICIAL_GOV": 0.65, "COURT_WEBSITE": 0.55, "ELECTION_RECORDS": 0.55, "SECONDARY": 0.45}
THRESHOLDS = {"OFFICIAL_GOV": 0.70, "COURT_WEBSITE": 0.75, "ELECTION_RECORDS": 0.75, "SECONDARY": 0.80}
BIO_FIELDS = ["photo_url", "term_start", "term_end", "appointing_authority", "education", "prior_experience", "courthouse_address", "courthouse_phone"]
# Text columns in which a later record fills what an earlier one leaves open.
FILLED = [
    "photo_url", "division", "term_start", "term_end", "selection_method", "appointing_authority", "appointment_date", "birth_date", "education",
    "prior_experience", "political_affiliation", "bar_admission_date", "bar_admission_state", "courthouse_address", "courthouse_phone", "bio_page_url",
]


def with_identity(records: DataFrame) -> DataFrame:
    """Identity, tier and basis: school and year, else bar year and state, else appointment and court, else name, court and county."""
    def parts(r: Column) -> Column:
        name, school, year = identity_name(r.full_name), law_school(r.education), graduation_year(r.education)
        return F.struct(name.alias("n"), school.alias("s"), year.alias("y"), loose_year(r.bar_admission_date).alias("b"), loose_year(r.appointment_date).alias("a"))

    # patterns inside a lambda stay out of the generated code, whose methods would else be too large to be compiled; the
    # generator keeps the parts from being written into each of their uses, so every pattern is asked once a row
    source = F.struct("full_name", "education", "bar_admission_date", "appointment_date")
    df = records.withColumn("_p", F.explode(F.transform(F.array(source), parts))).withColumns({f"_{c}": F.col(f"_p.{c}") for c in "nsyba"}).drop("_p")
    has = lambda *cs: F.coalesce(F.array_min(F.array(*(F.coalesce(F.col(c) != "", F.lit(False)) for c in cs))), F.lit(False))
    edu, bar, appt = has("_s", "_y"), has("_b", "state"), has("_a", "court_type")
    key = lambda prefix, *cs: F.concat(F.lit(prefix), identity_hash(*(F.col(c) for c in cs)))
    df = df.withColumns(
        {
            "identity": F.when(edu, key("edu:", "_n", "_s", "_y")).when(bar, key("bar-year:", "_n", "_b", "state")).when(appt, key("appt:", "_n", "_a", "court_type"))
            .otherwise(key("name:", "_n", "court_type", "county")),
            "tier": F.when(edu | bar, "high").when(appt, "medium").otherwise("low"),
            "basis": F.when(edu, "gradYear+lawSchool+normalizedName").when(bar, "barYear+normalizedName+state").when(appt, "appointmentYear+courtType+normalizedName")
            .otherwise("county+courtType+normalizedName"),
        }
    )
    return df.drop("_n", "_s", "_y", "_b", "_a")


def richness(columns: list[tuple[str, str]]) -> Column:
    """How many values are neither null nor empty nor false."""
    def has(name: str, kind: str) -> Column:
        c = F.col(name)
        told = c.isNotNull() & (c != "") if kind == "string" else F.coalesce(c, F.lit(False)) if kind == "boolean" else c.isNotNull()
        return told.cast("int")

    return sum((has(*c) for c in columns), F.lit(0))


def merged_by_identity(records: DataFrame) -> DataFrame:
    """One record per identity: the richest (then the first by seq), its empty values filled by the next richest that has one.

    One shuffle by identity. min_by over strings is a sorting aggregate: rows are sorted by identity on
    either side of the shuffle (spilling if need be), but those of one identity are only folded, and a hot one is
    folded before the shuffle.
    """
    data = [(c, t) for c, t in records.dtypes if c not in ("seq", "identity", "tier", "basis")]
    df = with_identity(records) if "identity" not in records.columns else records
    df = df.withColumn("_place", F.struct((-richness(data)).alias("r"), F.col("seq").alias("s")))
    def value(c: str, kind: str) -> Column:
        filled = F.nullif(F.col(c), F.lit("")) if kind == "string" else F.col(c)
        own = F.min_by(filled, F.when(filled.isNotNull(), F.col("_place")))
        return (own if kind not in ("boolean",) else F.min_by(F.col(c), F.col("_place"))).alias(c)

    rest = [F.min_by(F.col(c), F.col("_place")).alias(c) for c in ("tier", "basis")]
    return df.groupBy("identity").agg(*(value(*c) for c in data), *rest, F.min_by("seq", "_place").alias("kept_seq"), (F.count("*") - 1).alias("merged"))


def duplicates_by_identity(records: DataFrame) -> DataFrame:
    """Every record that went into another: its seq and that of the record kept."""
    data = [(c, t) for c, t in records.dtypes if c not in ("seq", "identity", "tier", "basis")]
    df = with_identity(records)
    place = Window.partitionBy("identity").orderBy(F.desc(richness(data)), "seq")
    kept = df.withColumns({"_n": F.row_number().over(place), "kept_seq": F.first("seq").over(place)})
    return kept.filter("_n > 1").select("identity", "seq", "kept_seq")


# The fields whose filled values make a record the richer one of two.
SCORED = ["full_name", "court_type", "county", *(c for c in FILLED if c != "bar_admission_state")]


def _merged(first: dict, second: dict, columns: list[str], arrays: list[str], maximum: str) -> dict:
    """first with its nulls filled from second, arrays united in order (X1), the higher score."""
    out = dict(first)
    for c in columns:
        if c in FILLED and out[c] is None:
            out[c] = second[c]
    for c in arrays:
        out[c] = list(dict.fromkeys([*(first[c] or []), *(second[c] or [])]))
    if maximum in out:
        out[maximum] = max((v for v in (first[maximum], second[maximum]) if v is not None), default=None)
    return out


def folded_by_key(records: DataFrame, maximum: str = "confidence") -> DataFrame:
    """The records of one lower-case name, court and county, folded in the order of seq.

    A record is compared with what has been merged so far: if it has more filled fields, it becomes the base and
    the merged one fills its nulls, else the other way round. Returns every record once more or less changed:
    the merged one of each key (duplicate_of null, merged: how many went into it) and each one that went into another, as it was
    then (duplicate_of: the seq of the base it went into). Empty texts count as not filled but aren't replaced.
    """
    none = F.lit("")
    key = F.concat_ws("|", F.lower(F.trim(F.coalesce("full_name", none))), F.lower(F.trim(F.coalesce("court_type", none))), county_key(F.coalesce("county", none)))
    columns = [c for c in records.columns if c != "seq"]
    arrays = [c for c, t in records.dtypes if t.startswith("array")]
    scored = [c for c in SCORED if c in columns]
    k, of, n = (free_name(x, records.columns) for x in ("_key", "duplicate_of", "merged"))
    schema = StructType([*records.schema.fields, StructField(of, records.schema["seq"].dataType), StructField(n, LongType())])

    def score(row: dict) -> int:
        return sum(row[c] is not None and row[c] != "" for c in scored)

    def step(state: dict, row: dict) -> Iterator[dict]:
        if "row" not in state:
            state |= {"row": row, "n": 0}
            return
        held, state["n"] = state["row"], state["n"] + 1
        base, other = (row, held) if score(row) > score(held) else (held, row)
        yield other | {of: base["seq"], n: None}
        state["row"] = _merged(base, other, columns, arrays, maximum)

    def end(state: dict) -> Iterator[dict]:
        yield state["row"] | {of: None, n: state["n"]}

    return ordered_fold(records.withColumn(k, key), [k], ["seq"], schema, dict, step, end)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def merged_by_key(records: DataFrame, maximum: str = "confidence") -> DataFrame:
    """One record per lower-case name, court and county, with kept_seq and merged; see folded_by_key()."""
    return folded_by_key(records, maximum).filter("duplicate_of is null").drop("duplicate_of").withColumnRenamed("seq", "kept_seq")


def identity_stats(records: DataFrame) -> DataFrame:
    """Records by tier and basis."""
    return with_identity(records).groupBy("tier", "basis").agg(F.count("*").alias("n"))


def same_person(pairs: DataFrame) -> DataFrame:
    """R11 over columns a and b (records as structs): confidence that they are one, null for no."""
    a, b = F.col("a"), F.col("b")
    alike = edit_similarity(identity_name(a.full_name), identity_name(b.full_name))
    schools, years = [law_school(x.education) for x in (a, b)], [graduation_year(x.education) for x in (a, b)]
    same = lambda f: F.coalesce((a[f] == b[f]) & (a[f] != ""), F.lit(False)).cast("int")
    both = F.coalesce((a.court_type == b.court_type) & a.county.eqNullSafe(b.county), F.lit(False)).cast("int")
    fields = both + same("bar_admission_date") + same("appointment_date")
    school = F.coalesce(schools[0] == schools[1], F.lit(False))
    score = (
        F.when((alike > 0.9) & school & F.coalesce(years[0] == years[1], F.lit(False)), 0.95)
        .when((alike > 0.9) & school, 0.85)
        .when((alike > 0.9) & (a.court_type == b.court_type), 0.75)
        .when((alike > 0.8) & (fields >= 1), 0.6 + fields * 0.1)
    )
    return pairs.withColumns({"similarity": alike, "confidence": score})


def _by_authority(values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in values.items() for x in p))[F.col("source_authority")], F.lit(default))


def bio_fields(columns: list[str] = BIO_FIELDS) -> Column:
    """R14."""
    return sum((F.coalesce((F.col(c) != "").cast("int"), F.lit(0)) for c in columns), F.lit(0))


def confidence(fields: Column) -> Column:
    """Base of the authority, 0.10 for deterministic extraction, 0.05 for each bio field, 0.95 at most."""
    extracted = F.when(F.col("extraction_method") == "deterministic", 0.10).otherwise(0.0)
    return F.least(F.lit(0.95), _by_authority(BASES, 0.45) + extracted + fields * F.lit(0.05))


def rescored(judges: DataFrame, fields: Column | None = None) -> DataFrame:
    """Unverified judges (and those in review without flags) with their new score; those at the threshold are promoted."""
    waiting = (F.col("status") == "UNVERIFIED") | ((F.col("status") == "NEEDS_REVIEW") & (F.size("anomaly_flags") == 0))
    df = judges.filter(waiting).withColumn("new_score", confidence(bio_fields() if fields is None else fields))
    return df.withColumn("promoted", F.col("new_score") >= _by_authority(THRESHOLDS, 0.80))


def promotion_tally(rescored_: DataFrame) -> DataFrame:
    """Promoted and seen by authority, by state, and in all, in one pass."""
    return (
        rescored_.groupingSets([["source_authority"], ["state_abbr"], []], "source_authority", "state_abbr")
        .agg(F.count("*").alias("seen"), F.count_if("promoted").alias("promoted"))
    )
