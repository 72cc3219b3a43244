"""State configurations, manifests, checkpoints and reference rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.text import county_seed, slug
from rosterline.functions.values import hints
from rosterline.schemas import STATE_CONFIG

MANIFEST = "lastCompletedAt string, reportFile string, qualityVerdict string, judgeCount int, pagesTargeted int, pagesFailed int"
CHECKPOINT = "startedAt string, lastUpdated string, completedUrls array<string>, totalJudges int"


def state_configs(spark: SparkSession, path: str) -> DataFrame:
    """Every *-courts.json below path with its state slug; a file that isn't valid JSON fails the read.

    Configurations without a state, an abbreviation or courts are in problems().
    """
    files = spark.read.schema(STATE_CONFIG).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*-courts.json").option("recursiveFileLookup", True).json(path)
    return files.withColumn("state_slug", F.regexp_replace("_metadata.file_name", "-courts[.]json$", ""))


def problems(configs: DataFrame) -> DataFrame:
    """state_slug and problem: missing fields, and each repetition of a url after its first."""
    missing = configs.filter("state is null or abbreviation is null or courts is null or size(courts) = 0").select("state_slug", F.lit("incomplete").alias("problem"))
    urls = configs.select("state_slug", F.posexplode("courts").alias("at", "court")).select("state_slug", "at", "court.url")
    again = urls.withColumn("n", F.row_number().over(Window.partitionBy("state_slug", "url").orderBy("at"))).filter("n > 1")
    return missing.unionByName(again.select("state_slug", F.concat(F.lit("repeated url: "), "url").alias("problem")))


def url_entries(configs: DataFrame) -> DataFrame:
    """One row per configured url, with defaults."""
    c = configs.select("abbreviation", F.posexplode("courts").alias("ordinal", "c"))
    return c.select(
        F.col("abbreviation").alias("state_abbr"), "ordinal", "c.url", "c.court_type", F.coalesce("c.label", "c.court_type").alias("label"), F.coalesce("c.level", F.lit("trial")).alias("level"),
        F.coalesce("c.counties", F.array().cast("array<string>")).alias("counties"), F.coalesce("c.fetch_method", F.lit("http")).alias("fetch_method"), F.col("c.headquarters_county").alias("hq"), F.coalesce("c.deterministic", F.lit(False)).alias("deterministic"),
    )


def approved_urls(candidates: DataFrame, state_abbr: str) -> DataFrame:
    """A state's approved candidates that aren't unworthy, by url; deterministic if their hints hold a pattern."""
    rows = candidates.filter((F.col("state_abbr") == state_abbr) & (F.col("status") == "APPROVED") & F.coalesce("scrape_worthy", F.lit(True)))
    return rows.withColumn("deterministic", F.get_json_object("hints", "$.pattern").isNotNull()).orderBy("url")


def migrated(configs: DataFrame) -> DataFrame:
    """Configured urls as approved candidates of full confidence."""
    e = url_entries(configs)
    about = hints(level=F.col("level"), label=F.col("label"), hq=F.col("hq"))
    return e.select("url", "state_abbr", F.lit("APPROVED").alias("status"), F.lit(1.0).alias("confidence"), about.alias("hints"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests below path; unreadable ones are left out."""
    rows = spark.read.schema(MANIFEST + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter("_corrupt_record is null and lastCompletedAt is not null").drop("_corrupt_record")


def completed_urls(spark: SparkSession, path: str) -> DataFrame:
    """Urls that a checkpoint lists; none for a missing or broken one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "url string")
    rows = spark.read.schema(CHECKPOINT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.explode("completedUrls").alias("url")).distinct()


def census_counties(raw: DataFrame, states: DataFrame) -> DataFrame:
    """Counties from rows(body) of [[header], [name, state, county], ...]; names without suffix, one per slug and state."""
    rows = raw.select(F.posexplode(F.from_json("body", "array<array<string>>")).alias("at", "r")).filter("at > 0")
    name = county_seed(F.trim(F.split_part(F.get("r", F.lit(0)), F.lit(","), F.lit(1))))
    found = rows.select(name.alias("name"), F.get("r", F.lit(1)).alias("fips"), F.concat(F.get("r", F.lit(1)), F.get("r", F.lit(2))).alias("county_fips"))
    out = found.join(states.select("fips", "state_id"), "fips").withColumn("slug", slug(F.col("name")))
    return out.groupBy("state_id", "slug").agg(F.min_by("name", "county_fips").alias("name"), F.min("county_fips").alias("fips"))


def write_json(row: dict, path: str, spark: SparkSession) -> None:
    """K6: one JSON document (a checkpoint or a manifest), written beside its place and renamed onto it, so readers see the old or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp"))
    files = target.getFileSystem(conf)
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(row, ensure_ascii=False, indent=2).encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), conf)
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = options
    context.rename(beside, target, array)
