"""Files for people and machines: CSV, Markdown reports, sitemap, JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Header -> column of the enriched CSV, in order.
CSV = {
    "Judge Name": "full_name", "Court Type": "court_type", "County": "county", "State": "state", "Division": "division", "Is Chief Judge": "is_chief", "Photo URL": "photo_url",
    "Term Start": "term_start", "Term End": "term_end", "Selection Method": "selection_method", "Appointing Authority": "appointing_authority", "Appointment Date": "appointment_date",
    "Birth Date": "birth_date", "Education": "education", "Prior Experience": "prior_experience", "Political Affiliation": "political_affiliation",
    "Bar Admission Date": "bar_admission_date", "Bar Admission State": "bar_admission_state", "Courthouse Address": "courthouse_address", "Courthouse Phone": "courthouse_phone",
    "Roster URL": "roster_url", "Bio Page URL": "bio_page_url", "Confidence Score": "confidence", "Source Authority": "source_authority", "Extraction Method": "extraction_method",
}


def two_decimals(c: Column) -> Column:
    """A double rounded as what it is, as printf does: 0.235 lies below the middle, so 0.23; format_string rounds its shortest decimal form instead. Null for null."""
    return F.when(F.abs(c) < F.lit(float("inf")), F.call_function("format_number", c, F.lit("0.00"))).when(c.isNotNull(), F.format_string("%.2f", c))


def csv_rows(records: DataFrame) -> DataFrame:
    """K2: text columns under their headers: nulls empty, Yes or No for the chief judge, the score with two decimals; absent columns are empty."""
    kinds = dict(records.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("No" if c == "is_chief" else "")
        if kinds[c] == "boolean":
            return F.when(F.col(c), "Yes").otherwise("No")
        return F.coalesce(two_decimals(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string"), F.lit(""))

    return records.select(*(text(c).alias(h) for h, c in CSV.items()))


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K2: CSV files with a header, one per partition."""
    csv_rows(records).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def combined(stats: DataFrame) -> DataFrame:
    """stats(state, judges, failed, verdict) of the states with a row over all; the worst verdict wins."""
    order = F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("CRITICAL"))
    worst = F.element_at(order, F.max(F.array_position(order, F.col("verdict"))).cast("int"))
    return stats.rollup("state").agg(F.sum("judges").alias("judges"), F.sum("failed").alias("failed"), worst.alias("verdict"))


def markdown_lines(table: DataFrame, title: str, order: list[str]) -> DataFrame:
    """K4: lines (n, line) of a small table as Markdown under a heading; one row per line, to be written or shown."""
    bars = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns)), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(-3, f"# {title}"), (-2, "| " + " | ".join(table.columns) + " |"), (-1, "|" + " --- |" * len(table.columns))], "n int, line string")
    return head.unionByName(table.select(F.row_number().over(Window.orderBy(*order)).alias("n"), bars.alias("line")))


def sitemap(states: DataFrame, counties: DataFrame, courts: DataFrame, judges: DataFrame, base: str, as_of: str, per_file: int = 50_000) -> DataFrame:
    """File, loc, last_modified, priority and change_frequency: the index, every state, county and court, and verified judges; files are numbered through all of them.

    Tables have their parent's id, a slug and, if known, updated_at; the index is as of `as_of`. Courts and counties without
    a judge are listed too. Ranks come from windows over 256 hash buckets, so no task sees all urls.
    """
    spark = states.sparkSession
    changed = lambda t: (F.col("updated_at") if "updated_at" in t.columns else F.lit(None)).cast("timestamp").alias("last_modified")
    url = lambda parent: F.concat(parent, F.col("slug"), F.lit("/")).alias("loc")
    index = spark.range(1).select(F.lit(base + "/judges/").alias("loc"), F.lit(as_of).cast("timestamp").alias("last_modified"))
    one = states.select("state_id", url(F.lit(base + "/judges/")), changed(states))
    two = counties.join(one.select("state_id", F.col("loc").alias("_p")), "state_id").select("county_id", url(F.col("_p")), changed(counties))
    three = courts.join(two.select("county_id", F.col("loc").alias("_p")), "county_id").select("court_id", url(F.col("_p")), changed(courts))
    four = judges.filter("status = 'VERIFIED'").join(three.select("court_id", F.col("loc").alias("_p")), "court_id").select(url(F.col("_p")), changed(judges))
    urls = None
    for n, (rows, often) in enumerate([(index, "weekly"), (one, "weekly"), (two, "weekly"), (three, "weekly"), (four, "monthly")]):
        part = rows.select("loc", "last_modified", F.lit(round(1.0 - n / 10, 1)).alias("priority"), F.lit(often).alias("change_frequency"))
        urls = part if urls is None else urls.unionByName(part)
    dealt = urls.withColumn("_b", F.pmod(F.xxhash64("loc"), F.lit(256)))
    starts = dealt.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    ranked = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("loc"))).join(F.broadcast(starts.select("_b", "_s")), "_b")
    return ranked.select(F.ceil((F.col("_s") + F.col("_i")) / per_file).cast("int").alias("file"), "loc", "last_modified", "priority", "change_frequency")


def script_safe(json: Column) -> Column:
    """< escaped, so that JSON can stand in a script."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def person_json_ld(chain: DataFrame, base: str) -> DataFrame:
    """judge_id and a Person document of rows with full_name, court_type, county, state, path and, where there is one, a description."""
    works = F.struct(F.lit("Organization").alias("@type"), F.concat_ws(", ", "court_type", "county", "state").alias("name"))
    fields = [
        F.lit("https://schema.org").alias("@context"), F.lit("Person").alias("@type"), F.col("full_name").alias("name"), F.concat(F.lit("Judge, "), F.col("court_type")).alias("jobTitle"),
        works.alias("worksFor"), F.concat(F.lit(base), F.col("path")).alias("url"),
    ]
    if "description" in chain.columns:
        fields.append(F.nullif(F.col("description"), F.lit("")).alias("description"))
    return chain.select("judge_id", script_safe(F.to_json(F.struct(*fields))).alias("json_ld"))


def item_list_json_ld(positions: DataFrame, key: str, name: str, path: str, base: str, list_name: Column, list_path: Column) -> DataFrame:
    """One ItemList per key from rows with position, name and path; lists are those of one page. list_name and list_path are of the key."""
    item = F.struct(F.lit("ListItem").alias("@type"), "position", F.col(name).alias("name"), F.concat(F.lit(base), F.col(path)).alias("url"))
    lists = positions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("_items"))
    items = F.transform("_items", lambda x: x.item)
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), list_name.alias("name"), F.concat(F.lit(base), list_path).alias("url"),
        F.size("_items").alias("numberOfItems"), items.alias("itemListElement"),
    )
    return lists.select(key, script_safe(F.to_json(doc)).alias("json_ld"))


def quality_report(states: DataFrame, zero_counties: DataFrame) -> DataFrame:
    """K4: lines (n, line) of the report: a table of the states' figures, then the counties without judges, each with its circuit."""
    head = markdown_lines(states, "Quality report", [states.columns[0]])
    offset = F.lit(1 << 40)
    title = states.sparkSession.createDataFrame([((1 << 40) - 2, ""), ((1 << 40) - 1, "## Counties with Zero Judges"), (1 << 40, "")], "n long, line string")
    counties = zero_counties.select((offset + F.row_number().over(Window.orderBy("county"))).alias("n"), "line")  # configured counties, a few thousand
    some = title.join(F.broadcast(zero_counties.limit(1).select(F.lit(1).alias("_any"))), F.lit(True)).drop("_any")
    return head.withColumn("n", F.col("n").cast("long")).unionByName(some).unionByName(counties)
