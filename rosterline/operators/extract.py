"""Rosters and portraits from pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.text import county_of_header, is_county_name, looks_like_name, roster_name
from rosterline.functions.values import json_of_answer, repaired_json, resolved
from rosterline.sources.markup import cells, next_people
from rosterline.sources.page_tree import element, first_in_places, nodes
from rosterline.sources.providers import Model, completed

#: Most people a page can plausibly list, by court type; a page needs this many for a roster to count.
CAP, CIRCUIT_CAP, LEAST = 20, 70, 3
ROSTER = ["page_id", "pos", "name", "county", "href", "is_chief", "confidence", "method"]
# The honorific before a name, and names of files that are no portraits.
HON = r"(?i)^(?:Hon\.\s*|Honorable\s+)(.+)$"
NOISE = r"(?i)icon|logo|sprite|banner|pixel|spacer|button|arrow|social|facebook|twitter|\.svg"
ANSWER = "judges array<struct<name string, courtType string, county string, bioPageUrl string, isChiefJudge boolean>>, pageTitle string"


def _chief(words: str) -> Column:
    return F.col("text").rlike(f"(?i)\\b(?:{words})\\b")


def selector_roster(found: DataFrame) -> DataFrame:
    """Names in table cells, with the county of the last heading cell before them; without any, honourables in other cells.

    A window runs over one page's cells.
    """
    head = (F.col("kind") == "th") & (F.col("text") != "") & ~F.lower("text").contains("judge") & (F.length("text") < 100)
    other = F.col("kind").rlike("^h[1-6]$") & F.col("text").rlike("(?i)county") & (F.length("text") < 100) & ~F.lower("text").contains("judge")
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = F.regexp_extract("text", HON, 1)
    rows = found.withColumns({"county": F.last(F.when(head, county_of_header(F.col("text"))), ignorenulls=True).over(so_far), "_near": F.last(F.when(head | other, county_of_header(F.col("text"))), ignorenulls=True).over(so_far)})
    tables = rows.filter((F.col("kind") == "td") & ((named != "") | looks_like_name(F.col("text")))).withColumn("_tier", F.lit(0))
    loose = rows.filter(F.col("kind").isin("li", "h2", "h3", "h4") & (named != "")).withColumns({"county": F.col("_near"), "_tier": F.lit(1)})
    people = tables.unionByName(loose)
    people = people.join(people.groupBy("page_id").agg(F.min("_tier").alias("_tier")), ["page_id", "_tier"])
    name = roster_name(F.when(named != "", named).otherwise(F.col("text")))
    return people.select("page_id", "pos", name.alias("name"), "county", "href", _chief("chief|presiding").alias("is_chief"), F.lit(0.9).alias("confidence"), F.lit("selector-hint").alias("method"))


def _boxes(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Cells of the tables or lists that speak of judges."""
    rows = found.filter(F.col("kind").isin(kinds))
    telling = rows.filter(F.lower("text").rlike(r"judge|justice|hon\.")).select("page_id", "box").distinct()
    return rows.join(telling, ["page_id", "box"], "left_semi")


def table_roster(found: DataFrame) -> DataFrame:
    """First cells that look like names in tables about judges, the county from another cell of the row."""
    rows = _boxes(found, ["td", "th"])
    county = rows.filter((F.col("col") > 0) & is_county_name(F.col("text"))).groupBy("page_id", "line").agg(F.max_by("text", "col").alias("county"))
    names = rows.filter((F.col("col") == 0) & looks_like_name(F.col("text"))).join(county, ["page_id", "line"], "left")
    return names.select("page_id", "pos", roster_name(F.col("text")).alias("name"), "county", "href", F.col("text").rlike("(?i)chief").alias("is_chief"), F.lit(0.8).alias("confidence"), F.lit("table").alias("method"))


def list_roster(found: DataFrame) -> DataFrame:
    """E5: list items that look like names in lists about judges."""
    rows = _boxes(found, ["li"]).filter(looks_like_name(F.col("text")))
    return rows.select("page_id", "pos", roster_name(F.col("text")).alias("name"), F.lit(None).cast("string").alias("county"), "href", F.col("text").rlike("(?i)chief").alias("is_chief"), F.lit(0.8).alias("confidence"), F.lit("list").alias("method"))


def next_roster(pages: DataFrame) -> DataFrame:
    """E3."""
    rows = next_people(pages)
    return rows.select("page_id", "pos", roster_name(F.col("name")).alias("name"), F.lit(None).cast("string").alias("county"), "href", F.col("name").rlike("(?i)chief").alias("is_chief"), F.lit(0.8).alias("confidence"), F.lit("next-data").alias("method"))


# Parts of urls of which the page layouts are known.
KNOWN_HOSTS = ["flcourts.gov", "flcourts.org"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def deterministic_roster(pages: DataFrame, hosts: list[str] = KNOWN_HOSTS) -> DataFrame:
    """Of pages(page_id, url, html, court_type) of the known hosts the first strategy that finds people, three or more in tables and lists, within the cap."""
    pages = pages.filter(any_of([F.coalesce(F.contains("url", F.lit(h)), F.lit(False)) for h in hosts]))
    found = cells(pages)
    tries = next_roster(pages).withColumn("_n", F.lit(0)).unionByName(table_roster(found).withColumn("_n", F.lit(1))).unionByName(list_roster(found).withColumn("_n", F.lit(2)))
    most = F.when(F.col("court_type").contains("Circuit"), CIRCUIT_CAP).otherwise(CAP)
    counted = tries.groupBy("page_id", "_n").agg(F.count("*").alias("_c")).join(pages.select("page_id", "court_type"), "page_id")
    fit = counted.filter((F.col("_c") <= most) & ((F.col("_n") == 0) | (F.col("_c") >= LEAST))).groupBy("page_id").agg(F.min("_n").alias("_n"))
    return tries.join(fit, ["page_id", "_n"]).select(ROSTER)


def model_roster(pages: DataFrame, model: Model) -> DataFrame:
    """People from a model's answer about pages(page_id, markdown); cut-off JSON is repaired, answers with a nameless person are dropped whole."""
    asked = completed(pages.select("page_id", F.col("markdown").alias("prompt")), "prompt", model)
    read = asked.select("page_id", F.from_json(repaired_json(json_of_answer(F.col("answer"))), ANSWER).alias("a"))
    valid = read.filter(F.coalesce(F.forall("a.judges", lambda j: F.coalesce(j["name"] != "", F.lit(False))), F.lit(False)))
    rows = valid.select("page_id", F.posexplode("a.judges").alias("pos", "j"))
    return rows.select("page_id", "pos", roster_name(F.col("j.name")).alias("name"), "j.county", F.col("j.bioPageUrl").alias("href"), F.coalesce("j.isChiefJudge", F.lit(False)).alias("is_chief"), F.lit(0.7).alias("confidence"), F.lit("llm").alias("method"))


def rosters(pages: DataFrame, model: Model) -> DataFrame:
    """pages(page_id, html, markdown, court_type, deterministic): configured ones by their tables, then by the general strategies, the rest by the model."""
    first = selector_roster(cells(pages.filter("deterministic"))).select(ROSTER)
    rest = pages.join(first.select("page_id").distinct(), "page_id", "left_anti")
    second = deterministic_roster(rest)
    third = model_roster(rest.join(second.select("page_id").distinct(), "page_id", "left_anti"), model)
    return first.unionByName(second).unionByName(third.select(ROSTER))


def portraits(pages: DataFrame) -> DataFrame:
    """page_id and photo of pages(page_id, url, html): by alternative text, classes and size; of equals the first."""
    alt, cls, parent = F.lower("alt"), F.lower("class"), F.lower("parent_class")
    score = (
        F.when(alt.rlike(r"portrait|headshot|official\s*photo"), 5).otherwise(0) + F.when(alt.rlike(r"\b(judge|justice)\b"), 3).otherwise(0) + F.when(alt.rlike(r"\b(photo|picture|image)\b"), 2).otherwise(0)
        + F.when(cls.rlike("portrait|headshot|profile-photo|judge-photo"), 4).otherwise(0) + F.when(parent.rlike("portrait|headshot|profile-photo|judge-photo"), 3).otherwise(0)
        + F.when((F.col("width") >= 100) & (F.col("height") >= 120), 1).otherwise(0) + F.when((F.col("width") >= 150) & (F.col("height") >= 180), 1).otherwise(0)
    )
    tiny = ((F.col("width") > 0) & (F.col("width") < 50)) | ((F.col("height") > 0) & (F.col("height") < 50))
    images = cells(pages).filter((F.col("kind") == "img") & F.col("src").isNotNull() & ~F.col("src").rlike(NOISE) & ~tiny).withColumn("score", score).filter("score > 0")
    best = images.groupBy("page_id").agg(F.max_by("src", F.struct("score", -F.col("pos"))).alias("src"))
    return best.join(pages.select("page_id", "url"), "page_id").select("page_id", resolved(F.col("src"), F.col("url")).alias("photo"))


# Where encyclopaedias and court pages keep the portrait, in the order in which they are asked: (place, image).
_IMG = {"tag": "img"}
INFOBOXES = {
    "wikipedia.org": [({"tag": "table", "cls": "infobox"}, _IMG), ({"tag": "table", "cls": "vcard"}, _IMG), ({"cls": "infobox"}, _IMG)],
    "ballotpedia.org": [({"cls": "infobox"}, _IMG), ({"cls": "officeholder-info"}, _IMG), ({"cls": "widget-row"}, _IMG)],
}
PORTRAIT_PLACES = [
    *(({"cls": c}, _IMG) for c in ("judge-photo", "bio-photo", "judge-image", "profile-photo", "judge-profile", "judicial-officer")),
    ({"tag": "article"}, {"tag": "img", "attribute": ("alt", "judge")}), ({"cls": "content-area"}, {"tag": "img", "first_of_type": True}), ({"tag": "main"}, {"tag": "img", "first_of_type": True}),
]


def _first_fitting(pages: DataFrame, tree: DataFrame | None, places: list[tuple[dict, dict]], fits: Column) -> DataFrame:
    """page_id and photo: the first image of the earliest place whose first image has a source and `fits` (over src, alt, width and site)."""
    found = first_in_places(nodes(pages) if tree is None else tree, [element(**i) for _, i in places], [element(**p) for p, _ in places])
    at = lambda k: F.element_at("attributes", k)
    width = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(at("width"), r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")), F.lit(0))
    images = found.select("page_id", "place", at("src").alias("src"), F.lower(F.coalesce(at("alt"), F.lit(""))).alias("alt"), width.alias("width"))
    best = images.filter((F.col("src") != "") & fits).groupBy("page_id").agg(F.min_by("src", "place").alias("_src"))
    return best.join(pages.select("page_id", "url"), "page_id").select("page_id", resolved(F.col("_src"), F.col("url")).alias("photo"))


def encyclopaedia_portraits(pages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """page_id and photo of encyclopaedia pages(page_id, url, html): the first image of the infobox, no icon; pages under 100 characters have none.

    tree: the pages' nodes(), if they have been written already. page_id must be unique.
    """
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    long = pages.filter(F.length("html") >= 100)
    small = (F.col("width") > 0) & (F.col("width") < 50)
    fit = {"wikipedia.org": ~small, "ballotpedia.org": ~F.col("src").rlike(NOISE)}
    wiki, other = INFOBOXES
    both = (long.filter(host.contains(wiki)), wiki), (long.filter(host.contains(other) & ~host.contains(wiki)), other)
    first, second = (_first_fitting(p, None if tree is None else tree.join(p.select("page_id"), "page_id", "left_semi"), INFOBOXES[s], fit[s]) for p, s in both)
    return first.unionByName(second)


def court_page_portraits(pages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """page_id and photo by ordered places; an image of an article must speak of a judge; logos, icons, seals and drawings are passed over, and their place with them."""
    odd = F.lower("src").rlike(r"logo|icon|seal|1x1|\.svg$") | F.col("alt").rlike("logo|icon|seal")
    return _first_fitting(pages, tree, PORTRAIT_PLACES, ~odd)


def portraits_in_order(pages: DataFrame, classes: list[str]) -> DataFrame:
    """The first image whose or whose parent's class holds the earliest of the given names."""
    at = F.coalesce(*(F.when(F.concat_ws(" ", "class", "parent_class").contains(c), F.lit(k)) for k, c in enumerate(classes)))
    images = cells(pages).filter((F.col("kind") == "img") & F.col("src").isNotNull() & ~F.col("src").rlike(NOISE)).withColumn("at", at).filter("at is not null")
    return images.groupBy("page_id").agg(F.min_by("src", F.struct("at", "pos")).alias("src")).join(pages.select("page_id", "url"), "page_id").select("page_id", resolved(F.col("src"), F.col("url")).alias("photo"))


def classified(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """hits(query, position, link) with confidence and roster from answers(query, answer): an array, or one under results or classifications.

    An answer belongs to its url, or to the hit at its place when it names none.
    """
    kind = "array<struct<url string, confidence double, isRoster boolean>>"
    body = F.coalesce(F.get_json_object("answer", "$.results"), F.get_json_object("answer", "$.classifications"), F.col("answer"))
    each = answers.select("query", F.posexplode(F.from_json(body, kind)).alias("_at", "_c")).select("query", F.col("_at").alias("_p"), "_c.*")
    by_place = each.join(hits.select("query", F.col("position").alias("_p"), "link"), ["query", "_p"], "left").select("query", F.coalesce("url", "link").alias("link"), "confidence", F.col("isRoster").alias("roster"))
    one = by_place.groupBy("query", "link").agg(F.max("confidence").alias("confidence"), F.bool_or("roster").alias("roster"))
    return hits.join(one, ["query", "link"], "left")
