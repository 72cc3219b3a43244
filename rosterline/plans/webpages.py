"""Queries over raw pages: cells, rosters, Markdown, configuration of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.text import page_title
from rosterline.operators import extract, reports, search, slugs
from rosterline.sources import page_tree, providers
from rosterline.sources.markup import cells, markdown
from rosterline.sources.standins import AS_OF, CHAIN_SQL, chain, read, sql


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def e2_cells(spark: SparkSession, d: str) -> DataFrame:
    """E5: headings and list items of every page."""
    found = cells(_pages(spark, d)).filter("kind in ('h1', 'li')")
    return found.groupBy("page_id").agg(F.count_if(F.col("kind") == "h1").alias("headings"), F.count_if(F.col("kind") == "li").alias("items"))


#: Roster pages for records: their list, as HTML that Spark and DuckDB make alike.
_PEOPLE = "CASE n_nationkey % 3 WHEN 0 THEN 'Ann Lee,Bo Smith,Carla Ortiz' WHEN 1 THEN 'Dov Nguyen,Eva Adams' ELSE 'Finn Brown,Ann Adams,Bo Lee,Eva Ortiz' END"
_SITE = "CASE WHEN n_nationkey % 5 = 4 THEN 'https://www.example.org/' ELSE 'https://circuit.flcourts.gov/' END"
_LIST = f"concat('<html><body><h2>Judges</h2><ul><li>Judge ', replace({_PEOPLE}, ',', '</li><li>Judge '), '</li></ul></body></html>')"


def e1_rosters(spark: SparkSession, d: str) -> DataFrame:
    """People on list pages of nations' courts: known hosts only, three people or more."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    pages = nations.selectExpr("n_nationkey AS page_id", f"concat({_SITE}, n_nationkey) AS url", f"{_LIST} AS html", "'County Court' AS court_type")
    return extract.deterministic_roster(pages).select("page_id", "name", "method")


def e4_tables(spark: SparkSession, d: str) -> DataFrame:
    """People in tables, with the county of another cell of their row."""
    row = "concat('<tr><td>', replace({0}, ',', '</td><td>Leon</td></tr><tr><td>'), '</td><td>Leon</td></tr>')".format(_PEOPLE)
    nations = spark.read.parquet(f"{d}/nation.parquet")
    pages = nations.selectExpr("n_nationkey AS page_id", "concat('https://x.flcourts.org/', n_nationkey) AS url", f"concat('<table><tr><th>Judge</th><th>County</th></tr>', {row}, '</table>') AS html", "'County Court' AS court_type")
    return extract.deterministic_roster(pages).select("page_id", "name", "county", "method")


def s21_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The pages as Markdown."""
    return _pages(spark, d).select("page_id", markdown("html").alias("markdown"))


def s8_fetched(spark: SparkSession, d: str) -> DataFrame:
    """Pages of all candidates and of all scraped urls from the table of pages, which lacks the latter."""
    urls = read(spark, d, "candidates").select("url").unionByName(read(spark, d, "logs").select("url")).distinct()
    return providers.fetched_offline(urls, _pages(spark, d)).select("url", F.length("body").alias("n"), "error")


def s15_pages(spark: SparkSession, d: str) -> DataFrame:
    """Encyclopaedia pages of suppliers' names, of which those with the state and those with judge exist."""
    people = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("replace(s_name, '#', 'No. ') AS name", "CASE WHEN s_nationkey % 2 = 0 THEN 'North Carolina' ELSE 'Ohio' END AS state", "s_suppkey").distinct()
    spelled = "'https://ballotpedia.org/' || replace(replace(name, ' ', '_'), '.', '')"
    pages = people.filter("s_suppkey % 3 = 0").selectExpr(f"{spelled} || '_(' || state || ')' AS url", "'<p>a judge</p>' AS html")
    more = people.filter("s_suppkey % 3 < 2").selectExpr(f"{spelled} || '_(judge)' AS url", "'<p>the court</p>' AS html")
    return providers.encyclopaedia_page(people.select("name", "state"), pages.unionByName(more)).select("name", "state", "page_url")


#: Pages of nations: a challenge, a thin page with embedded data, an empty one, a usual one.
_BODY = """CASE n_nationkey % 4 WHEN 0 THEN '<p>Please Verify You Are Human</p>' WHEN 1 THEN '<p>x</p><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"pageData":{"name":"The Circuit of a Nation"},"childrenInfos":[]}}}</script>'
  WHEN 2 THEN '' ELSE concat('<h1>', n_name, '</h1>') END"""


def s8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Challenges become errors, thin pages take their embedded data."""
    pages = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS page_id", "concat('https://x.org/', n_nationkey) AS url", f"{_BODY} AS body", "CAST(NULL AS string) AS error")
    out = providers.checked(pages)
    return out.select("page_id", F.col("error").isNotNull().alias("failed"), (F.length("markdown") > 20).alias("filled"))


#: An infobox with a picture of some width or none, and another image behind it; portraits in several places or in none.
_INFOBOX = "replace(html, '<article>', concat('<article><table class=\"infobox vcard\"><tr><td>', CASE WHEN page_id % 4 > 0 THEN concat('<img width=', page_id % 4 * 40, ' src=\"/p', page_id, '.jpg\">') ELSE '' END, '</td></tr></table><div><img src=\"/map.png\"></div>'))"
_ORDERED = """replace(replace(html, '<article>', concat('<article>', CASE page_id % 5 WHEN 0 THEN '<div class="judge-photo"></div>'
  WHEN 1 THEN concat('<div class="judge-photo"><img src="/logo.png"></div><img alt="The Judge" src="/a', page_id, '.jpg">')
  WHEN 2 THEN concat('<div class="x bio-photo"><p><img src="/b', page_id, '.jpg"></p></div><img alt="a judge" src="/no.jpg">')
  WHEN 3 THEN concat('<img alt="me" src="/no.jpg"><img alt="Judge Lee" src="/c', page_id, '.jpg">') ELSE '' END)), '<footer>', '<footer><img src="/ad.jpg">')"""


def e8_encyclopaedia_portraits(spark: SparkSession, d: str) -> DataFrame:
    """Portraits of encyclopaedia pages by their page trees; some infoboxes have none or one that is too small."""
    pages = _pages(spark, d).selectExpr("page_id", "concat('https://en.wikipedia.org/wiki/', page_id) AS url", f"{_INFOBOX} AS html")
    return extract.encyclopaedia_portraits(pages)


def e9_portraits(spark: SparkSession, d: str) -> DataFrame:
    """Portraits of court pages by ordered places of their page trees; some places are empty or hold a logo."""
    pages = _pages(spark, d).selectExpr("page_id", "'https://c.gov/bio/x' AS url", f"{_ORDERED} AS html")
    return extract.court_page_portraits(pages)


def e2_nav_links(spark: SparkSession, d: str) -> DataFrame:
    """Every page's navigation as a selector over page trees: nav li a, with its address and text."""
    found = page_tree.selected(page_tree.nodes(_pages(spark, d)), page_tree.element("nav"), page_tree.element("li"), page_tree.element("a"))
    return found.select("page_id", F.col("nth"), F.element_at("attributes", "href").alias("href"), "text")


def e2_article_shape(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every page by where they lie: paragraphs and headings in the article, all in the body."""
    tree = page_tree.nodes(_pages(spark, d))
    inside = page_tree.within(tree, tree.filter(page_tree.element("article") | page_tree.element("body")).select("page_id", "node", "stop", F.col("tag").alias("outer")), "outer")
    n = lambda c: F.count_if(c).cast("int")
    article = F.col("outer") == "article"
    return inside.groupBy("page_id").agg(
        n(article & (F.col("tag") == "p")).alias("paragraphs"), n(article & (F.col("tag") == "h1")).alias("headings"), n(~article & (F.col("tag") == "a")).alias("links")
    )


def f14_captcha(spark: SparkSession, d: str) -> DataFrame:
    """pages that are challenges."""
    return _pages(spark, d).select("page_id", search.has_captcha(F.col("html")).alias("blocked"))


def t21_queries(spark: SparkSession, d: str) -> DataFrame:
    """Web queries by state."""
    more = spark.createDataFrame([(100, "Virginia"), (101, "South Dakota"), (102, "Ohio")], "state_id int, name string")
    return providers.queries_of(read(spark, d, "states").select("state_id", "name").unionByName(more)).select("state_id", "level", "query")


def _slugged(spark: SparkSession, d: str) -> DataFrame:
    """The chain with unique slugs of its judges and the path of each one's profile."""
    c = slugs.unique_slugs(chain(spark, d), "court_id", "full_name", "judge_id")
    return c.withColumn("path", F.concat_ws("/", F.lit("/judges"), "state_slug", "county_slug", "court_slug", "slug", F.lit("")))


def k18_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Urls of all levels and of verified judges, with their last change, priority and how often they change; courts without judges too."""
    levels = [read(spark, d, n) for n in ("states", "counties", "courts")]
    judges = slugs.unique_slugs(read(spark, d, "judges"), "court_id", "full_name", "judge_id").withColumn("updated_at", F.col("created_at"))
    return reports.sitemap(*levels, judges, "https://x.org", AS_OF).select("loc", F.col("last_modified").cast("string").alias("last_modified"), "priority", "change_frequency")


def k19_person(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD of every judge."""
    return reports.person_json_ld(_slugged(spark, d), "https://x.org")


def k19_item_lists(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD of each state's list of counties."""
    k = read(spark, d, "counties")
    rows = k.withColumns({"position": F.row_number().over(Window.partitionBy("state_id").orderBy("name")), "path": F.concat(F.lit("/judges/"), "slug", F.lit("/"))})
    key = F.col("state_id").cast("string")
    return reports.item_list_json_ld(rows, "state_id", "name", "path", "https://x.org", F.concat(F.lit("State "), key), F.concat(F.lit("/s/"), key))


def t24_titles(spark: SparkSession, d: str) -> DataFrame:
    """The five titles of pages."""
    c = chain(spark, d)
    made = lambda kind: page_title(kind, F.col("state"), F.col("county"), F.col("court_type"), F.col("full_name"), "x.org").alias(f"{kind}_title")
    return c.select("judge_id", *(made(k) for k in ("states", "counties", "courts", "judges", "judge")))


def k2_csv(spark: SparkSession, d: str) -> DataFrame:
    """K2: the rows of the enriched CSV, all 25 columns."""
    own = chain(spark, d).withColumns({"roster_url": F.col("source_url"), "is_chief": F.col("flagged")})
    return reports.csv_rows(own.select("full_name", "court_type", "county", "state", "photo_url", "education", "prior_experience", "roster_url", "is_chief", "confidence", "source_authority", "extraction_method"))


QUERIES = {f.__name__: f for f in (e2_cells, e2_nav_links, e2_article_shape, e1_rosters, e4_tables, s21_markdown, s8_fetched, s8_checked, s15_pages, e8_encyclopaedia_portraits, e9_portraits, f14_captcha, t21_queries, k18_sitemap, k19_person, k19_item_lists, t24_titles, k2_csv)}

_C = "', '".join(search.CAPTCHA)
_T = """SELECT state_id, l.level, '"' || name || '" ' || l.text || site || CASE name WHEN 'Virginia' THEN ' -"West Virginia"' WHEN 'South Dakota' THEN ' -"North Dakota"' ELSE '' END AS query
  FROM s, (VALUES ('supreme', 'supreme court justices roster site:'), ('appellate', 'court of appeal judges roster site:'), ('trial', 'circuit OR superior OR district court judges roster site:')) t(kind, text),
  (VALUES ('gov', ''), ('org', '_org')) o(site, ending), LATERAL (SELECT kind || ending AS level, text) l"""
_SLUGGED = f"""WITH {CHAIN_SQL}, b AS (SELECT *, regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base FROM chain),
  n AS (SELECT *, row_number() OVER (PARTITION BY court_id, base ORDER BY judge_id) AS k FROM b),
  g AS (SELECT *, 'https://x.org/judges/' AS u, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM n) """
_PATH = "u || state_slug || '/' || county_slug || '/' || court_slug || '/' || slug || '/'"
_ROSTER = f"SELECT n_nationkey AS page_id, unnest(string_split({_PEOPLE}, ',')) AS name, {{}} AS method FROM nation WHERE n_nationkey % 3 <> 1"
_TEXT = lambda c: f"coalesce({c}, '')"
_BASE = "trim(regexp_replace(lower(full_name), '[\\s-]+', '-', 'g'), '-')"
SQL = {
    "e2_cells": "SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS headings, len(regexp_extract_all(html, '<li[ >]')) AS items FROM pages WHERE regexp_matches(html, '<(h1|li)[ >]')",
    "e1_rosters": _ROSTER.format("'list'") + " AND n_nationkey % 5 <> 4",
    "e4_tables": _ROSTER.format("'table'").replace("AS name,", "AS name, 'Leon' AS county,"),
    "s8_fetched": f"""WITH {sql('candidates', 'logs')}, u AS (SELECT url FROM candidates UNION SELECT url FROM logs) SELECT url, CAST(length(html) AS INT) AS n, CASE WHEN html IS NULL THEN 'not found' END AS error
      FROM u LEFT JOIN (SELECT url, min(html) AS html FROM pages GROUP BY url) p USING (url)""",
    "s15_pages": """WITH p AS (SELECT DISTINCT replace(s_name, '#', 'No. ') AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'North Carolina' ELSE 'Ohio' END AS state, s_suppkey FROM supplier)
      SELECT name, state, 'https://ballotpedia.org/' || replace(replace(name, ' ', '_'), '.', '') || CASE s_suppkey % 3 WHEN 0 THEN '_(' || state || ')' WHEN 1 THEN '_(judge)' END AS page_url FROM p""",
    "s8_checked": "SELECT n_nationkey AS page_id, n_nationkey % 4 = 0 AS failed, CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE n_nationkey % 4 = 1 END AS filled FROM nation",
    "e8_encyclopaedia_portraits": "SELECT page_id, 'https://en.wikipedia.org/p' || page_id || '.jpg' AS photo FROM pages WHERE page_id % 4 > 1 AND contains(html, '<article>')",
    "e9_portraits": "SELECT page_id, 'https://c.gov/' || ['a', 'b', 'c'][page_id % 5] || page_id || '.jpg' AS photo FROM pages WHERE page_id % 5 BETWEEN 1 AND 3 AND contains(html, '<article>')",
    "e2_nav_links": """WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)(?:</nav>|$)', 1) AS nav FROM pages), a AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>')) AS a FROM n)
      SELECT page_id, CAST(1 AS INTEGER) AS nth, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS text FROM a""",
    "e2_article_shape": """WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS art, regexp_extract(html, '(?s)<body>(.*)', 1) AS body FROM pages)
      SELECT page_id, CAST(len(regexp_extract_all(art, '<p>')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(art, '<h1>')) AS INTEGER) AS headings, CAST(len(regexp_extract_all(body, '<a ')) AS INTEGER) AS links FROM n""",
    "f14_captcha": f"SELECT page_id, len(list_filter(['{_C}'], lambda x: contains(lower(html), x))) > 0 AS blocked FROM pages",
    "t21_queries": f"WITH {sql('states')}, s AS (SELECT state_id, name FROM states UNION ALL SELECT * FROM (VALUES (100, 'Virginia'), (101, 'South Dakota'), (102, 'Ohio'))) {_T}",
    "k18_sitemap": f"WITH {sql('states', 'counties', 'courts', 'judges')}, b AS (SELECT *, {_BASE} AS base FROM judges), s AS (SELECT *, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS own FROM (SELECT *, row_number() OVER (PARTITION BY court_id, base ORDER BY judge_id) AS n FROM b))," + """
      one AS (SELECT state_id, 'https://x.org/judges/' || slug || '/' AS loc FROM states), two AS (SELECT county_id, loc || slug || '/' AS loc FROM counties JOIN one USING (state_id)), three AS (SELECT court_id, loc || slug || '/' AS loc FROM courts JOIN two USING (county_id))
      SELECT loc, last_modified, priority::DOUBLE AS priority, change_frequency FROM (SELECT 'https://x.org/judges/' AS loc, '2024-02-01 00:00:00' AS last_modified, 1.0 AS priority, 'weekly' AS change_frequency UNION ALL SELECT loc, NULL, 0.9, 'weekly' FROM one
      UNION ALL SELECT loc, NULL, 0.8, 'weekly' FROM two UNION ALL SELECT loc, NULL, 0.7, 'weekly' FROM three
      UNION ALL SELECT loc || own || '/', strftime(created_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S'), 0.6, 'monthly' FROM s JOIN three USING (court_id) WHERE status = 'VERIFIED')""",
    "k19_person": _SLUGGED + f"""SELECT judge_id, '{{"@context":"https://schema.org","@type":"Person","name":"' || full_name || '","jobTitle":"Judge, ' || court_type || '","worksFor":{{"@type":"Organization","name":"'
      || court_type || ', ' || county || ', ' || state || '"}},"url":"' || {_PATH} || '"}}' AS json_ld FROM g""",
    "k19_item_lists": f"""WITH {sql('counties')}, i AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY name) AS n FROM counties)
      SELECT state_id, '{{"@context":"https://schema.org","@type":"ItemList","name":"State ' || state_id || '","url":"https://x.org/s/' || state_id || '","numberOfItems":' || count(*) || ',"itemListElement":['
      || string_agg('{{"@type":"ListItem","position":' || n || ',"name":"' || name || '","url":"https://x.org/judges/' || slug || '/"}}', ',' ORDER BY n) || ']}}' AS json_ld FROM i GROUP BY state_id""",
    "t24_titles": f"""WITH {CHAIN_SQL} SELECT judge_id, 'U.S. Judges Directory — Browse by State' AS states_title, 'Judges in ' || state || ' — County Directory' AS counties_title, 'Courts in ' || county || ', ' || state || ' — x.org' AS courts_title,
      court_type || ' Judges in ' || county || ', ' || state AS judges_title, 'Judge ' || full_name || ' — ' || court_type || ', ' || county || ', ' || state AS judge_title FROM chain""",
    "k2_csv": f"""WITH {CHAIN_SQL} SELECT full_name AS "Judge Name", court_type AS "Court Type", county AS "County", state AS "State", CASE WHEN flagged THEN 'Yes' ELSE 'No' END AS "Is Chief Judge", {_TEXT('photo_url')} AS "Photo URL",
      {_TEXT('education')} AS "Education", {_TEXT('prior_experience')} AS "Prior Experience", {_TEXT('source_url')} AS "Roster URL", printf('%.2f', confidence) AS "Confidence Score", {_TEXT('source_authority')} AS "Source Authority",
      extraction_method AS "Extraction Method", {", ".join(f"'' AS " + '"' + h + '"' for h in ("Division", "Term Start", "Term End", "Selection Method", "Appointing Authority", "Appointment Date", "Birth Date", "Political Affiliation",
      "Bar Admission Date", "Bar Admission State", "Courthouse Address", "Courthouse Phone", "Bio Page URL"))} FROM chain""",
}
