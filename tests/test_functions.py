"""Scalar rules on the cases that their sources single out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rosterline.functions import text, values
from rosterline.operators import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("rule", "given", "expected"),
    [
        (text.normalize_query, "José  O’Brien—Núñez!", "Jose OBrien-Nunez"),
        (text.county_key, "Juneau City and Borough", "juneau city and"),
        (text.county_key, "Orange County", "orange"),
        (text.judge_name, "Smith, John", "John Smith"),
        (text.judge_name, "Smith Jr., John", "Smith Jr., John"),
        (text.judge_name, "Hon. Judge Ann Lee", "Judge Ann Lee"),
        (text.identity_name, "The Honorable Ann Lee", "honorable ann lee"),
        (text.identity_name, "Smith, Jr.", "jr smith"),
        (text.selection_method, "merit based", "Appointed"),
        (text.selection_method, "nonpartisan election", "Elected"),
        (text.selection_method, "unknown", None),
        (text.slug, "--St. John's County--", "st-john-s-county"),
        (text.strict_slug, "José & Co", "jose-and-co"),
        (text.county_of_header, "County of Los Angeles", "Los Angeles"),
        (text.county_of_header, "Kern County", "Kern"),
        (text.law_school, "J.D., Harvard Law School, 1990", "harvard law"),
        (text.graduation_year, "J.D., Harvard Law School, 1990", "1990"),
        (text.title_of_slug, "palm-beach", "Palm Beach"),
        (values.loose_year, "2011-05-01", "2011"),
        (values.loose_year, "in May 1988", "1988"),
        (values.domain, "https://www.X.gov/a", "x.gov"),
        (values.host, "not a url", "not a url"),
        (values.repaired_json, '{"judges": [{"name": "A"}, {"na', '{"judges": [{"name": "A"}]}'),
        (values.json_of_answer, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
    ],
)
def test_text(spark, rule, given, expected):
    assert one(spark, rule(F.lit(given))) == expected
    assert one(spark, rule(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("kind", "state", "expected"),
    [("Supreme Court of Texas", "TX", "Supreme Court"), ("DCA", None, "District Court of Appeal"), ("12th Circuit Court", None, "Circuit Court"), ("Tax Tribunal", None, "Tax Tribunal")],
)
def test_court_type(spark, kind, state, expected):
    assert one(spark, text.court_type(F.lit(kind), F.lit(state).cast("string"))) == expected


@pytest.mark.parametrize(("name", "expected"), [("Hon. Ann Lee", True), ("Ann B. Lee", True), ("Lee, Ann", True), ("Judge", False), ("Court Calendar", False), ("x", False), (None, False)])
def test_looks_like_name(spark, name, expected):
    assert one(spark, text.looks_like_name(F.lit(name).cast("string"))) is expected


@pytest.mark.parametrize(
    ("url", "configured", "expected"),
    [(None, False, "SECONDARY"), ("not a url", False, "SECONDARY"), ("https://www.x.gov/a", False, "OFFICIAL_GOV"), ("https://c.org/", True, "COURT_WEBSITE"), ("https://c.org/", False, "SECONDARY")],
)
def test_authority(spark, url, configured, expected):
    assert one(spark, values.source_authority(F.lit(url).cast("string"), F.lit(configured))) == expected


@pytest.mark.parametrize(
    ("message", "status", "body", "expected"),
    [("HTTP 403 x", None, "captcha", "HTTP_403"), ("it timed out", None, None, "TIMEOUT"), ("odd", None, "solve the CAPTCHA", "CAPTCHA_DETECTED"), ("zod issue", None, None, "PARSE_ERROR"), ("odd", None, None, "UNKNOWN"), ("x", 429, None, "HTTP_429")],
)
def test_failures(spark, message, status, body, expected):
    assert one(spark, rules.failure_class(F.lit(message), F.lit(status).cast("int"), F.lit(body).cast("string"))) == expected


def test_numbers(spark):
    assert one(spark, values.round_half_up(F.lit(0.125))) == 0.13
    assert one(spark, values.clamp01(F.lit(None).cast("double"))) is None
    assert one(spark, values.safe_divide(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, values.duration(F.lit(3725))) == "1h 2m"
    assert one(spark, text.byte_size(F.lit(2048))) == "2.0 KB"
    assert one(spark, text.edit_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert one(spark, values.resolved(F.lit("/a.jpg"), F.lit("https://x.gov/b/c"))) == "https://x.gov/a.jpg"
    assert one(spark, values.hints(a=F.lit(""), b=F.lit(None).cast("string"))) is None
