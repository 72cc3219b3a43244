"""URLs, dates, numbers, arrays and JSON (U1-U5, D1-D7, M-1 to M-7, C1-C10)."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def host(url: Column) -> Column:
    """The host in lower case; what looks like one for a malformed URL; else the text itself."""
    rough = F.nullif(F.regexp_extract(url, r"^(?:https?://)?([^/?#]+)", 1), F.lit(""))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), rough, url)


def domain(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


@F.pandas_udf(StringType())
def resolved(url: pd.Series, base: pd.Series) -> pd.Series:
    """A URL relative to a page."""
    return pd.Series([None if u is None else urljoin(b or "", u) for u, b in zip(url, base, strict=True)])


def source_authority(url: Column, configured: Column) -> Column:
    """U4: configured tells whether the host is one of a configured court site."""
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(h.isNull(), "SECONDARY").when(h.endswith(".gov"), "OFFICIAL_GOV").when(configured, "COURT_WEBSITE").otherwise("SECONDARY")


def canonical_path(path: Column) -> Column:
    """U5."""
    return F.lower(path)


def loose_year(text: Column) -> Column:
    """The year of an ISO date, else the first of the 1900s or 2000s."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d{4})-\d{2}-\d{2}", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")))


def loose_date(text: Column) -> Column:
    """A timestamp from YYYY or ISO, null for anything else."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).otherwise(text))


def days_since(then: Column, now: Column) -> Column:
    """D3: whole days of 24 hours."""
    return F.floor((now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 86400.0)


def months_before(now: Column, months: int) -> Column:
    """D4."""
    return F.add_months(now, -months)


def bar_date(year: Column) -> Column:
    """D5."""
    return F.when(year.isNotNull() & (year != ""), F.concat(year, F.lit("-01-01")))


def duration(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(s >= 3600, F.format_string("%dh %dm", h, m)).when(s >= 60, F.format_string("%dm %ds", m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%ds", s))


def file_stamp(ts: Column) -> Column:
    """D7."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def iso(ts: Column) -> Column:
    """P5."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def long_date(ts: Column) -> Column:
    """As January 2, 2024."""
    return F.date_format(ts, "MMMM d, yyyy")


def year_of(ts: Column) -> Column:
    """P6."""
    return F.date_format(ts, "yyyy")


def month_year(ts: Column) -> Column:
    """As Jan 2024."""
    return F.date_format(ts, "MMM yyyy")


def clamp01(x: Column) -> Column:
    """M-1: null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """M-2: on the binary double, as floor(x * 10**digits + 0.5) / 10**digits."""
    return F.floor(x * float(10**digits) + 0.5).cast("double") / float(10**digits)


def safe_divide(n: Column, d: Column) -> Column:
    """M-4: 0 for a denominator that isn't positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(0.0)


def freshness(days: Column, window: float = 90.0) -> Column:
    """M-5."""
    return clamp01(1 - days / window)


def filled(*values: Column) -> Column:
    """M-7: the first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def json_of_answer(text: Column) -> Column:
    """C4: the JSON in a fence, else from the first brace to the last, else the text."""
    fenced, bare = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(F.regexp_replace(fenced, r"^\s+|\s+$", ""), F.lit("")), F.nullif(bare, F.lit("")), text)


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """JSON that was cut off, without its dangling last element and with its brackets closed; null if hopeless."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        for cut in (len(text), text.rfind("}") + 1, text.rfind("]") + 1):
            part = re.sub(r",\s*$", "", text[:cut])
            stack, quoted, escaped = [], False, False
            for c in part:
                if quoted:
                    quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
                elif c == '"':
                    quoted = True
                elif c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif c in "}]" and stack:
                    stack.pop()
            whole = part + '"' * quoted + "".join(reversed(stack))
            try:
                json.loads(whole)
            except ValueError:
                continue
            return whole
        return None

    return texts.map(one)


def hints(**fields: Column) -> Column:
    """JSON of the fields that are there, null for none."""
    text = F.to_json(F.struct(*(F.nullif(c, F.lit("")).alias(k) for k, c in fields.items())))
    return F.nullif(text, F.lit("{}"))
