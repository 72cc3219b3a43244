"""Text rules for names, counties, courts and queries, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words and orders on which equal results depend.
COUNTY_SUFFIXES = [" county", " parish", " borough", " municipality", " census area", " city and borough", " city"]
SEED_SUFFIXES = [" City and Borough", " Census Area", " Municipality", " Borough", " Parish", " County", " city"]
TITLE_PREFIXES = ["chief justice", "chief judge", "senior judge", "associate justice", "justice", "judge", "hon.", "honorable", "the honorable"]
HONORIFICS = [r"hon\.", "honorable", "judge", "justice", "chief justice", "chief judge", "senior judge", "the"]
CANONICAL_COURT_TYPES = ["Supreme Court", "District Court of Appeal", "Circuit Court", "County Court"]
COURT_TYPES = {
    "supreme court": "Supreme Court", "district court of appeal": "District Court of Appeal", "district court of appeals": "District Court of Appeal",
    "dca": "District Court of Appeal", "circuit court": "Circuit Court", "circuit ct": "Circuit Court", "circuit ct.": "Circuit Court",
    "county court": "County Court", "county ct": "County Court", "county ct.": "County Court",
}
STATE_COURT_TYPES = {
    "TX": {
        "supreme court": "Supreme Court", "supreme court of texas": "Supreme Court", "court of criminal appeals": "Court of Criminal Appeals",
        "cca": "Court of Criminal Appeals", "court of appeals": "Court of Appeals", "courts of appeals": "Court of Appeals", "coa": "Court of Appeals",
        "district court": "District Court", "district ct": "District Court", "district ct.": "District Court",
    },
    "CA": {
        "supreme court": "Supreme Court", "supreme court of california": "Supreme Court", "court of appeal": "Court of Appeal",
        "courts of appeal": "Court of Appeal", "district court of appeal": "Court of Appeal", "appellate court": "Court of Appeal",
        "superior court": "Superior Court", "superior ct": "Superior Court", "superior ct.": "Superior Court",
    },
    "NY": {
        "court of appeals": "Court of Appeals", "appellate division": "Appellate Division", "appellate div": "Appellate Division",
        "appellate div.": "Appellate Division", "supreme court": "Supreme Court", "supreme ct": "Supreme Court", "supreme ct.": "Supreme Court",
        "county court": "County Court", "county ct": "County Court", "county ct.": "County Court", "family court": "Family Court",
        "family ct": "Family Court", "family ct.": "Family Court", "surrogate's court": "Surrogate's Court", "surrogates court": "Surrogate's Court",
        "surrogate court": "Surrogate's Court", "civil court": "Civil Court", "criminal court": "Criminal Court",
    },
}
NON_NAME_WORDS = [
    "county", "circuit", "court", "district", "division", "judicial", "magistrate", "officer", "hearing", "support", "child", "general",
    "overview", "directory", "biographies", "calendars", "forms", "procedures", "manuals", "approved", "quasi", "judges", "justices",
    "about", "contact", "home", "menu", "navigation", "search", "login", "register", "civil", "criminal", "family", "probate", "traffic",
    "juvenile", "employment", "opportunities", "expert", "witness", "jury", "service", "process", "servers", "case", "management",
    "program", "proposed", "orders", "efiling", "remote", "selection", "pilot", "law",
]
FLORIDA_COUNTIES = [
    "alachua", "baker", "bay", "bradford", "brevard", "broward", "calhoun", "charlotte", "citrus", "clay", "collier", "columbia", "desoto",
    "dixie", "duval", "escambia", "flagler", "franklin", "gadsden", "gilchrist", "glades", "gulf", "hamilton", "hardee", "hendry",
    "hernando", "highlands", "hillsborough", "holmes", "indian river", "jackson", "jefferson", "lafayette", "lake", "lee", "leon", "levy",
    "liberty", "madison", "manatee", "marion", "martin", "miami-dade", "monroe", "nassau", "okaloosa", "okeechobee", "orange", "osceola",
    "palm beach", "pasco", "pinellas", "polk", "putnam", "santa rosa", "sarasota", "seminole", "st. johns", "st. lucie", "sumter",
    "suwannee", "taylor", "union", "volusia", "wakulla", "walton", "washington",
]
# Patterns of law schools, in the order in which they are asked.
LAW_SCHOOLS = [
    r"university of florida.*?law", r"florida state.*?law", r"stetson.*?law", r"miami.*?law", r"nova.*?law", r"barry.*?law", r"fiu.*?law", r"harvard law",
    r"yale law", r"stanford law", r"columbia law", r"nyu.*?law", r"georgetown.*?law", r"j\.?d\.?\s*,?\s*([\w\s]+university|[\w\s]+college)",
    r"juris doctor.*?([\w\s]+university|[\w\s]+college)",
]

#: White space by name; \s means other things in other regex dialects.
SPACE = r"[ \t\n\x0B\f\r ]"
HONORIFIC = r"(?i)^(hon\.?|judge|justice|chief\s+judge|chief\s+justice)\s+"


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


@F.pandas_udf(StringType())
def normalize_query(s: pd.Series) -> pd.Series:
    """Accents gone, straight quotes and hyphens, nothing else but words and blanks."""

    def one(q: str | None) -> str | None:
        if q is None:
            return None
        q = "".join(c for c in unicodedata.normalize("NFD", q) if not "̀" <= c <= "ͯ")
        q = re.sub("['`]", "'", q).replace("–", "-").replace("—", "-")
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s'-]", "", q, flags=re.A)).strip()

    return s.map(one)


def county_key(c: Column) -> Column:
    """Lower case without the first listed suffix that fits."""
    name = F.lower(F.trim(c))
    out = name
    for suffix in reversed(COUNTY_SUFFIXES):
        out = F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(out)
    return out


def county_alnum(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def county_seed(c: Column) -> Column:
    """T4: the name without its suffix, longest suffix first, case as it stands."""
    out = c
    for suffix in reversed(SEED_SUFFIXES):
        out = F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(out)
    return out


def _swapped(name: Column, keep: Column | None = None) -> Column:
    """'Last, First' as 'First Last' when there is exactly one comma."""
    parts = F.transform(F.split(name, ",", -1), lambda p: F.trim(p))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    may = F.size(parts) == 2
    return F.when(may if keep is None else may & ~keep & (a != "") & (b != ""), F.concat(b, F.lit(" "), a)).otherwise(name)


def judge_name(c: Column) -> Column:
    """T5: one title off the front, 'Last, First' swapped unless the last name ends in a generational suffix."""
    name = F.trim(c)
    low = F.lower(name)
    out = name
    for prefix in reversed(TITLE_PREFIXES):
        rest = F.regexp_replace(F.trim(F.substring(name, F.lit(len(prefix) + 1), F.length(name))), r"^[.,:\s]+", "")
        out = F.when(low.startswith(prefix), rest).otherwise(out)
    last = F.element_at(F.split(F.trim(F.get(F.split(out, ",", -1), F.lit(0))), r"\s+"), -1)
    return collapse(_swapped(out, last.rlike(r"(?i)^(jr|sr|ii|iii|iv|v|esq)\.?$")))


def identity_name(c: Column) -> Column:
    """Lower case, listed honorifics off both ends in turn, one comma swapped, marks gone.

    Names without an honorific are spared the search for each; the swap is one pattern, so the name is written into the plan once.
    """
    low = F.lower(F.trim(c))
    out, titles = low, "|".join(HONORIFICS)
    for h in HONORIFICS:
        out = F.regexp_replace(F.regexp_replace(out, rf"^{h}\s+", ""), rf"\s+{h}$", "")
    out = F.when(low.rlike(rf"^(?:{titles})\s|\s(?:{titles})$"), out).otherwise(low)
    swapped = F.regexp_replace(out, r"^ *([^,]*?) *, *([^,]*?) *\z", "$2 $1")
    return F.translate(collapse(swapped), ".,'\"", "")


def roster_name(c: Column) -> Column:
    """One honorific off, 'Last, First' swapped."""
    name = F.regexp_replace(F.trim(c), HONORIFIC, "")
    parts = F.split(name, r",\s*", -1)
    swapped = F.concat(F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(0)))
    return collapse(F.when(name.rlike(r"^[A-Za-z]+,\s*[A-Za-z]"), swapped).otherwise(name))


def bar_name(c: Column) -> Column:
    """struct(first, last) of a name without its generational suffix."""
    name = F.regexp_replace(judge_name(c), r"(?i),?\s+(jr|sr|ii|iii|iv|v|esq)\.?$", "")
    words = F.split(name, r"\s+")
    return F.struct(F.get(words, F.lit(0)).alias("first"), F.element_at(words, -1).alias("last"))


def court_type(raw: Column, state: Column) -> Column:
    """By the state's own names, the general ones, a canonical name within the text, else as it stands."""
    low, out = F.lower(F.trim(raw)), F.trim(raw)
    for name in reversed(CANONICAL_COURT_TYPES):
        out = F.when(low.contains(name.lower()), name).otherwise(out)

    def lookup(names: dict[str, str]) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), low)

    by_state = F.coalesce(*(F.when(F.upper(state) == s, lookup(names)) for s, names in STATE_COURT_TYPES.items()))
    return F.coalesce(by_state, lookup(COURT_TYPES), F.when(F.trim(raw).isin(CANONICAL_COURT_TYPES), F.trim(raw)), out)


def selection_method(c: Column) -> Column:
    """Elected, Appointed or null."""
    low = F.lower(c)
    return F.when(low.contains("elect"), "Elected").when(low.contains("appoint") | low.contains("merit"), "Appointed")


def slug(c: Column, most: int = 100) -> Column:
    """Lower case, other runs as one dash, one dash off each end, cut."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(most))


@F.pandas_udf(StringType())
def strict_slug(s: pd.Series) -> pd.Series:
    """A slug that writes accented letters without their accents."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().replace("&", " and ").lower()
        return re.sub(r"[\s-]+", "-", re.sub(r"[^a-z0-9\s-]", "", t)).strip("-")

    return s.map(one)


def looks_like_name(c: Column) -> Column:
    """Whether a text could be a judge's name."""
    low, words = F.lower(c), F.split(c, r"\s+")
    plain = c.rlike(r"^[A-Z][a-z]+(\s+[A-Z]\.?)?\s+[A-Z][a-z]+") | c.rlike(r"^[A-Z][a-z]+,\s*[A-Z][a-z]+")
    other = F.exists(F.array(*(F.lit(w) for w in NON_NAME_WORDS)), lambda w: F.contains(low, w))
    alone = c.rlike(r"(?i)^(judge|justice|chief|hon\.?|name|county|division)$")
    named = c.rlike(HONORIFIC) | (F.size(words).between(2, 6) & plain)
    return F.coalesce(F.length(c).between(5, 60) & ~alone & ~other & named, F.lit(False))


def is_county_name(c: Column) -> Column:
    """Whether a text names one of the listed counties."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), " county", "")).isin(FLORIDA_COUNTIES), F.lit(False))


def county_of_header(c: Column) -> Column:
    """The county that a heading names."""
    of, ends = F.regexp_extract(c, r"(?i)County\s+of\s+(.+?)$", 1), F.regexp_extract(c, r"(?i)^(.+?)\s+County$", 1)
    stripped = F.trim(F.regexp_replace(c, r"(?i)^Superior Court of California,?\s*", ""))
    return F.coalesce(F.nullif(F.trim(of), F.lit("")), F.nullif(F.trim(ends), F.lit("")), F.nullif(stripped, F.lit("")), c)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b).cast("double") / longest.cast("double"))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of distinct words."""
    words = [F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b)]
    return F.size(F.array_intersect(*words)).cast("double") / F.greatest(F.size(words[0]), F.size(words[1]), F.lit(1)).cast("double")


def identity_hash(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 of the non-empty parts, joined by bars, in lower case."""
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "|")
    return F.left(F.sha2(F.lower(joined), 256), F.lit(16))


def law_school(c: Column) -> Column:
    """The first of the listed school patterns that occurs, in lower case without full stops and commas.

    One look for any of them spares most rows the rest.
    """
    any_school = F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in LAW_SCHOOLS)), F.lit(False))
    found = F.when(F.lit(False), c)
    for p in LAW_SCHOOLS:
        found = found.when(c.rlike(f"(?i)(?:{p})"), F.regexp_extract(c, f"(?i)(?:{p})", 0))
    return F.when(any_school, F.trim(F.translate(F.lower(found), ".,", "")))


def graduation_year(c: Column) -> Column:
    """The year after law, JD or juris doctor, else any from 1950 to 2029."""
    by_law = F.regexp_extract(c, r"(?i)(?:law|j\.?d\.?|juris doctor)[^0-9]*(\d{4})", 1)
    return F.coalesce(F.nullif(by_law, F.lit("")), F.nullif(F.regexp_extract(c, r"\b(19[5-9]\d|20[0-2]\d)\b", 1), F.lit("")))


def title_of_slug(c: Column) -> Column:
    """T20."""
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def highlight(text: Column, query: str) -> Column:
    """Every occurrence of the query, whatever its case, in marks."""
    return F.regexp_replace(text, F.lit(f"(?i)({re.escape(query)})"), F.lit("<mark>$1</mark>")) if query else text


def byte_size(n: Column) -> Column:
    """T23."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def page_title(page: str, state: Column, county: Column | None = None, court: Column | None = None, judge: Column | None = None, site: str = "") -> Column:
    """The title of one of the five kinds of page: states, counties, courts, judges, judge; site ends that of the courts."""
    parts = {
        "states": [F.lit("U.S. Judges Directory — Browse by State")],
        "counties": [F.lit("Judges in "), state, F.lit(" — County Directory")],
        "courts": [F.lit("Courts in "), county, F.lit(", "), state, F.lit(f" — {site}")],
        "judges": [court, F.lit(" Judges in "), county, F.lit(", "), state],
        "judge": [F.lit("Judge "), judge, F.lit(" — "), court, F.lit(", "), county, F.lit(", "), state],
    }
    return F.concat(*parts[page])
