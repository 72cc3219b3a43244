"""Pages as rows: cells, list items and images of HTML, HTML as Markdown, JSON in pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
SKIPPED = {"script", "style", "noscript", "nav", "footer", "header", "iframe", "svg", "template"}
CELL = {"td", "th", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = "kind string, pos int, box int, line int, col int, text string, href string, src string, alt string, class string, parent_class string, width int, height int"


class _Cells(HTMLParser):
    """Cells, list items, headings and images in document order; box numbers tables and lists, line the rows in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict, dict | None]] = []
        self.boxes, self.lines, self.box, self.col = 0, 0, [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        cell = None
        if tag in ("table", "ul", "ol"):
            self.boxes += 1
            self.box.append(self.boxes)
        elif tag == "tr":
            self.lines, self.col = self.lines + 1, 0
        if tag in CELL:
            while tag in ("td", "th", "li") and self.open and self.open[-1][0] in ("td", "th", "li") and tag[0] == self.open[-1][0][0]:
                self.handle_endtag(self.open[-1][0])  # an end tag that was left out
            if tag == "li":
                self.lines, self.col = self.lines + 1, 0
            cell = {"kind": tag, "text": [], "href": None, "col": self.col}
            self.col += 1
        elif tag == "img":
            parent = self.open[-1][1] if self.open else {}
            size = lambda k: int(m[0]) if (m := re.match(r"\d+", a.get(k, ""))) else 0
            cell = {"kind": "img", "text": [], "href": None, "col": 0, "src": a.get("src"), "alt": a.get("alt", ""), "class": a.get("class", ""), "parent_class": parent.get("class", ""), "width": size("width"), "height": size("height")}
        elif tag == "a" and a.get("href"):
            for _, _, c in self.open:
                if c is not None and c["href"] is None:
                    c["href"] = a["href"]
        if cell is not None:
            cell |= {"pos": len(self.found), "box": self.box[-1] if self.box else 0, "line": self.lines}
            self.found.append(cell)
        if tag not in VOID:
            self.open.append((tag, a, cell if tag in CELL else None))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass
        if tag in ("table", "ul", "ol") and self.box:
            self.box.pop()

    def handle_data(self, data: str) -> None:
        if not any(t in ("script", "style") for t, _, _ in self.open[-2:]):
            for _, _, c in self.open:
                if c is not None:
                    c["text"].append(data)


def cells(pages: DataFrame) -> DataFrame:
    """page_id and a row for every cell, list item, heading and image of pages(page_id, html); null pages have none."""
    kinds = [(n, pa.string() if k == "string" else pa.int32()) for n, k in (x.split() for x in CELLS.split(", "))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("page_id"), *kinds])
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                parser = _Cells()
                parser.feed(html or "")
                rows = [{"page_id": page_id} | c | {"text": " ".join("".join(c["text"]).split())} for c in parser.found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(parse, f"page_id {kind}, {CELLS}")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.href: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in VOID:
            self.out.append("\n" if tag == "br" else "\n\n---\n\n" if tag == "hr" else "")
            return
        if self.hidden or tag in SKIPPED or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display:\s*none", a.get("style", "")):
            self.hidden.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "tr"):
            self.out.append("\n\n" if tag != "tr" else "\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a":
            self.href.append(a.get("href", ""))
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    """HTML as Markdown without noise tags and hidden nodes; blank lines collapsed, no blanks at line ends."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parser = _Markdown()
        parser.feed(text)
        lines = "\n".join(line.rstrip() for line in "".join(parser.out).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", lines).strip()

    return html.map(one)


_NEXT = (
    "props struct<pageProps struct<pageData struct<name string>, childrenInfos array<struct<props struct<content struct<name string, typeIdentifier string, url string>>>>, "
    "extraData struct<subnavigation struct<items array<struct<name string>>>>>>"
)


def next_data(html: Column) -> Column:
    """The JSON of a __NEXT_DATA__ script as a struct; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit("")), _NEXT)


def next_markdown(html: Column) -> Column:
    """A page's embedded data as Markdown: its name as a heading, then the people among its children; null without any."""
    p = next_data(html).props.pageProps
    names = F.transform(p.childrenInfos, lambda k: F.struct(F.trim(k.props.content["name"]).alias("name"), k.props.content.typeIdentifier.alias("kind")))
    person = lambda k: (k["name"].rlike(r"(?i)^(chief\s+)?(justice|judge)\s") | (F.coalesce(k.kind, F.lit("")) == "judge")) & ~k["name"].rlike(r"(?i)^(previous|former|current|retired|biograph)|transition|chronological|merit|news")
    lines = F.concat(F.array(F.concat(F.lit("# "), p.pageData["name"])), F.coalesce(F.transform(F.filter(names, person), lambda k: F.concat(F.lit("- "), k["name"])), F.array().cast("array<string>")))
    return F.nullif(F.array_join(lines, "\n\n"), F.lit(""))


def next_people(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, href of the people among a page's children, else in its sub-navigation."""
    p = F.col("_d.props.pageProps")
    data = pages.select("page_id", next_data(F.col("html")).alias("_d")).filter("_d is not null")
    kids = data.select("page_id", F.posexplode_outer(p.childrenInfos).alias("pos", "k"), F.lit(0).alias("tier")).select("page_id", "tier", "pos", F.trim("k.props.content.name").alias("name"), F.col("k.props.content.typeIdentifier").alias("kind"), F.col("k.props.content.url").alias("href"))
    nav = data.select("page_id", F.lit(1).alias("tier"), F.posexplode(p.extraData.subnavigation.items).alias("pos", "k")).select("page_id", "tier", "pos", F.trim("k.name").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("href"))
    person = F.col("name").rlike(r"(?i)^(chief\s+)?(justice|judge)\s") | (F.coalesce("kind", F.lit("")) == "judge")
    folder = F.col("name").rlike(r"(?i)^(previous|former|current|retired|biograph)|transition|chronological|merit|news")
    people = kids.unionByName(nav).filter(person & ~folder)
    best = people.groupBy("page_id").agg(F.min("tier").alias("tier"))
    return people.join(best, ["page_id", "tier"]).select("page_id", "pos", "name", "href")


_GATSBY = "result struct<data struct<counties array<struct<name string, judges array<struct<name string, title string>>, magistrates array<struct<name string>>>>>>"


def gatsby_people(pages: DataFrame) -> DataFrame:
    """page_id, county, name, role of the people in a page-data.json body."""
    c = pages.select("page_id", F.explode(F.from_json("html", _GATSBY).result.data.counties).alias("c"))
    judges = c.select("page_id", F.col("c.name").alias("county"), F.explode("c.judges").alias("j")).select("page_id", "county", "j.name", F.coalesce("j.title", F.lit("judge")).alias("role"))
    others = c.select("page_id", F.col("c.name").alias("county"), F.explode("c.magistrates").alias("j")).select("page_id", "county", "j.name", F.lit("magistrate").alias("role"))
    return judges.unionByName(others)
