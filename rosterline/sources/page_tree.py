"""Pages as trees in a table: every element is a node with an interval, and selectors are joins of intervals.

A node's number is its place in document order and `stop` is the number of the last node inside it, so one
node lies in another of the page if its number lies in the other's interval. `nodes` reads each page
once; written, the table answers any number of selectors without reading pages again.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.sources.markup import VOID

NODE = "page_id {id}, node int, stop int, depth int, parent int, nth int, tag string, classes array<string>, attributes map<string,string>, text string"
# Fixed values of HTML: what an opening tag closes if it is still open, and what stops the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "dl", "hr", "figure", "address", "details", "fieldset"}
SCOPES = {"td", "th", "table", "caption", "button", "object", "template", "html", "marquee"}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict, dict[str, int]]] = []
        self.top: dict[str, int] = {}

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return
            if self.open[i][0] in scope:
                return

    def _pop(self, keep: int) -> None:
        for _, node, _ in self.open[keep:]:
            node["stop"] = len(self.found) - 1
        del self.open[keep:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self._close({"p"}, SCOPES)
        own = self.open[-1][2] if self.open else self.top
        own[tag] = own.get(tag, 0) + 1
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")  # the first of repeated attributes holds
        n = len(self.found)
        node = {"node": n, "stop": n, "depth": len(self.open), "parent": self.open[-1][1]["node"] if self.open else None, "nth": own[tag], "tag": tag, "classes": a.get("class", "").split(), "attributes": list(a.items()), "text": []}
        self.found.append(node)
        if tag not in VOID:
            self.open.append((tag, node, {}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no <div/>

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close({tag}, SCOPES - {tag} if tag not in ("table", "html", "body", "tr", "tbody") else set())

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            self.open[-1][1]["text"].append(data)


def tree_of(html: str | None) -> list[dict]:
    """The elements of one page in document order. What browsers mend by moving nodes about is left where it stands; elements left open end where what holds them ends."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._pop(0)
    for node in tree.found:
        node["text"] = " ".join("".join(node["text"]).split())
    return tree.found


def nodes(pages: DataFrame) -> DataFrame:
    """A row per element of pages(page_id, html): node, stop, depth, parent, nth among its like siblings, tag, classes, attributes and its own text. Null and empty pages have none."""
    source = pages.select("page_id", "html")
    schema = NODE.format(id=source.schema["page_id"].dataType.simpleString())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                trees = [tree_of(h) for h in batch.column("html").to_pylist()]
                found = [n for t in trees for n in t]
                index = pa.array([i for i, t in enumerate(trees) for _ in t], pa.int64())
                column = lambda k, kind: pa.array([n[k] for n in found], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id").take(index), *[column(k, pa.int32()) for k in ("node", "stop", "depth", "parent", "nth")], column("tag", pa.string()),
                        column("classes", pa.list_(pa.string())), column("attributes", pa.map_(pa.string(), pa.string())), column("text", pa.string()),
                    ], names=["page_id", "node", "stop", "depth", "parent", "nth", "tag", "classes", "attributes", "text"],
                )

    return source.mapInArrow(read, schema)


def element(tag: str | None = None, cls: str | None = None, attribute: tuple[str, str] | None = None, first_of_type: bool = False) -> Column:
    """Whether a node is one of: a tag, a class, an attribute that holds a text in any case, the first of its kind among its siblings."""
    found = F.lit(True)
    if tag:
        found &= F.col("tag") == tag
    if cls:
        found &= F.array_contains("classes", cls)
    if attribute:
        found &= F.coalesce(F.lower(F.element_at("attributes", attribute[0])).contains(attribute[1].lower()), F.lit(False))
    return found & (F.col("nth") == 1) if first_of_type else found


def within(inner: DataFrame, outer: DataFrame, *keep: str) -> DataFrame:
    """Rows of nodes `inner` for each node of `outer` that they lie in, with the columns `keep` of the outer: a join of intervals on one page."""
    around = outer.select(F.col("page_id").alias("_page"), F.col("node").alias("_from"), F.col("stop").alias("_to"), *keep)
    inside = (F.col("page_id") == F.col("_page")) & (F.col("node") > F.col("_from")) & (F.col("node") <= F.col("_to"))
    return inner.join(around, inside).drop("_page", "_from", "_to")


def selected(tree: DataFrame, *path: Column) -> DataFrame:
    """The nodes at the end of a path of descendants: selected(tree, element("nav"), element("a")) is `nav a`, each node once."""
    found = tree.filter(path[0])
    for step in path[1:]:
        outer = found.select("page_id", "node", "stop")
        found = within(tree.filter(step), outer).dropDuplicates(["page_id", "node"])
    return found


def first_in_places(tree: DataFrame, inner: list[Column], places: list[Column]) -> DataFrame:
    """For each page and place the first node in document order that is inner[i] and lies in a node that is places[i]; `place` is i from 0. One join for all places."""
    which = lambda tests: F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())
    outer = tree.withColumn("_place", F.explode(which(places))).select("page_id", "node", "stop", "_place")
    candidates = tree.withColumn("_fits", which(inner)).filter(F.size("_fits") > 0)
    found = within(candidates, outer, "_place").filter(F.array_contains("_fits", F.col("_place")))
    value = F.struct("node", "tag", "classes", "attributes", "text")
    first = found.groupBy("page_id", F.col("_place").alias("place")).agg(F.min_by(value, "node").alias("_first"))
    return first.select("page_id", "place", "_first.*")
