"""Slugs that are free: the least suffix that no other row of the scope holds.

All names that can ever want the same slug share its root: the slug without the numbers at its end. So a
scope and a root are one group, and its requests, releases and holdings are one ordered fold: just what
asking row by row gives, whatever the order of the names ("Ann Lee", "Ann Lee", "Ann Lee 2").
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.text import strict_slug
from rosterline.operators.folds import ordered_fold

HELD, RELEASED, MOVED, ASKED = range(4)


def base_slug(name: Column) -> Column:
    """T12 in at most 100 characters; a null name is empty."""
    return F.left(strict_slug(F.coalesce(name, F.lit(""))), F.lit(100))


def root_of(slug: Column) -> Column:
    return F.regexp_replace(slug, r"(-\d+)+$", "")


class Taken:
    """The slugs of one scope and root that are held: for every stem the numbers behind it, as ranges; a slug without a number has 1.

    A name that is asked for again and again is one range, however often.
    """

    def __init__(self) -> None:
        self.ranges: dict[str, list[list[int]]] = {}
        self.again: Counter[str] = Counter()  # what more than one row holds

    @staticmethod
    def parts(slug: str) -> tuple[str, int]:
        m = re.fullmatch(r"(.*)-([2-9]|[1-9]\d+)", slug, re.S)
        return (m[1], int(m[2])) if m else (slug, 1)

    def _at(self, stem: str, n: int) -> tuple[list[list[int]], int]:
        """The ranges of a stem and the place of the last one that begins at n or before."""
        ranges = self.ranges.setdefault(stem, [])
        return ranges, bisect_right(ranges, n, key=lambda r: r[0]) - 1

    def __contains__(self, slug: str) -> bool:
        stem, n = self.parts(slug)
        ranges, i = self._at(stem, n)
        return i >= 0 and n <= ranges[i][1]

    def hold(self, slug: str) -> None:
        stem, n = self.parts(slug)
        ranges, i = self._at(stem, n)
        if i >= 0 and n <= ranges[i][1]:
            self.again[slug] += 1
            return
        ranges.insert(i + 1, [n, n])
        for k in (i + 1, i):  # grow together with the next and the one before
            if 0 <= k < len(ranges) - 1 and ranges[k][1] + 1 == ranges[k + 1][0]:
                ranges[k : k + 2] = [[ranges[k][0], ranges[k + 1][1]]]

    def release(self, slug: str) -> None:
        """A slug that two rows hold against the rules is free once both let it go."""
        if self.again[slug]:
            self.again[slug] -= 1
            return
        stem, n = self.parts(slug)
        ranges, i = self._at(stem, n)
        if i >= 0 and n <= ranges[i][1]:
            low, high = ranges[i]
            ranges[i : i + 1] = [r for r in ([low, n - 1], [n + 1, high]) if r[0] <= r[1]]

    def free(self, base: str) -> str:
        """The least of base, base-2, base-3 ... that is free, held from now on."""
        found = base
        if base in self:
            ranges, i = self._at(base, 2)
            found = f"{base}-{ranges[i][1] + 1 if i >= 0 and ranges[i][1] >= 2 else 2}"
        self.hold(found)
        return found


def _settled(events: DataFrame) -> DataFrame:
    """(id, slug) of what was asked for, from events(scope, root, place, kind, id, slug) in the order of place and kind; slug is the base of an ASKED one."""

    def step(taken: Taken, row: dict) -> Iterator[dict]:
        if row["kind"] in (HELD, MOVED):
            taken.hold(row["slug"])
        elif row["kind"] == RELEASED:
            taken.release(row["slug"])
        else:
            yield {"id": row["id"], "slug": taken.free(row["slug"])}

    kind = events.schema["id"].dataType.simpleString()
    return ordered_fold(events, ["scope", "root"], ["place", "kind", "id"], f"id {kind}, slug string", Taken, step, lambda taken: iter(()))


def _event(rows: DataFrame, scope: Column, place: Column, kind: int, id_: Column, slug: Column) -> DataFrame:
    return rows.select(scope.alias("scope"), root_of(slug).alias("root"), place.alias("place"), F.lit(kind).alias("kind"), id_.alias("id"), slug.alias("slug"))


def unique_slugs(rows: DataFrame, scope: str, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows with a slug each, asked for in the order of `order` (unique, not null): -2, -3 ... where the plain one is held.

    existing has the scope column and slug: what is held already. Null names share the empty slug; a null scope is one scope.
    """
    asked = _event(rows, F.col(scope), F.col(order), ASKED, F.col(order), base_slug(F.col(name)))
    if existing is not None:
        held = _event(existing, F.col(scope), F.lit(None).cast(rows.schema[order].dataType), HELD, F.lit(None).cast(rows.schema[order].dataType), F.col("slug"))
        families = asked.select("scope", "root").distinct()
        same = held["scope"].eqNullSafe(families["scope"]) & (held["root"] == families["root"])
        asked = held.join(families, same, "left_semi").unionByName(asked)  # nulls sort first
    found = _settled(asked).select(F.col("id").alias("_asked"), F.col("slug").alias("_slug"))
    return rows.drop("slug").join(found, F.col(order) == F.col("_asked"), "left").drop("_asked").withColumnRenamed("_slug", "slug")


def renamed(before: DataFrame, changes: DataFrame, id_: str, scope: str) -> DataFrame:
    """(id, slug) of the rows that get a new name, one after another in the order of id.

    before(id, scope, slug): all rows as they are. changes(id, new_scope, new_name): new_name is null where only the scope changes.
    A row's own slug is free to it; those renamed earlier hold their new ones, later ones still their old.
    """
    new = changes.join(before.select(F.col(id_).alias("_id"), F.col(scope).alias("_scope"), F.col("slug").alias("_slug")), F.col(id_) == F.col("_id"))
    to = F.coalesce("new_scope", "_scope")
    asks = F.col("new_name").isNotNull()
    releases = _event(new.filter("_slug is not null"), F.col("_scope"), F.col(id_), RELEASED, F.col(id_), F.col("_slug"))
    moves = _event(new.filter(~asks & F.col("_slug").isNotNull()), to, F.col(id_), MOVED, F.col(id_), F.col("_slug"))
    asked = _event(new.filter(asks), to, F.col(id_), ASKED, F.col(id_), base_slug(F.col("new_name")))
    none = F.lit(None).cast(before.schema[id_].dataType)
    held = _event(before.filter("slug is not null"), F.col(scope), none, HELD, none, F.col("slug"))
    families = asked.select("scope", "root").distinct()
    events = held.unionByName(releases).unionByName(moves)
    same = events["scope"].eqNullSafe(families["scope"]) & (events["root"] == families["root"])
    return _settled(events.join(families, same, "left_semi").unionByName(asked))
