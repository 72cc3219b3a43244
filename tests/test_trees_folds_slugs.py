"""Page trees, ordered folds and free slugs against plain loops and pages made by hand."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from rosterline.operators import admin, extract, identity, reports, slugs
from rosterline.operators.folds import ordered_fold
from rosterline.sources.page_tree import element, first_in_places, nodes, selected, tree_of, within

PAGES = "page_id long, url string, html string"


def test_tree_intervals():
    html = "<ul><li>a<li>b <b>c</b><ul><li>d</ul></ul><p>one<p>two<div>three</p></div><table><tr><td>x<td>y<tr><td>z</table><br/><img src=a src=b></span><i>open"
    tree = tree_of(html)
    by = {n["node"]: n for n in tree}
    for n in tree:
        inside = [m for m in tree if n["node"] < m["node"] <= n["stop"]]
        assert all(m["stop"] <= n["stop"] and m["depth"] > n["depth"] for m in inside)
        assert n["parent"] is None or by[n["parent"]]["node"] < n["node"] <= by[n["parent"]]["stop"]
    shape = [(n["tag"], n["depth"], n["text"]) for n in tree]
    assert shape[:5] == [("ul", 0, ""), ("li", 1, "a"), ("li", 1, "b"), ("b", 2, "c"), ("ul", 2, "")]
    assert ("p", 0, "one") in shape and ("p", 0, "two") in shape and ("div", 0, "three") in shape
    assert [s[2] for s in shape if s[0] == "td"] == ["x", "y", "z"] and [s[1] for s in shape if s[0] == "tr"] == [1, 1]
    assert dict(next(n for n in tree if n["tag"] == "img")["attributes"]) == {"src": "a"} and shape[-1] == ("i", 0, "open")
    assert tree_of(None) == tree_of("") == tree_of("no tags") == [] and len(tree_of("<p " * 3000)) <= 1


def test_selectors(spark):
    html = "<nav><ul><li><a href=/1>one</a></ul></nav><a href=/2>two</a><nav><nav><a href=/3>three</a></nav></nav>"
    tree = nodes(spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", html)], PAGES))
    links = selected(tree, element("nav"), element("a")).select("page_id", F.element_at("attributes", "href").alias("h")).collect()
    assert sorted((r.page_id, r.h) for r in links) == [(1, "/1"), (1, "/3"), (3, "/1"), (3, "/3")]
    assert selected(tree, element("nav"), element("li"), element("a", attribute=("href", "1"))).count() == 2
    assert within(tree.filter(element("a")), tree.filter(element("nav")).select("page_id", "node", "stop", F.col("depth").alias("outer")), "outer").count() == 6
    first = first_in_places(tree, [element("a"), element("a", first_of_type=True)], [element("ul"), element("nav")]).collect()
    assert sorted((r.page_id, r.place, r.text) for r in first) == [(i, p, "one") for i in (1, 3) for p in (0, 1)]
    assert nodes(spark.createDataFrame([], PAGES)).count() == 0


def test_portraits_stay_in_their_place(spark):
    """What the original answers: no image from behind the end of a place, no place after one whose first image is a logo but the next places."""
    pages = [
        (1, '<div class="judge-photo"></div><footer><img src="/ad.jpg"></footer>', None),
        (2, '<div class="judge-photo"><img src="/logo.png"></div><main></main><img src="/no.jpg">', None),
        (3, '<article><img src="/a.jpg" alt="me"><img src="/j.jpg" alt="Judge Lee"></article>', "https://c.gov/j.jpg"),
        (4, '<main><p><img src="seal.png"></p><img src="b.jpg"></main>', None),
        (5, '<div class="judge-photo-x"><img src="/no.jpg"></div><div class="a content-area"><b></b><img src="c.jpg"></div>', "https://c.gov/x/c.jpg"),
        (6, None, None),
        (7, '<div class="bio-photo"><img></div><div class="judge-profile"><img src="p.jpg" alt="Seal"></div><main><img src="m.jpg"></main>', "https://c.gov/x/m.jpg"),
    ]
    rows = spark.createDataFrame([(i, "https://c.gov/x/y", h) for i, h, _ in pages], PAGES)
    want = {i: p for i, _, p in pages if p}
    assert {r.page_id: r.photo for r in extract.court_page_portraits(rows).collect()} == want
    tree = nodes(rows).cache()
    assert {r.page_id: r.photo for r in extract.court_page_portraits(rows, tree).collect()} == want
    tree.unpersist()
    long = "<p>" + "long " * 30 + "</p>"
    boxes = [
        (1, "https://en.wikipedia.org/w", '<table class="infobox"><tr><td>none</td></tr></table><div><img src="/map.png"></div>' + long, None),
        (2, "https://en.wikipedia.org/w", '<table class="infobox vcard"><td><img width="40" src="/flag.png"><img width="200" src="/a.jpg"></table>' + long, None),
        (3, "https://en.wikipedia.org/w", '<table class="infobox"><td><img width="40" src="/f.png"></table><table class="vcard"><td><img src="//up.org/b.jpg"></table>' + long, "https://up.org/b.jpg"),
        (4, "https://ballotpedia.org/w", '<div class="infobox"><img src="/icon.gif"></div><div class="widget-row"><img src="/c.jpg"></div>' + long, "https://ballotpedia.org/c.jpg"),
        (5, "https://other.org/w", '<table class="infobox"><td><img src="/d.jpg"></table>' + long, None),
        (6, "https://en.wikipedia.org/w", '<table class="infobox"><td><img src="/e.jpg"></table>', None),
        (7, None, '<table class="infobox"><td><img src="/e.jpg"></table>' + long, None),
    ]
    got = extract.encyclopaedia_portraits(spark.createDataFrame([(i, u, h) for i, u, h, _ in boxes], PAGES))
    assert {r.page_id: r.photo for r in got.collect()} == {i: p for i, *_, p in boxes if p}


def test_ordered_fold_of_a_hot_key(spark):
    rows = spark.range(40_000).select((F.col("id") % 20 > 0).alias("rare"), F.when(F.col("id") % 20 > 0, "hot").alias("k"), (F.col("id") * 7919 % 40_000).alias("n"))
    out = ordered_fold(rows.select("k", "n"), ["k"], ["n"], "k string, n long, last long", dict, lambda s, r: s.update(c=s.get("c", 0) + 1, bad=s.get("bad", 0) + (s.get("n", -1) >= r["n"]), n=r["n"]) or iter(()), lambda s: iter([{"k": None, "n": s["c"], "last": s["bad"]}]))
    assert sorted((r.n, r.last) for r in out.collect()) == [(2_000, 0), (38_000, 0)]


def plain_merge(rows, columns):
    """The loop of the original over records in order: score, base, fill, union, maximum."""
    score = lambda r: sum(r[c] is not None and r[c] != "" for c in identity.SCORED if c in columns)
    seen, gone = {}, []
    for row in rows:
        key = (row["full_name"].lower().strip(), row["court_type"].lower().strip(), (row["county"] or "").lower())
        if key not in seen:
            seen[key] = dict(row)
            continue
        held = seen[key]
        base, other = (row, held) if score(row) > score(held) else (held, row)
        new = dict(base)
        for c in identity.FILLED:
            if c in columns and new[c] is None:
                new[c] = other[c]
        new["fields"] = list(dict.fromkeys([*base["fields"], *other["fields"]]))
        new["confidence"] = max(base["confidence"], other["confidence"])
        gone.append((other["seq"], base["seq"]))
        seen[key] = new
    return list(seen.values()), gone


def test_records_fold_as_a_loop_does(spark):
    r = random.Random(8)
    columns = ["seq", "full_name", "court_type", "county", "photo_url", "division", "bar_admission_state", "education", "confidence", "fields", "note"]
    some = lambda *v: r.choice([None, "", *v])
    rows = [
        dict(zip(columns, (i, r.choice(["Ann", "ANN ", "Bo"]), r.choice(["A", "b"]), some("kern", "Kern"), some("p", "q"), some("d"), some("TX"), some("e", "f"), r.random(), [r.choice("mzab") for _ in range(r.randrange(3))], f"n{i}"), strict=True))
        for i in range(400)
    ]
    schema = "seq long, full_name string, court_type string, county string, photo_url string, division string, bar_admission_state string, education string, confidence double, fields array<string>, note string"
    df = spark.createDataFrame([tuple(x[c] for c in columns) for x in rows], schema).repartition(5)
    want, gone = plain_merge(rows, columns)
    got = identity.folded_by_key(df).collect()
    assert sorted((x.seq, x.duplicate_of) for x in got if x.duplicate_of is not None) == sorted(gone)
    pick = lambda x: tuple(str(x[c]) for c in columns)
    assert sorted(pick(x) for x in got if x.duplicate_of is None) == sorted(map(pick, want))
    assert sum(x.merged for x in identity.merged_by_key(df).collect()) == len(gone)
    clash = df.withColumn("merged", F.lit("mine")).withColumn("_key", F.lit("x"))
    assert {x.merged for x in identity.folded_by_key(clash).collect()} == {"mine"}


def asked(rows, held):
    """Asking row by row for the least free suffix."""
    taken, out = set(held), {}
    for i, scope, base in rows:
        n, found = 2, base
        while (scope, found) in taken:
            found, n = f"{base}-{n}", n + 1
        taken.add((scope, found))
        out[i] = found
    return out


def test_slugs_are_free(spark):
    r = random.Random(4)
    names = ["Ann Lee", "Ann Lee 2", "Ann Lee-2-2", "Ann Lee 02", "Ann  Lee 1", "Ánn Lée", "2", "", "Bo", "O'Brien", None, "-3", "Bo 10"]
    rows = [(i, r.choice([1, 2, None]), r.choice(names)) for i in range(500)]
    held = [(1, "ann-lee-3"), (1, "ann-lee"), (2, "bo-2-2"), (None, "bo"), (None, "-2"), (2, "ann-lee-2"), (2, "ann-lee-2")]
    df = spark.createDataFrame([(*x, "old") for x in rows], "id long, court long, name string, slug string").repartition(4)
    base = {x.id: x.b for x in df.select("id", slugs.base_slug(F.col("name")).alias("b")).collect()}
    for existing in ([], held):
        more = spark.createDataFrame(existing, "court long, slug string") if existing else None
        got = {x.id: x.slug for x in slugs.unique_slugs(df, "court", "name", "id", more).collect()}
        assert got == asked([(i, s, base[i]) for i, s, _ in rows], existing)
    three = spark.createDataFrame([(1, 1, "Ann Lee"), (2, 1, "Ann Lee"), (3, 1, "Ann Lee 2")], "id long, court long, name string")
    assert {x.id: x.slug for x in slugs.unique_slugs(three, "court", "name", "id").collect()} == {1: "ann-lee", 2: "ann-lee-2", 3: "ann-lee-2-2"}
    assert slugs.unique_slugs(three.limit(0), "court", "name", "id").count() == 0


def test_many_rows_of_one_name_are_one_range():
    taken = slugs.Taken()
    for n in range(1, 5000):
        assert taken.free("") == ("" if n == 1 else f"-{n}")
    assert taken.ranges == {"": [[1, 4999]]}
    taken.release("-40"), taken.release("-41"), taken.release("")
    assert [taken.free("") for _ in range(4)] == ["", "-40", "-41", "-5000"]


def test_taken_slugs_against_a_counter():
    r = random.Random(1)
    taken, plain = slugs.Taken(), Counter()
    bases = ["a", "a-2", "a-2-2", "a-1", "a-02", "a-10"]
    for _ in range(4000):
        b = r.choice(bases)
        if r.random() < 0.4:
            x = r.choice(sorted(+plain) or [b])
            taken.release(x)
            plain[x] = max(0, plain[x] - 1)
        elif r.random() < 0.3:
            x = f"{b}-{r.randrange(2, 12)}"
            taken.hold(x)
            plain[x] += 1
        else:
            x, n = b, 2
            while plain[x]:
                x, n = f"{b}-{n}", n + 1
            assert taken.free(b) == x
            plain[x] += 1
        assert all((y in taken) == (plain[y] > 0) for y in [*bases, *list(plain)[:5]])


def test_renames_get_new_slugs(spark):
    r = random.Random(6)
    start = [(i, i % 4, r.choice(["Ann", "Bo", "Cy 2"])) for i in range(120)]
    judges = slugs.unique_slugs(spark.createDataFrame(start, "judge_id long, court_id long, full_name string"), "court_id", "full_name", "judge_id").withColumn("photo_url", F.lit("p"))
    changes = []
    for i in r.sample(range(125), 90):
        given = r.sample(["full_name", "court_id", "photo_url"], r.randrange(1, 4))
        changes.append((i, given, r.choice(["Ann", "Ann 2", " Cy", " "]), r.choice([0, 1, 5]), ""))
    new = spark.createDataFrame(changes, "judge_id long, set array<string>, full_name string, court_id long, photo_url string")
    before = {x.judge_id: (x.court_id, x.full_name, x.slug) for x in judges.collect()}
    now = dict(before)
    for i, given, name, court, _ in sorted(changes):
        if i not in now or ("full_name" in given and not name.strip()):
            continue
        own = (court if "court_id" in given else now[i][0], now[i][1], now[i][2])
        if "full_name" in given:
            base, n = "-".join(name.lower().split()), 2
            found, others = base, {(c, s) for k, (c, _, s) in now.items() if k != i}
            while (own[0], found) in others:
                found, n = f"{base}-{n}", n + 1
            own = (own[0], name.strip(), found)
        now[i] = own
    got = {x.judge_id: (x.court_id, x.full_name, x.slug) for x in admin.partially_updated(judges, new).collect() if x.error != "Judge not found"}
    assert got == now and sum(now[k] != before[k] for k in now) > 30


def test_sitemap_lists_what_has_no_judge(spark):
    states = spark.createDataFrame([(1, "a", None), (2, "b", "2024-01-05 00:00:00")], "state_id int, slug string, updated_at string")
    counties = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "county_id int, state_id int, slug string")
    courts = spark.createDataFrame([(1, 1, "c"), (2, 1, "d")], "court_id int, county_id int, slug string")
    judges = spark.createDataFrame([(1, "j", "VERIFIED"), (1, "k", "REJECTED"), (9, "l", "VERIFIED")], "court_id int, slug string, status string")
    rows = reports.sitemap(states, counties, courts, judges, "https://x.org", "2024-02-01 00:00:00", per_file=3).collect()
    assert sorted(r.loc.removeprefix("https://x.org/judges/") for r in rows) == ["", "a/", "a/x/", "a/x/c/", "a/x/c/j/", "a/x/d/", "a/y/", "b/"]
    assert {r.loc[-3:]: str(r.last_modified) for r in rows if r.last_modified} == {"es/": "2024-02-01 00:00:00", "/b/": "2024-01-05 00:00:00"}
    assert sorted(r.file for r in rows) == [1, 1, 1, 2, 2, 2, 3, 3]
