"""Document fingerprints as Merkle trees, in DataFrame functions only.

A text's lines are its paragraphs; a paragraph is cut into clauses (up to a punctuation mark or
CLAUSE characters); runs of paragraphs form sections whose ends depend on the content, so an
insertion moves no later boundary. Leaves hash the clauses, paragraph nodes their leaves,
section nodes their paragraphs, the root its sections. Equal roots are equal texts. Two texts that differ
are compared from the top: branches with equal nodes are shared as a whole, and only below
those that differ are the leaves compared. The fingerprint is
root:section.section...:paragraph.paragraph...:leafleaf.leaf... with the leaves of each paragraph together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed parts of the tree: longest clause, hex digits of a node and of a leaf in the fingerprint.
CLAUSE = r"(?s)[^.,;:!?|\n]{0,47}."
NODE, LEAF = 16, 8
#: A section ends with a paragraph whose hash starts with 0 or 1, or after 32 of them.
SECTION = r"(?:[2-9a-f][0-9a-f]{15}\.){0,31}[0-9a-f]{16}\."


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, NODE)


def branches(text: Column) -> Column:
    """A string for each paragraph: its node (over the whole hashes of its clauses), then its leaves."""

    def branch(hashes: Column) -> Column:
        leaves = F.transform(hashes, lambda h: F.substring(h, 1, LEAF))
        return F.concat(_short(F.array_join(hashes, "")), F.array_join(leaves, ""))

    clauses = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), 0), F.md5))
    return F.transform(clauses, branch)


def sections(nodes: Column) -> Column:
    """Hashes of the runs of paragraph nodes that make up the sections."""
    joined = F.concat(F.array_join(nodes, "."), F.lit("."))
    return F.transform(F.regexp_extract_all(joined, F.lit(SECTION), 0), _short)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add prefix_branches (of the paragraphs, in order), prefix_nodes and prefix_print (the fingerprint)."""
    own, nodes, heads = f"{prefix}_branches", f"{prefix}_nodes", f"{prefix}_heads"
    df = df.withColumn(own, branches(F.col(text)))
    df = df.withColumn(nodes, F.transform(own, lambda b: F.substring(b, 1, NODE)))
    df = df.withColumn(heads, sections(F.col(nodes)))
    root = F.sha2(F.array_join(heads, "."), 256)
    leaves = F.array_join(F.transform(own, lambda b: F.substring(b, NODE + 1, 1 << 30)), ".")
    return df.withColumn(f"{prefix}_print", F.concat_ws(":", root, F.array_join(heads, "."), F.array_join(nodes, "."), leaves)).drop(heads)


def _leaves(of: Column) -> Column:
    """The distinct leaves of branches."""
    joined = F.array_join(F.transform(of, lambda b: F.substring(b, NODE + 1, 1 << 30)), "")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(f".{{{LEAF}}}"), 0))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """1 for equal texts, else the shared part of the leaves, always below 1.

    Leaves of branches that both have count as shared without being looked at; those of the
    branches that differ are compared one by one.
    """
    shared = F.array_intersect(a, b)
    known = F.aggregate(shared, F.lit(0.0), lambda n, x: n + (F.length(x) - NODE) / LEAF)
    mine, theirs = _leaves(F.array_except(a, b)), _leaves(F.array_except(b, a))
    both = F.size(F.array_intersect(mine, theirs)).cast("double")
    either = known + (F.size(mine) + F.size(theirs)).cast("double") - both
    part = (known + both) / F.greatest(either, F.lit(1.0))
    return F.when(same, 1.0).otherwise(F.least(part, F.lit(1.0) - F.lit(1.0) / (either + 2.0)))


def differing(a: Column, b: Column) -> Column:
    """Where two node arrays differ: start and the two ends (exclusive) of the edited run, null if equal.

    Nodes are compared from the front and from the back, so one edit gives one run.
    """
    n = F.least(F.size(a), F.size(b))
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    head = F.coalesce(F.get(F.filter(at, lambda i: (i < n) & (F.get(a, i) != F.get(b, i))), F.lit(0)), n)
    ra, rb = F.reverse(a), F.reverse(b)
    tail = F.coalesce(F.get(F.filter(at, lambda i: (i < n) & (F.get(ra, i) != F.get(rb, i))), F.lit(0)), n)
    tail = F.least(tail, n - head)
    run = F.struct(head.alias("start"), (F.size(a) - tail).alias("end_a"), (F.size(b) - tail).alias("end_b"))
    return F.when(a != b, run)


def locate_edits(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Add edited_sections and edited_paragraphs: the runs of branches in which two fingerprints differ."""

    def nodes(level: int) -> tuple[Column, Column]:
        return tuple(F.split(F.split_part(F.col(c), F.lit(":"), F.lit(level)), r"\.") for c in (before, after))

    return pairs.withColumns({"edited_sections": differing(*nodes(2)), "edited_paragraphs": differing(*nodes(3))})


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below value, as a balanced tree of comparisons."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= F.lit(bounds[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return pick(0, len(bounds))


def _nth_part(share: Column, parts: Column | int) -> Column:
    """Which of some equal parts of 0 to 1 a share falls into."""
    return F.least(F.floor(share * parts), F.lit(parts) - 1 if isinstance(parts, int) else parts - 1).cast("long")


def with_ranges(rows: DataFrame, key: str, columns: list[str], rows_per_task: int, coarse: int) -> DataFrame:
    """Add _hash and _range: rows in descending key, and within a key in ascending _hash, have falling ranges.

    At most `coarse` ranges end at quantiles of the key; for more, each of them is cut evenly by the
    key's value (whole numbers only). A key that several quantiles name is hot and is cut by hash, as are the null keys.
    """
    total, nulls = rows.agg(F.count("*"), F.count(F.when(F.col(key).isNull(), 1))).first()
    many, exact = max(1, total // rows_per_task), rows.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    first, cuts = max(1, min(many, coarse)), []
    if first > 1 and nulls < total:
        cuts = sorted(rows.agg(F.percentile_approx(key, [i / first for i in range(1, first)], 20 * first)).first()[0])
    bounds = sorted(set(cuts))
    hot = {b: cuts.count(b) * -(-many // first) for b in bounds if cuts.count(b) > 1}
    fine = -(-many // first) if exact and bounds else 1
    hashed = rows.withColumn("_hash", F.xxhash64(*columns))
    share, k = F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5, F.col(key)
    at, within = _range_of(k, bounds), F.lit(0).cast("long")
    if fine > 1:
        least, most = rows.agg(F.min(key), F.max(key)).first()
        low, high = (F.get(F.array(*(F.lit(float(x)) for x in ends)), at) for ends in ([least, *bounds], [*bounds, most]))
        within = _nth_part(F.when(high > low, (k.cast("double") - low) / (high - low)).otherwise(0.0), fine)
    widest = max([0, *hot.values()])
    part = F.lit(widest).cast("long")  # a hot key is the largest of its range: the others come behind its parts
    for value, parts in hot.items():
        part = F.when(k == F.lit(value), _nth_part(share, parts)).otherwise(part)
    ordered = (at.cast("long") * fine + within) * (widest + 1) + (widest - part)
    blank = -1 - _nth_part(share, max(1, -(-nulls // rows_per_task)))
    return hashed.withColumn("_range", F.when(k.isNull(), blank).otherwise(ordered))


def with_next(rows: DataFrame, key: str, columns: list[str], rows_per_task: int = 500, most_ranges: int = 200_000, coarse: int = 1024) -> DataFrame:
    """Add next_<column> from the row with the next lower key; after the last row comes the first.

    No single task sees all keys: rows are dealt over ranges, ordered in each, and a copy of
    each range's first row is put behind the range above it. A range has about rows_per_task rows, or
    more where there would be over most_ranges of them. Null keys come last; equal keys are ordered by a hash
    of the columns, then by these, and however many rows share a key, they are spread over tasks.
    """
    rows_per_task = max(rows_per_task, rows.count() // most_ranges)
    dealt = with_ranges(rows, key, columns, rows_per_task, coarse)
    firsts = dealt.groupBy("_range").agg(F.max(key).alias("_key")).orderBy(F.desc("_range")).collect()  # about most_ranges rows of two numbers
    if not firsts:
        return dealt.select(*rows.columns, *(F.col(c).alias(f"next_{c}") for c in columns))
    behind = [(firsts[i]["_range"], firsts[i]["_key"], firsts[i - 1]["_range"]) for i in range(len(firsts))]  # the first goes behind the last
    kind = dict(rows.dtypes)[key]
    copies = F.broadcast(rows.sparkSession.createDataFrame(behind, f"_from long, _key {kind}, _to long"))
    order = [F.desc_nulls_last(key), "_hash", *columns]
    copied = dealt.join(copies, (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_key")))
    one = Window.partitionBy("_to").orderBy(*order[1:])
    copied = copied.withColumn("_n", F.row_number().over(one)).filter("_n = 1").withColumn("_range", F.col("_to")).drop("_n", "_from", "_to", "_key")
    all_rows = dealt.withColumn("_copy", F.lit(0)).unionByName(copied.withColumn("_copy", F.lit(1)))
    by_key = Window.partitionBy("_range").orderBy(F.col("_copy"), *order)
    lead = {f"next_{c}": F.lead(c).over(by_key) for c in columns}
    return all_rows.withColumns(lead).filter("_copy = 0").drop("_copy", "_range", "_hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, with likenesses and the place of the edit.

    The edited text has the last third of the characters replaced by as many (or all) of the
    first of the next document's, in descending doc_id. A null text counts as empty; the empty
    text has a root like any other. Equal doc_ids are neighbours in a fixed order; a table of
    one row is its own neighbour; an empty table gives an empty one. Texts of any length are hashed whole. Other columns
    are not looked at. edit_start, edit_end and edited_end number the paragraphs whose nodes differ, from
    0, the ends exclusive in either text; they are null if the texts are equal.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"])
    third = F.floor(F.length("text") / 3).cast("int")
    kept = F.col("text").substr(F.lit(1), F.length("text") - third)
    edited = F.concat(kept, F.col("next_text").substr(F.lit(1), third))
    rows = rows.select("doc_id", "text", "next_text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_tree(with_tree(rows, "text", "own"), "edited", "edited")
    rows = rows.withColumns({"next_branches": branches(F.col("next_text")), "edit": differing(F.col("own_nodes"), F.col("edited_nodes"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("own_branches"), F.col("edited_branches"), F.col("own_print") == F.col("edited_print")).alias("near_edited"),
        likeness(F.col("own_branches"), F.col("next_branches"), F.col("text") == F.col("next_text")).alias("near_next"),
        F.col("edit.start").alias("edit_start"),
        F.col("edit.end_a").alias("edit_end"),
        F.col("edit.end_b").alias("edited_end"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for fingerprints() over documents."""

    def short(x: str) -> str:
        return f"substr(sha256({x}), 1, {NODE})"

    def clauses(text: str) -> str:
        return f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{CLAUSE}'), lambda c: md5(c)))"

    def branch(hashes: str) -> str:
        return f"list_transform({hashes}, lambda h: {short("array_to_string(h, '')")} || array_to_string(list_transform(h, lambda x: substr(x, 1, {LEAF})), ''))"

    def nodes(name: str) -> str:
        return f"list_transform({name}_branches, lambda b: substr(b, 1, {NODE})) AS {name}_nodes"

    def heads(name: str) -> str:
        return f"list_transform(regexp_extract_all(array_to_string({name}_nodes, '.') || '.', '{SECTION}'), lambda s: {short('s')}) AS {name}_heads"

    def whole(name: str) -> str:
        h = f"array_to_string({name}_heads, '.')"
        leaves = f"array_to_string(list_transform({name}_branches, lambda b: substr(b, {NODE + 1})), '.')"
        return f"sha256({h}) || ':' || {h} || ':' || array_to_string({name}_nodes, '.') || ':' || {leaves}"

    def leaves(of: str) -> str:
        joined = f"array_to_string(list_transform({of}, lambda b: substr(b, {NODE + 1})), '')"
        return f"list_distinct(regexp_extract_all({joined}, '.{{{LEAF}}}'))"

    def less(a: str, b: str) -> str:
        return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"

    def parts(a: str, b: str, name: str) -> str:
        shared = f"list_distinct(list_intersect({a}, {b}))"
        known = f"coalesce(list_sum(list_transform({shared}, lambda x: (length(x) - {NODE}) / {LEAF})), 0)::DOUBLE"
        return f"{known} AS {name}_known, {leaves(less(a, b))} AS {name}_mine, {leaves(less(b, a))} AS {name}_theirs"

    def like(name: str, same: str) -> str:
        both = f"CAST(len(list_intersect({name}_mine, {name}_theirs)) AS DOUBLE)"
        either = f"({name}_known + CAST(len({name}_mine) + len({name}_theirs) AS DOUBLE) - {both})"
        return f"CASE WHEN {same} THEN 1.0::DOUBLE ELSE least(({name}_known + {both}) / greatest({either}, 1.0::DOUBLE), 1.0::DOUBLE - 1.0::DOUBLE / ({either} + 2.0::DOUBLE)) END"

    def agree(a: str, b: str) -> str:
        n = f"least(len({a}), len({b}))"
        return f"coalesce(list_position(list_transform(range({n}), lambda i: {a}[i + 1] <> {b}[i + 1]), true) - 1, {n})"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, length(text) AS n_chars
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 3) || substring(next_text, 1, n_chars // 3) AS edited FROM n),
c AS (SELECT *, {clauses('text')} AS own_clauses, {clauses('edited')} AS edited_clauses, {clauses('next_text')} AS next_clauses FROM e),
t AS (SELECT *, {branch('own_clauses')} AS own_branches, {branch('edited_clauses')} AS edited_branches, {branch('next_clauses')} AS next_branches FROM c),
u AS (SELECT *, {nodes('own')}, {nodes('edited')} FROM t),
h AS (SELECT *, {heads('own')}, {heads('edited')}, {parts('own_branches', 'edited_branches', 'e')}, {parts('own_branches', 'next_branches', 'n')},
      {agree('own_nodes', 'edited_nodes')} AS head, {agree('list_reverse(own_nodes)', 'list_reverse(edited_nodes)')} AS tail FROM u),
p AS (SELECT *, {whole('own')} AS fingerprint, {whole('edited')} AS edited_fingerprint, least(tail, least(len(own_nodes), len(edited_nodes)) - head) AS back FROM h)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  {like('e', 'fingerprint = edited_fingerprint')} AS near_edited,
  {like('n', 'text = next_text')} AS near_next,
  CASE WHEN own_nodes <> edited_nodes THEN CAST(head AS INTEGER) END AS edit_start,
  CASE WHEN own_nodes <> edited_nodes THEN CAST(len(own_nodes) - back AS INTEGER) END AS edit_end,
  CASE WHEN own_nodes <> edited_nodes THEN CAST(len(edited_nodes) - back AS INTEGER) END AS edited_end
FROM p"""
