"""Jaccard self-join on word n-grams through a MinHash LSH forest.

A text's shingles are its runs of five words (lower-cased, without punctuation), as a set of
64-bit hashes; a shorter text is one shingle. Equal sets are one class. Each class has a
label in every tree: `depth` minima of a byte each. A tree is its labels in sorted order (a
range partition, sorted inside), so classes that share a prefix lie side by side. Matched
prefixes begin at the full depth and are shortened, tree after tree, until the recall that is
measured on true pairs reaches the target: on the exact neighbours of sampled texts, and on
probes at the threshold made from them. Classes that share a prefix in some tree are candidates; their
whole signatures part chance meetings from likely pairs, which connect candidates into groups,
and within a group every pair is verified on its whole shingle sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import connected_components, forget, free_name, materialize
from rosterline.llm.groups import blocked, connected, in_units, link_units, sizes_of

WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Members of a prefix's class, and of a group to verify, that meet in one unit of work.
BUCKET_BLOCK, VERIFY_BLOCK = 2048, 512
#: Up to so many ids (24 bytes each) are broadcast, so that the texts of the others aren't shuffled; more are joined.
BROADCAST_IDS = 2_000_000
#: Bounds of the sample that measures recall: texts, their characters, neighbours of a text, probes of a text.
SAMPLE, SAMPLE_CHARS, NEIGHBOURS, PROBES = 512, 50_000, 8, 2
#: A pair connects two candidates if its signatures agree in at least threshold - SLACK of their bytes. At the threshold
#: 256 minima agree in fewer with a chance under 1e-8 (binomial tail at 0.65 for 0.8).
SLACK = 0.15


class Shingler:
    """Shingle sets of texts; hashes of frequent words are kept, up to a bounded number."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def words(self, text: str | None) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known = {}
        known, found = self.known, WORD.findall((text or "").lower())
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingles; empty for a text without words."""
        words = self.words(text)
        n = min(self.n, len(words))
        if not n:
            return words
        rolled = np.full(len(words) - n + 1, np.uint64(n))
        for k in range(n):
            rolled = (rolled ^ (rolled >> np.uint64(32))) * _FACTOR + words[k : k + len(rolled)]
        return np.unique((rolled ^ (rolled >> np.uint64(29))) * _FACTOR)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, (a[:, None] * low[None, at : at + 256] + b[:, None]).min(axis=1), out=least)
    return least


def label(minima: np.ndarray) -> np.ndarray:
    return (minima & np.uint32(255)).astype(np.uint8)


@dataclass
class Forest:
    """Prefix lengths of the trees, and the recall that they have on the pairs that were measured."""

    threshold: float
    n: int
    depth: int
    prefixes: list[int]
    pairs: int = 0
    pair_recall: float = 1.0
    probes: int = 0
    probe_recall: float = 1.0


def at_least(hits: int, of: int, z: float = 1.64) -> float:
    """The lower 95 % bound of a share (Wilson)."""
    if not of:
        return 1.0
    p = hits / of
    return (p + z * z / (2 * of) - z * np.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def shortened(prefixes: list[int], matched: list[np.ndarray], target: float) -> list[int]:
    """Shorten prefixes, one tree after another, until each kind of pairs has the target recall.

    matched: per kind the lengths of the common prefixes, a row per pair and a column per tree.
    The lower 95 % bound counts, or all pairs where they are too few for that to reach the target.
    """
    prefixes, turn = list(prefixes), 0

    def reached(common: np.ndarray) -> bool:
        hits = int((common >= np.array(prefixes)).any(axis=1).sum())
        return hits == len(common) or at_least(hits, len(common)) >= target

    while max(prefixes) > 1 and not all(reached(m) for m in matched):
        tree = max(range(len(prefixes)), key=lambda t: (prefixes[t], -t))
        prefixes[tree] -= 1
        turn += 1
    return prefixes


def common_prefix(a: np.ndarray, b: np.ndarray, trees: int) -> np.ndarray:
    """How many minima the labels of two signatures share from their start, in each tree."""
    return np.logical_and.accumulate((a == b).reshape(*a.shape[:-1], trees, -1), axis=-1).sum(axis=-1)


class Queries:
    """Shingle sets of sampled texts, looked up by shingle."""

    def __init__(self, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.shingles >> np.uint64(44)] = True
        self.labels = np.stack([label(signature(x, a, b)) for x in sets]) if sets else np.zeros((0, len(a)), np.uint8)

    def near(self, shingles: np.ndarray, threshold: float) -> np.ndarray:
        """The queries that have at least the threshold in common with a set, and aren't equal to it."""
        some = shingles[self.filter[shingles >> np.uint64(44)]]
        if not len(some):
            return some
        first, last = (np.searchsorted(self.shingles, some, side) for side in ("left", "right"))
        count = last - first
        owners = self.owner[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        both = np.bincount(owners, minlength=len(self.sizes))
        either = len(shingles) + self.sizes - both
        return np.flatnonzero((both >= threshold * either - 1e-9) & (both < either))


def sampled_sets(docs: DataFrame, n: int) -> list[np.ndarray]:
    """Distinct shingle sets of at most SAMPLE texts of bounded length, chosen by hash."""
    rows = docs.filter(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    share = min(1.0, 1.3 * SAMPLE / max(1, docs.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(SAMPLE)
    shingler = Shingler(n)
    sets = {x.tobytes(): x for x in (shingler.sets(r.text) for r in chosen.collect()) if len(x)}
    return list(sets.values())


def probes(sets: list[np.ndarray], threshold: float, a: np.ndarray, b: np.ndarray, labels: np.ndarray, trees: int) -> np.ndarray:
    """Common prefixes of sets with copies of themselves of which as many shingles are replaced as the threshold allows."""
    rng, found = np.random.default_rng(11), []
    for own, mine in zip(sets, labels, strict=True):
        gone = int(len(own) * (1 - threshold) / (1 + threshold))
        for _ in range(PROBES if gone else 0):
            kept = np.delete(own, rng.choice(len(own), gone, replace=False))
            fresh = rng.integers(0, 1 << 64, gone, np.uint64)
            found.append(common_prefix(label(signature(np.concatenate([kept, fresh]), a, b)), mine, trees))
    return np.array(found).reshape(-1, trees)


def signed(docs: DataFrame, n: int, trees: int, depth: int, threshold: float, queries: Queries) -> DataFrame:
    """doc_id, key (of the shingle set, null without words), labels (of all trees), hits (queries near it, with common prefixes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (a, b) = Shingler(n), multipliers(trees * depth)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                keys, labels, hits = [], [], []
                for text in batch.column("text").to_pylist():
                    shingles = shingler.sets(text)
                    if not len(shingles):
                        keys.append(None), labels.append(None), hits.append(None)
                        continue
                    own = label(signature(shingles, a, b))
                    near = queries.near(shingles, threshold)
                    common = common_prefix(queries.labels[near], own, trees).astype(np.uint8) if len(near) else []
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    labels.append(own.tobytes())
                    hits.append([{"q": int(q), "common": c.tobytes()} for q, c in zip(near, common, strict=True)] or None)
                struct = pa.list_(pa.struct([("q", pa.int32()), ("common", pa.binary())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(labels, pa.binary()), pa.array(hits, struct)], names=["doc_id", "key", "labels", "hits"]
                )

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, key binary, labels binary, hits array<struct<q:int,common:binary>>")


def fitted(base: DataFrame, sets: list[np.ndarray], queries: Queries, threshold: float, n: int, trees: int, depth: int, target: float) -> Forest:
    """Prefix lengths that reach the target on the neighbours that signed() found and on probes."""
    seen = base.filter("hits is not null").select("key", F.explode("hits").alias("h")).select("h.q", "h.common", F.xxhash64("key").alias("o")).distinct()
    some = Window.partitionBy("q").orderBy("o", "common")
    rows = seen.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= NEIGHBOURS).select("common").collect()  # SAMPLE * NEIGHBOURS at most
    real = np.array([list(r.common) for r in rows], np.int64).reshape(-1, trees)
    made = probes(sets, threshold, *multipliers(trees * depth), queries.labels, trees)
    prefixes = shortened([depth] * trees, [real, made], target)
    found = [float((m >= np.array(prefixes)).any(axis=1).mean()) if len(m) else 1.0 for m in (real, made)]
    return Forest(threshold, n, depth, prefixes, len(real), found[0], len(made), found[1])


def crowded_nodes(reps: DataFrame, forest: Forest) -> DataFrame:
    """(node, id) of the nodes at which a tree's prefixes end, for all that may have two members of reps(id, labels).

    A tree's number and label make one sortable value. Runs of equal prefixes are read off the
    sorted rows of a range; single rows inside a range go, the first and last run of a range
    stay since the neighbouring range may go on with them. Equal labels are ordered by id, so a hot label spreads
    over ranges.
    """
    trees, depth, prefixes = len(forest.prefixes), forest.depth, np.array(forest.prefixes)
    placed = F.array(*(F.concat(F.lit(bytes([t])), F.substring("labels", t * depth + 1, depth)) for t in range(trees)))
    rows = reps.select("id", F.explode(placed).alias("label")).repartitionByRange("label", "id").sortWithinPartitions("label")
    cover = (np.arange(depth) < prefixes[:, None]).astype(np.uint8)
    powers = np.array([pow(int(_FACTOR), k, 1 << 64) for k in range(1, depth + 2)], np.uint64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_node, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            labels = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, depth + 1)
            shown = np.concatenate([labels[:, :1] + 1, (labels[:, 1:] + np.uint16(1)) * cover[labels[:, 0]]], axis=1).astype(np.uint64)
            node = (shown * powers).sum(axis=1, dtype=np.uint64)
            node = ((node ^ (node >> np.uint64(31))) * _FACTOR).view(np.int64)
            if last_id is not None:
                ids, node = np.append(last_id, ids), np.append(last_node, node)
            same = node[1:] == node[:-1]
            keep = np.append(False, same) | np.append(same, False)
            if first:
                keep[0] = True
            elif last_kept:
                keep[0] = False  # it has gone out already
            last_kept, first = bool(keep[-1]), False
            last_id, last_node = ids[-1], node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(ids[keep])], names=["node", "id"])
        if last_id is not None and not last_kept:
            yield pa.RecordBatch.from_arrays([pa.array([last_node], pa.int64()), pa.array([last_id], pa.int64())], names=["node", "id"])

    return rows.mapInArrow(runs, "node long, id long")


def connect_units(share: float):  # noqa: ANN201
    """Work for in_units(): connects members whose labels agree in at least the given share of their bytes."""

    def work(key: tuple, held: list) -> Iterator[tuple]:
        rows = np.stack([h[2] for h in held])
        root = connected(lambda k, others: (rows[others] == rows[k]).mean(axis=1) >= share, len(held))
        for k, r in enumerate(root):
            if r != k:
                yield held[k][1], 0, held[r][1]

    return work


class JaccardLinks:
    """Which of some shingle sets have at least the threshold in common."""

    def __init__(self, threshold: float, sets: list[np.ndarray]) -> None:
        self.threshold, self.size = threshold, np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.size) - self.size
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)

    def row(self, k: int) -> np.ndarray:
        own = self.flat[self.starts[k] : self.starts[k] + self.size[k]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.flat], self.starts)
        self.mark[own] = 0
        return both >= self.threshold * (self.size[k] + self.size - both) - 1e-9


def jaccard_links(threshold: float):  # noqa: ANN201
    return lambda sets: np.stack([x.row(k) for x in [JaccardLinks(threshold, sets)] for k in range(len(sets))])


def jaccard_classes(threshold: float):  # noqa: ANN201
    """Work for in_units() that connects the members of a unit and counts nothing: who is reached isn't compared again."""

    def work(key: tuple, held: list) -> Iterator[tuple]:
        if key[-2] != key[-1] and len({h[0] for h in held}) == 1:
            return
        links = JaccardLinks(threshold, [h[3] for h in held])
        for k, r in enumerate(connected(lambda k, others: links.row(k)[others], len(held))):
            if r != k:
                yield held[k][1], 0, held[r][1]

    return work


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 32, depth: int = 8, target: float = 0.995, counted: bool = True, report: list[Forest] | None = None
) -> DataFrame:
    """doc_id, class_id, n_links of every document of docs(doc_id, text).

    class_id is the smallest doc_id that links reach, n_links the number of other
    documents whose shingle sets have at least the threshold in common with this one's (null if
    not counted). Equal shingle sets (exact copies above all) are linked and are expanded nowhere. A null
    text, or one without words, has no links. Rows with a null doc_id have none either and
    a null class_id; rows that share a doc_id are one node. doc_id must be a whole number. Other
    columns are not looked at; an empty table gives an empty one. report gets the fitted forest.
    The result is a written table, the only one that stays.
    """
    sets = sampled_sets(docs, n)
    queries = Queries(sets, *multipliers(trees * depth))
    base = materialize(signed(docs, n, trees, depth, threshold, queries))
    forest = fitted(base, sets, queries, threshold, n, trees, depth, target)
    if report is not None:
        report.append(forest)
    usable = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    # labels follow from the key; as a part of it they need no aggregate of their own
    reps = materialize(base.filter(usable).groupBy("key", "labels").agg(F.min("doc_id").cast("long").alias("id"), F.count("*").alias("w")))

    crowded = materialize(crowded_nodes(reps, forest))
    marks = [F.count("*").alias("size"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")]
    members = crowded.groupBy("node").agg(*marks).filter("size > 1")
    nodes = materialize(members.groupBy("size", "s", "x").agg(F.min("node").alias("_node")).select("_node"))  # of nodes with the same members one
    met = crowded.join(nodes, F.col("node") == F.col("_node")).select("node", "id")
    met = materialize(met.join(reps.select("id", "labels"), "id"))
    node_sizes = materialize(sizes_of(met, "node", BUCKET_BLOCK))
    agree = threshold - SLACK
    likely = in_units(blocked(met, "node", "id", node_sizes), ["_group", "_i", "_j"], ["id"], "labels", connect_units(agree + (1 - agree) / 256))
    groups = connected_components(likely.select(F.col("id").alias("a"), F.col("other").alias("b")))
    forget(crowded, nodes, met, node_sizes)

    shingle_sets = materialize(_sets(docs, base, reps, groups, n))
    group_sizes = materialize(sizes_of(shingle_sets, "component", VERIFY_BLOCK, F.size("shingles")))
    units = blocked(shingle_sets, "component", "id", group_sizes)
    work = link_units(jaccard_links(threshold)) if counted else jaccard_classes(threshold)
    found = materialize(in_units(units, ["_group", "_i", "_j"], ["id", "w"], "shingles", work))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = roots.select(F.col("node").alias("_id"), F.col("component").alias("_c"))
    counts = found.groupBy(F.col("id").alias("_k")).agg(F.sum("links").alias("_l"))
    known = reps.select(F.col("key").alias("_key"), "id", "w").join(linked, F.col("id") == F.col("_id"), "left").join(counts, F.col("id") == F.col("_k"), "left")
    links = (F.coalesce("_l", F.lit(0)) + F.col("w") - 1).cast("long") if counted else F.lit(None).cast("long")
    known = known.select("_key", links.alias("_n"), F.coalesce("_c", "id").alias("_c"))
    out = base.select("doc_id", F.when(usable, F.col("key")).alias("key")).join(known, F.col("key") == F.col("_key"), "left")
    none = F.lit(0 if counted else None).cast("long")
    result = materialize(out.select("doc_id", F.coalesce("_c", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("_n", none).alias("n_links")))
    forget(base, reps, groups, shingle_sets, group_sizes, found, roots)
    return result


def _sets(docs: DataFrame, base: DataFrame, reps: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """(component, id, w, shingles) of the candidates: only their texts are shuffled while their ids can be broadcast."""
    chosen = groups.join(reps.select(F.col("id").alias("_id"), "w", F.col("key").alias("_key")), F.col("node") == F.col("_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if groups.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(groups.select(F.col("node").alias("id"))), "id", "left_semi")
    texts = texts.join(chosen.select(F.col("node").alias("id"), "component", "w", "_key"), "id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                sets = [shingler.sets(t) for t in batch.column("text").to_pylist()]
                # rows that share a doc_id may hold other texts; the class's own counts
                own = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() == k for x, k in zip(sets, batch.column("_key").to_pylist(), strict=True)])
                columns = [*(batch.column(c) for c in ("component", "id", "w")), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["component", "id", "w", "shingles"]).filter(own)

    sets = texts.select("component", "id", "w", "_key", "text").mapInArrow(shingled, "component long, id long, w long, shingles array<long>")
    return sets.dropDuplicates(["id"]) if _repeats(base) else sets


def _repeats(rows: DataFrame) -> bool:
    return not rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()


def keep_one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """The documents of the smallest doc_id in their class, with their own columns.

    Of rows that share that doc_id one stays, the one with the least text. Rows with a null
    doc_id stay, as do null and empty texts. Columns may have any names; an empty table gives an empty one.
    """
    found = jaccard_join(docs, counted=False, **options)
    loser = free_name("_loser", docs.columns)
    losers = found.filter("doc_id <> class_id").select(F.col("doc_id").alias(loser)).distinct()
    if losers.count() <= BROADCAST_IDS:
        losers = F.broadcast(losers)
    kept = docs.join(losers, F.col("doc_id") == F.col(loser), "left_anti")
    if not _repeats(found):
        return kept
    columns, row = [c for c in docs.columns if c != "doc_id"], free_name("_row", docs.columns)
    first = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias(row))
    once = first.select("doc_id", *(F.col(row)[c].alias(c) for c in columns)).select(docs.columns)
    return once.unionByName(kept.filter("doc_id is null"))
