"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of the vectors, make a grid of cells. A vector lies in the
cell of its nearest codes and visits further cells in the order of a lower bound: its squared
distances to the two regions, added. Visits end at a bound that is measured: for each of many
sampled vectors, compared with all others, the target share of its true pairs lies below it.
Where too few of them have pairs, visits go on to the greatest bound that a pair can have,
and none is lost. What meets in a cell is compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import connected_components, forget, materialize
from rosterline.llm.groups import blocked, in_units, link_units, sizes_of

#: Vectors from which codebooks are made, and queries that measure recall against all vectors.
SAMPLE, QUERIES = 20_000, 400
#: Queries of different neighbourhoods that are asked first, and how many of them must have pairs.
SPREAD, ENOUGH = 2_000, 100
#: Members or visitors of a cell that meet in one unit of work.
BLOCK = 512
_VISIT = 1 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a power of two takes each row's largest component near 1 first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    power = np.frexp(np.abs(rows).max(axis=1, initial=0))[1]
    half = -power // 2  # in two steps: the power itself may not be a double
    rows = np.ldexp(np.ldexp(rows, half[:, None]), (-power - half)[:, None])
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from evenly spaced points."""
    centres = points[np.linspace(0, len(points) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        for k in range(codes):
            if (at := own == k).any():
                centres[k] = points[at].mean(0)
    return centres


def bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's own code, and its squared distance at least to every code's region."""
    d = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(-1), 1e-12))
    low = np.maximum(0, d - d.min(1)[:, None]) / (2 * apart[own])
    low[np.arange(len(points)), own] = 0
    return own, low**2


class Grid:
    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.half = sample.shape[1] // 2
        self.codes = min(codes, len(sample))
        self.books = [codebook(part, self.codes) for part in self.split(sample)]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, : self.half], rows[:, self.half :]]

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, and the bounds to the codes of either half."""
        (a, low_a), (b, low_b) = (bounds(x, c) for x, c in zip(self.split(rows), self.books, strict=True))
        return a * self.codes + b, low_a, low_b


def visits(own: int, low_a: np.ndarray, low_b: np.ndarray, most: float) -> np.ndarray:
    """Cells after own with a bound of at most most, nearest first: the multi-sequence order of two sorted lists."""
    ia, ib = np.argsort(low_a, kind="stable"), np.argsort(low_b, kind="stable")
    ia, sb = ia[: np.searchsorted(low_a[ia], most, side="right")], low_b[ib]
    reach = np.searchsorted(sb, most - low_a[ia], side="right")
    a = np.repeat(ia, reach)
    b = ib[np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach)]
    cells = (a * len(low_b) + b)[np.argsort(low_a[a] + low_b[b], kind="stable")]
    return cells[cells > own]


def apart(rows: np.ndarray, least: float, step: int = 1024) -> np.ndarray:
    """For each row whether no earlier such row is within least cosine, so that a hot cluster has one voice."""
    kept = np.zeros(len(rows), bool)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        free = np.ones(len(part), bool)
        earlier = rows[:at][kept[:at]]
        for k in range(0, len(earlier), step):
            free &= (part @ earlier[k : k + step].T < least).all(axis=1)
        near = part @ part.T >= least
        for k in range(len(part)):
            if free[k]:
                free[k + 1 :] &= ~near[k, k + 1 :]
        kept[at : at + step] = free
    return kept


def pair_bounds(vectors: DataFrame, grid: Grid, queries: np.ndarray, ids: np.ndarray, least: float, target: float) -> dict[int, float]:
    """For each of the queries with pairs the bound below which the target share of them lies.

    The queries are compared with every other of vectors(id, v); each task returns a histogram
    for each query.
    """
    limit, bins, step = 2 - 2 * least, 400, max(64, (1 << 21) // max(1, len(queries)))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries) * bins, np.int64)
        for batch in batches:
            rows = unit(np.stack([x.values.to_numpy() for x in batch.column("v")])) if batch.num_rows else np.zeros((0, queries.shape[1]))
            names = batch.column("id").to_numpy(zero_copy_only=False)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                q, r = np.nonzero(queries @ part.T >= least)
                others = ids[q] != names[at : at + step][r]
                q, r = q[others], r[others]
                if not len(q):
                    continue
                asked, q_at = np.unique(q, return_inverse=True)
                found, r_at = np.unique(r, return_inverse=True)
                q_own, q_a, q_b = grid.bounds(queries[asked])
                r_own, r_a, r_b = grid.bounds(part[found])
                here, there, c = q_own[q_at], r_own[r_at], grid.codes
                low = np.where(here < there, q_a[q_at, there // c] + q_b[q_at, there % c], r_a[r_at, here // c] + r_b[r_at, here % c])  # the one in the lower cell visits
                low[here == there] = 0
                total += np.bincount(q * bins + np.minimum(low / limit * bins, bins - 1).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"q": pa.array(at // bins, pa.int32()), "bin": pa.array(at % bins, pa.int32()), "n": pa.array(total[at])})

    counts = vectors.select("id", "v").mapInArrow(histogram, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas().sort_values(["q", "bin"])
    most = {}
    for q, own in counts.groupby("q"):
        share = own["n"].to_numpy().cumsum()
        most[int(q)] = (own["bin"].to_numpy()[np.searchsorted(share, target * share[-1])] + 2) * limit / bins
    return most


def measured_bound(vectors: DataFrame, grid: Grid, sample: np.ndarray, ids: np.ndarray, least: float, target: float) -> float:
    """The bound below which the target share of each query's true pairs lies, with half as much on top.

    Queries are some rows of the sample as they come and others of which no two are near, so
    neither a hot cluster nor sparse pairs set the bound alone. More are asked as long as too
    few of the latter have pairs; if they stay too few, the bound is the greatest one of any pair.
    """
    limit = 2 - 2 * least
    order = np.random.default_rng(0).permutation(len(sample))
    sample, ids = sample[order], ids[order]
    single = apart(sample, least)
    chosen = np.flatnonzero(single | (np.arange(len(sample)) < QUERIES))
    most: list[float] = []
    seen = 0
    for part in (chosen[:SPREAD], chosen[SPREAD:]):
        if len(part) and seen < ENOUGH:
            found = pair_bounds(vectors, grid, sample[part], ids[part], least, target)
            most.extend(found.values())
            seen += int(single[part[list(found)]].sum())
    return limit if seen < ENOUGH else min(limit, max(most) * 1.5)


def near_vectors(vectors: DataFrame, least: float = 0.95, target: float = 0.999, codes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding).

    n_links counts the other rows within least cosine, component_id is the smallest vec_id
    that links reach. Equal vectors are one vector with a weight. Vectors that are null, empty or
    zero, or hold null or non-finite components, have no links, nor have rows with a null
    vec_id; vectors of different lengths never link. Rows that share a vec_id are one node.
    """
    parts = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = finite & F.col("vec_id").isNotNull() & F.exists(parts, lambda x: x != 0)
    base = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("v"))
    key = F.when(F.col("v").isNotNull(), F.concat_ws(".", F.size("v"), F.xxhash64("v"), F.hash("v")))
    base = materialize(base.withColumn("key", key))
    reps = base.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"))
    reps = materialize(reps.withColumn("dim", F.size("v")))
    found = None
    for (dim,) in sorted(reps.select("dim").distinct().collect()):
        own = _links(reps.filter(F.col("dim") == dim), least, target, codes)
        found = own if found is None else found.union(own)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    parts_found, found = found, materialize(found)
    forget(parts_found)
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).join(roots, F.col("id") == F.col("node")).drop("node")
    known = reps.select("key", "id", "w").join(counts, "id", "left").select(
        F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("_n"), F.coalesce("component", "id").alias("_c")
    )
    out = base.join(known, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("_c", "vec_id").alias("component_id")
    out = materialize(out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component))
    forget(base, reps, found, roots)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(reps: DataFrame, least: float, target: float, codes: int | None) -> DataFrame:
    """(id, links, other) of reps(id, w, v), all of one length."""
    n = reps.count()
    chosen = reps.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE).select("id", "v").limit(SAMPLE).toPandas()
    chosen = chosen if len(chosen) else reps.select("id", "v").limit(SAMPLE).toPandas()
    sample = unit(np.stack(list(chosen["v"])))
    grid = Grid(sample, codes or int(np.clip(np.sqrt(n / 50), 2, 1024)))
    most = measured_bound(reps, grid, sample, chosen["id"].to_numpy(), least, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit(np.stack([x.values.to_numpy() for x in batch.column("v")]))
            cells, near = [], []
            for at in range(0, len(rows), 4096):
                own, low_a, low_b = grid.bounds(rows[at : at + 4096])
                cells.append(own)
                # of two cells the lower one's vectors visit the other
                near.extend(visits(c, low_a[k], low_b[k], most) for k, c in enumerate(own))
            columns = [batch.column(c) for c in ("id", "w", "v")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(near, pa.list_(pa.int32()))], names=["id", "w", "v", "cell", "near"]
            )

    kind = reps.schema["v"].dataType.simpleString()
    assigned = materialize(reps.select("id", "w", "v").mapInArrow(assign, f"id long, w long, v {kind}, cell int, near array<int>"))
    sizes = materialize(sizes_of(assigned, "cell", BLOCK))
    inside = blocked(assigned.drop("near"), "cell", "id", sizes).withColumnRenamed("_group", "cell")
    visitors = assigned.select("id", "w", "v", F.explode("near").alias("cell"))
    blocks = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cells = materialize(blocks(assigned, "_m").join(blocks(assigned.select(F.explode("near").alias("cell")), "_v"), "cell"))
    own = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), F.col(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["cell", "_i", "_j", "_own", "id", "w", "v"]
    members = assigned.drop("near").join(cells, "cell").withColumn("_i", own("_m")).withColumn("_j", upto("_v"))
    members = members.withColumn("_j", F.col("_j") + _VISIT).withColumn("_own", F.col("_i"))
    guests = visitors.join(cells, "cell").withColumn("_own", own("_v") + _VISIT).withColumn("_j", F.col("_own")).withColumn("_i", upto("_m"))
    units = inside.select(columns).union(members.select(columns)).union(guests.select(columns))
    alike = lambda values: (lambda x: x @ x.T >= least)(unit(np.stack(values)))
    found = materialize(in_units(units, ["cell", "_i", "_j"], ["id", "w"], "v", link_units(alike)))
    forget(assigned, sizes, cells)
    return found
