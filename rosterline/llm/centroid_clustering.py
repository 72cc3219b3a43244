"""Exact k-means over whole numbers with Elkan's bounds.

Every vector keeps, from one round to the next, an upper bound of its distance to its own centroid and
a lower bound to each of the k centroids. After centroids have moved the bounds are moved along;
a distance is calculated only where they and the distances between centroids can't rule it out.
Bounds are doubles rounded away from the truth (upper ones up, lower ones down) and rule out by
strict comparison only, so a centroid at the same distance is always looked at; distances are
compared as whole numbers, ties go to the smaller number. The result is that of plain k-means.

A round is one pass over a written table of vectors and bounds: it writes the next table and, in the
same files, the k partial sums of each task, of which only k rows a task are read to move the
centroids. The k centroids are all that the driver and the tasks' closures hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import forget, materialize

#: Scaled components beyond this count as this, so that squared distances of up to 256 components fit in 63 bits.
LARGEST = 1 << 26
#: Rows of a batch that are worked on at once.
_ROWS = 4096
#: cluster and the rows of the state are null in rows of partial sums, and the other way round.
_STATE = "id {id}, vector binary, cluster int, bounds binary, distance long, sum_of int, members long, inertia decimal(38,0), sums array<long>, calculated long"


def whole_vectors(rows: DataFrame, id_: str, vector: str, components: int, scale: int) -> DataFrame:
    """(id, vector) of the rows whose vector has that many components, none null or non-finite; floor(scale * x) as longs.

    Null vectors and those of other lengths go. Rows of one id stay rows of their own. A component
    beyond LARGEST after scaling counts as LARGEST (or -LARGEST).
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    cut = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")
    held = rows.select(F.col(id_).alias("id"), F.col(vector).alias("_v")).filter((F.size("_v") == components) & ~F.exists("_v", lambda x: bad(x.cast("double"))))
    clear = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))  # noqa: E731  before scaling: no overflow
    return held.select("id", F.transform("_v", lambda x: cut(clear(x))).alias("vector"))


def first_by_hash(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of (id, vector) with the least hex SHA-256 of "seed:id", in that order; fewer where there are fewer. Equal ids go by their vectors; null ids come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "vector").limit(k).collect()  # k rows
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def _squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = rows - centroid
    return np.einsum("ij,ij->i", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    """At least the exact value of what x was rounded from: two steps up cover a root and a sum."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0.0)


def first_assignment(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances calculated): everything is calculated once."""
    squares = np.stack([_squared(x, c) for c in centroids], axis=1)
    cluster = squares.argmin(axis=1)  # the first of equals
    roots = np.sqrt(squares.astype(np.float64))
    return cluster, _up(roots[np.arange(len(x)), cluster]), _down(roots), squares.size


def next_assignment(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved from `before`; bounds are those that held before the move."""
    k = len(centroids)
    moved = np.array([_squared(b[None], c)[0] for b, c in zip(before, centroids, strict=True)], dtype=np.float64)
    drift = np.where(moved > 0, _up(np.sqrt(moved)), 0.0)
    upper, lower = np.where(drift[cluster] > 0, _up(upper + drift[cluster]), upper), np.where(drift > 0, _down(lower - drift), lower)
    between = np.sqrt(np.stack([_squared(centroids, c) for c in centroids], axis=1).astype(np.float64))
    half = np.nextafter(_down(between) / 2, 0)
    np.fill_diagonal(half, np.inf)
    cluster, best = cluster.copy(), np.full(len(x), -1, np.int64)  # best: own squared distance, once it is known
    open_ = np.flatnonzero(~(upper < half.min(axis=1)[cluster])) if k > 1 else np.empty(0, np.int64)
    calculated = 0
    for j in range(k):
        if not len(open_):
            break
        left = lambda rows: rows[(cluster[rows] != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < half[cluster[rows], j])]  # noqa: B023, E731
        rows = left(open_)
        loose = rows[best[rows] < 0]
        if len(loose):
            d = np.einsum("ij,ij->i", x[loose] - centroids[cluster[loose]], x[loose] - centroids[cluster[loose]])
            root = np.sqrt(d.astype(np.float64))
            best[loose], upper[loose], lower[loose, cluster[loose]] = d, _up(root), _down(root)
            calculated += len(loose)
            rows = left(rows)
        if len(rows):
            d = _squared(x[rows], centroids[j])
            calculated += len(rows)
            root = np.sqrt(d.astype(np.float64))
            lower[rows, j] = _down(root)
            wins = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            won = rows[wins]
            cluster[won], best[won], upper[won] = j, d[wins], _up(root[wins])
    return cluster, upper, lower, calculated


def _round(table: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """One pass: the new state with the partial sums of each task behind it. before: None in the first round."""
    kind = table.schema["id"].dataType.simpleString()
    schema, (k, dims) = _STATE.format(id=kind), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members, inertia, calculated = np.zeros((k, dims), object), np.zeros(k, object), np.zeros(k, object), 0
        kinds = None
        for big in batches:
            kinds = big.schema.field("id").type
            for at in range(0, big.num_rows, _ROWS):
                batch = big.slice(at, _ROWS)
                n = batch.num_rows
                if before is None:
                    x = batch.column("vector").flatten().to_numpy().astype("<i8").reshape(n, dims)
                    packed = pa.array([v.tobytes() for v in x], pa.binary())
                    cluster, upper, lower, count = first_assignment(x, centroids)
                else:
                    packed = batch.column("vector")
                    x = np.frombuffer(b"".join(packed.to_pylist()), "<i8").reshape(n, dims)
                    held = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), "<f8").reshape(n, k + 1)
                    cluster, upper, lower, count = next_assignment(x, batch.column("cluster").to_numpy().astype(np.int64), held[:, 0], held[:, 1:], before, centroids)
                calculated += count
                distance = None
                if last:
                    d = x - centroids[cluster]
                    distance = np.einsum("ij,ij->i", d, d)
                for j in range(k):
                    own = cluster == j
                    members[j] += int(own.sum())
                    # Sums of a batch fit: _ROWS * LARGEST and, for squares, halves that are added apart.
                    sums[j] += x[own].sum(axis=0).astype(object)
                    if last:
                        own_d = distance[own]
                        inertia[j] += (int((own_d >> 31).sum()) << 31) + int((own_d & 0x7FFFFFFF).sum())
                blank = lambda t: pa.nulls(n, t)  # noqa: B023, E731
                bounds = np.column_stack([upper, lower]).astype("<f8")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), blank(pa.binary()) if last else packed, pa.array(cluster, pa.int32()),
                        blank(pa.binary()) if last else pa.array([b.tobytes() for b in bounds], pa.binary()), pa.array(distance, pa.int64()) if last else blank(pa.int64()),
                        blank(pa.int32()), blank(pa.int64()), blank(pa.decimal128(38, 0)), blank(pa.list_(pa.int64())), blank(pa.int64()),
                    ], names=names,
                )
        if kinds is not None:
            blank = lambda t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [
                    blank(kinds), blank(pa.binary()), blank(pa.int32()), blank(pa.binary()), blank(pa.int64()), pa.array(range(k), pa.int32()), pa.array([int(m) for m in members], pa.int64()),
                    pa.array([Decimal(int(v)) for v in inertia], pa.decimal128(38, 0)), pa.array([[int(v) for v in row] for row in sums], pa.list_(pa.int64())), pa.array([calculated] + [0] * (k - 1), pa.int64()),
                ], names=names,
            )

    names = [part.split()[0] for part in schema.replace("decimal(38,0)", "decimal").split(", ")]
    return table.mapInArrow(run, schema)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at floor(sum / count) of their members; those without members stay. Reads k rows of each task."""
    k, dims = centroids.shape
    parts = state.filter("sum_of is not null")
    total = parts.groupBy("sum_of").agg(F.sum("members").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k rows
        if r["n"]:
            out[r["sum_of"]] = [int(v) // int(r["n"]) for v in r["s"]]
    return out


def elkan_kmeans(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(table of id, cluster, distance, cluster_inertia, inertia; final centroids; distances calculated in each pass) of (id, vector of longs).

    `rounds` times every vector goes to its nearest centroid (squared Euclidean, ties to the smaller number) and centroids move to the
    componentwise floor of their members' mean; then vectors are assigned once more. Vectors have as many
    components as centroids, at most 256 and within LARGEST. Null and repeated ids are rows like others. A sum
    of distances that no long holds is null. Without vectors or centroids the table is empty. The
    result reads one written table, the others are deleted.
    """
    as_long = lambda c: c.try_cast("long")
    if not len(centroids):
        empty = vectors.limit(0).select("id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")])
        return empty, centroids, []
    state, before, work = vectors.select("id", "vector"), None, []
    for n in range(rounds + 1):
        held = state.filter("sum_of is null") if n else state
        after = materialize(_round(held, centroids, before, last=n == rounds))
        if n:
            forget(state)
        state = after
        work.append(int(state.agg(F.sum("calculated")).first()[0] or 0))
        if n < rounds:
            before, centroids = centroids, _moved(state, centroids)
    sums = state.filter("sum_of is not null").groupBy(F.col("sum_of").alias("cluster")).agg(F.sum("inertia").alias("_own"))
    whole = state.filter("sum_of is not null").agg(F.sum("inertia")).first()[0]
    out = state.filter("sum_of is null").select("id", "cluster", "distance").join(F.broadcast(sums), "cluster")  # k rows
    total = F.lit(int(whole) if whole is not None and int(whole) < 2**63 else None).cast("long")
    return out.select("id", "cluster", "distance", as_long(F.col("_own")).alias("cluster_inertia"), total.alias("inertia")), centroids, work


def digest(centroid: np.ndarray) -> str:
    """Hex SHA-256 of the components as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain k-means over embeddings(vec_id, embedding) as SQL: a pair of tables for every round."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM "
        f"(SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, x, b.d AS distance, b.c AS cluster FROM (SELECT vec_id, any_value(v.x) AS x, "
            f"min({{'d': CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.cluster}}) AS b FROM v, c{n} AS c GROUP BY vec_id))"
        )
        if n < rounds:
            parts.append(
                f"s{n} AS MATERIALIZED (SELECT cluster, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS m FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, {dims + 1})) AS i FROM a{n}) GROUP BY cluster, i)"
            )
            floor = "(s - ((s % m) + m) % m) // m"
            parts.append(f"m{n} AS MATERIALIZED (SELECT cluster, list({floor} ORDER BY i) AS x FROM s{n} GROUP BY cluster)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m USING (cluster))")
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} AS c USING (cluster)"
    )
