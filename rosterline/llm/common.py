"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders of the tables that materialize() wrote and forget() has not deleted.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rosterline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/rosterline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        names = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}
        for path in [p for p in WRITTEN if p.rsplit("/", 1)[1] in names]:
            _delete(df.sparkSession, path)
            WRITTEN.remove(path)


def forget_unread(docs: DataFrame, among: list[str]) -> None:
    """Delete those of the written tables `among` (of WRITTEN) that docs doesn't read."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()}
    for path in [p for p in among if p in WRITTEN and p.rsplit("/", 1)[1] not in read]:
        _delete(docs.sparkSession, path)
        WRITTEN.remove(path)


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def salted_rank(df: DataFrame, group: str, order: list[str], buckets: int, name: str) -> DataFrame:
    """Add a gapless rank from 0 within each group, without bringing a group into one task.

    Rows of a group are dealt over hash buckets and numbered there; a bucket starts where
    the buckets before it end. Only (group, bucket) counts meet in one place. df is read
    twice, so it should be a table or cheap. Full ties get different ranks in any order.
    df must not have a column called name; its other names are free.
    """
    b, i, g, gb, n, start = (free_name(x, df.columns) for x in ("_b", "_i", "_g", "_gb", "_n", "_start"))
    salted = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    ends = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(group, b).agg(F.count("*").alias(n)).select(
        F.col(group).alias(g), F.col(b).alias(gb), F.coalesce(F.sum(n).over(ends), F.lit(0)).alias(start)
    )
    inside = Window.partitionBy(group, b).orderBy(*order)
    return (
        salted.withColumn(i, F.row_number().over(inside))
        .join(starts, F.col(group).eqNullSafe(F.col(g)) & (F.col(b) == F.col(gb)))
        .withColumn(name, F.col(start) + F.col(i) - 1)
        .drop(b, i, g, gb, start)
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): the component's smallest node.

    In each round every node proposes the least label among its neighbours to itself and to
    the node that its own label names, then takes the label of its label; so the rounds grow with
    the logarithm of the diameter. They end when no label falls any more. Labels and edges are
    written tables: a lost executor costs at most one round, and a hot node's join is one of
    two plain exchanges, which adaptive execution splits; minima are aggregated partially. The
    table of labels remains until the caller forgets it. Null ends and loops are left out.
    """
    ends = edges.select("a", "b").filter("a <> b")
    both = materialize(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    total = None
    while True:
        theirs = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        least = both.join(theirs, F.col("b") == F.col("_n")).groupBy(F.col("a").alias("_a")).agg(F.min("_c").alias("_m"))
        met = labels.join(least, F.col("node") == F.col("_a"))
        own = met.select("node", F.least("component", "_m").alias("component"))
        above = met.filter("_m < component").select(F.col("component").alias("node"), F.col("_m").alias("component"))
        hooked = materialize(own.union(above).groupBy("node").agg(F.min("component").alias("component")))
        jump = hooked.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        after = materialize(hooked.join(jump, F.col("component") == F.col("_n")).select("node", F.col("_c").alias("component")))
        now = after.agg(F.sum(F.col("component").cast("decimal(20,0)"))).first()[0]  # labels only ever fall
        forget(labels, hooked)
        labels = after
        if now == total:
            forget(both)
            return labels
        total = now
