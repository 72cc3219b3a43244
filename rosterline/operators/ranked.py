"""Tables written in an order once, so that a page at any depth reads only the ranges that hold it.

The rows are dealt into sorted ranges, one folder each, with their place in the range; beside them stands a table of how many
rows a range has. A page finds its ranges there and reads no other; nothing is cached on executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE, PLACE = "_range", "_place"
#: Pages of a filtered table that begin no further back are a sorted prefix; ranges are counted for those beyond, with the same rows.
SHALLOW = 10_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir; where that is unset, a session in one process gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rosterline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _starts(counts: DataFrame) -> DataFrame:
    """counts(_range, n) with how many rows the ranges before hold; a row per range."""
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))


class RankedTable:
    """A table that write_ranked() has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.ranges = spark.read.parquet(f"{path}/ranges")

    def total(self, among: DataFrame | None = None) -> DataFrame:
        """One row with the total."""
        return self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")) if among is None else among.agg(F.count("*").alias("total"))

    def page(self, page: int, limit: int, among: DataFrame | None = None) -> DataFrame:
        """L1: the rows of a page with `position` (from 1) over the whole; pages before the first are the first.

        among is a filtered form of self.rows. Its first pages are taken in one pass; for the others a pass counts its rows by
        range and a second reads the page's ranges. Without it the stored counts say where the page is, and only its places are read.
        """
        first, last = (max(1, page) - 1) * limit, max(1, page) * limit
        if among is not None and first <= SHALLOW:
            rows = among.orderBy(RANGE, PLACE).offset(first).limit(limit)
            return self._positions(rows, F.lit(first) + F.row_number().over(Window.orderBy(RANGE, PLACE)))  # at most one page
        counts = self.ranges if among is None else among.groupBy(RANGE).agg(F.count("*").alias("n"))
        held = _starts(counts).filter((F.col("_start") < last) & (F.col("_start") + F.col("n") > first)).collect()  # a range gives a row at least: `limit` at most
        starts = {r[RANGE]: r["_start"] for r in held}
        if not starts:
            return self._positions((self.rows if among is None else among).filter(F.lit(False)), F.lit(0))
        start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.col(RANGE)]
        inside = (self.rows if among is None else among).filter(F.col(RANGE).isin(list(starts)))
        if among is None:
            least, most = min(first - s for s in starts.values()), max(last - s for s in starts.values())
            inside = inside.filter(F.col(PLACE).between(least, most - 1))  # reaches the scan
            found = self._positions(inside, start + F.col(PLACE) + 1)
        else:
            found = self._positions(inside, start + F.row_number().over(Window.partitionBy(RANGE).orderBy(PLACE)))
        return found.filter(F.col("position").between(first + 1, last))

    @staticmethod
    def _positions(rows: DataFrame, position: Column) -> DataFrame:
        return rows.withColumn("position", position.cast("long")).drop(RANGE, PLACE)


def write_ranked(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> RankedTable:
    """rows in an order below path, in `ranges` sorted ranges (or spark.sql.shuffle.partitions).

    The order should end with a column that tells rows apart: rows that are equal in it lie in one range, in any order. Nulls
    stand where the order puts them. Columns called _range, _place or position are refused.
    """
    clash = {RANGE, PLACE, "position"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed for places")
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt.select("*", F.spark_partition_id().alias(RANGE), in_range.alias(PLACE)).write.partitionBy(RANGE).parquet(f"{path}/rows")
    # The schema is given: a table without rows has no files that tell it.
    kept = spark.read.schema(dealt.select("*", F.lit(0).alias(RANGE), F.lit(0).cast("long").alias(PLACE)).schema).parquet(f"{path}/rows")
    kept.groupBy(RANGE).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")
    table = RankedTable.__new__(RankedTable)
    table.path, table.rows, table.ranges = path, kept, spark.read.schema("_range int, n long").parquet(f"{path}/ranges")
    return table
