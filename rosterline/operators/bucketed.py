"""Tables in buckets of their key, so that a write rewrites only the buckets that it touches.

A bucket is a folder. A change first finds the buckets that its keys (or its condition) touch, changes their rows with the functions of
writes.py, and replaces just those folders; files of the others keep their names. A bucket of many rows is written by several
tasks, a file each, so tasks don't grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterline.operators.ranked import shared_path
from rosterline.operators.writes import upserted

BUCKET = "_bucket"
#: Rows that a task writes, about.
ROWS = 250_000


class BucketedTable:
    """A table below a path with `buckets` folders by the hash of its keys. One writer at a time.

    A bucket's new rows are written whole beside the table first, then the folder is moved to the place of the old one; a job that fails before
    leaves the table as it was. With several buckets a reader may see some of them changed before the others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    @property
    def stored(self) -> DataFrame:
        """The rows now, with the bucket of each."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)

    @property
    def rows(self) -> DataFrame:
        return self.stored.drop(BUCKET)

    def bucket(self) -> Column:
        """The bucket of a row; null keys have one too."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # as many as buckets

    def _replace(self, touched: list[int], change: Callable[[DataFrame], DataFrame], more: int = 0) -> None:
        """Those buckets as change() makes them of their rows, adding `more` at most; one that has no rows afterwards is emptied."""
        if not touched:
            return
        old = self.stored.filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        staged = shared_path(self.spark, "staged")
        self._write(change(old).select(*self.schema.names), staged, old.count() + more)
        files, path = self._files(staged)
        for b in touched:
            now, new = path(f"{self.path}/{BUCKET}={b}"), path(f"{staged}/{BUCKET}={b}")
            if files.exists(now):
                self._move(files, now, path(f"{staged}/old-{b}"))
            if files.exists(new):
                self._move(files, new, now)
        files.delete(path(staged), True)

    def _files(self, path: str) -> tuple:
        """The file system of a path, and what makes paths for it."""
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        return made(path).getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    @staticmethod
    def _move(files: object, old: object, new: object) -> None:
        if not files.rename(old, new):
            raise OSError(f"{old.toString()} can't be moved to {new.toString()}")

    def _write(self, rows: DataFrame, path: str, n: int) -> None:
        """rows, about n, by bucket; a bucket is dealt to as many tasks as it needs for ROWS in each, by other bits of its keys' hash."""
        shares = max(1, -(-n // (ROWS * self.buckets)))
        share = F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(shares))
        task = (self.bucket() * F.lit(shares) + share).cast("int")
        rows.withColumn(BUCKET, self.bucket()).repartitionById(self.buckets * shares, task).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)

    def upsert(self, source: DataFrame) -> DataFrame:
        """K1: as writes.upserted() with this table's keys; returns the number of rows by change, in the touched buckets."""
        counted = self.spark.createDataFrame([], "change string, n long")
        touched = self._touched(source.withColumn(BUCKET, self.bucket()))
        if touched:
            # Whether a row is new is asked before the write; an empty table has no folders to be read.
            was = self.stored.filter(F.col(BUCKET).isin(touched)).select(*(F.col(k).alias(f"_t{k}") for k in self.keys), F.lit(True).alias("_held"))
            on = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in self.keys]
            change = F.when(F.col("_held"), "updated").otherwise("new")
            found = source.select(*self.keys).join(was, on, "left").groupBy(change.alias("change")).agg(F.count("*").alias("n")).collect()  # two rows
            counted = self.spark.createDataFrame([tuple(r) for r in found], counted.schema)
            self._replace(touched, lambda old: upserted(old, source, self.keys), sum(r["n"] for r in found))
        return counted

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Sets columns where a condition holds; returns how many rows it held for. Keys can't be set."""
        if set(values) & set(self.keys):
            raise ValueError("keys can't be set")
        hit = self.stored.filter(where).groupBy(BUCKET).agg(F.count("*").alias("n")).collect()  # a row per bucket
        holds = F.coalesce(where, F.lit(False))
        kinds = {f.name: f.dataType for f in self.schema}
        self._replace([r[BUCKET] for r in hit], lambda old: old.select(*(F.when(holds, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns)))
        return sum(r["n"] for r in hit)

    def delete(self, where: Column) -> int:
        """Deletes rows where a condition holds; returns how many."""
        hit = self.stored.filter(where).groupBy(BUCKET).agg(F.count("*").alias("n")).collect()  # a row per bucket
        self._replace([r[BUCKET] for r in hit], lambda old: old.filter(~F.coalesce(where, F.lit(False))))
        return sum(r["n"] for r in hit)

    def insert_if_absent(self, source: DataFrame) -> int:
        """K7, K9: rows of source whose keys aren't there; of rows with equal keys in source one is taken, any. Returns how many."""
        once = source.dropDuplicates(self.keys).select(*self.schema.names)
        at = once.withColumn(BUCKET, self.bucket())
        held = self.stored.select(BUCKET, *self.keys).withColumnsRenamed({k: f"_t{k}" for k in self.keys}).withColumnRenamed(BUCKET, "_tb")
        on = [F.col(BUCKET) == F.col("_tb"), *(F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in self.keys)]
        staged = shared_path(self.spark, "staged")
        self._write(at.join(held, on, "left_anti").drop(BUCKET), staged, source.count())
        n = self.spark.read.schema(self.stored.schema).parquet(staged).count()
        files, path = self._files(staged)
        for folder in files.listStatus(path(staged)):
            bucket = folder.getPath().getName()
            if bucket.startswith(f"{BUCKET}="):
                files.mkdirs(path(f"{self.path}/{bucket}"))
                for file in files.listStatus(folder.getPath()):  # names are unique over all writes
                    self._move(files, file.getPath(), path(f"{self.path}/{bucket}/{file.getPath().getName()}"))
        files.delete(path(staged), True)
        return n


def write_bucketed(rows: DataFrame, keys: list[str], path: str, buckets: int) -> BucketedTable:
    """rows below path, in buckets by their keys, which must be unique. A column called _bucket is refused."""
    if BUCKET in {c.lower() for c in rows.columns}:
        raise ValueError(f"{BUCKET} is needed for buckets")
    table = BucketedTable(rows.sparkSession, path, rows.schema, keys, buckets)
    table._write(rows, path, rows.count())
    return table
