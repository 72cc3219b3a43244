"""Aggregates kept up to date by changes, and results that expire.

Counts and sums take a change by adding what came and taking away what went, so a table's totals follow its writes without
a pass over the table. Each change is a small table of partial sums under its own number; reading adds them up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

N = "_rows"


class MaintainedAggregate:
    """Sums of `measures` and the number of rows by `keys`, below a path; measures are whole numbers or decimals of the rows.

    Doubles are refused: their sums hang on the order of changes. A change that is applied again under its number counts once. One writer at a time.
    """

    def __init__(self, rows: DataFrame, keys: list[str], measures: dict[str, Column], path: str) -> None:
        """rows give the types only; begin with rebuild()."""
        self.spark, self.keys, self.measures, self.path = rows.sparkSession, keys, measures, path
        self.schema: StructType = self._partial(rows, 1).schema
        for f in self.schema:
            if f.name in measures and f.dataType.typeName() in ("double", "float"):
                raise ValueError(f"{f.name} must be a whole number or a decimal")

    def _partial(self, rows: DataFrame, sign: int) -> DataFrame:
        sums = [F.coalesce(F.sum(m * F.lit(sign)), F.lit(0)) for m in self.measures.values()]
        return rows.groupBy(*self.keys).agg(*(s.alias(n) for n, s in zip(self.measures, sums, strict=True)), (F.count("*") * F.lit(sign)).alias(N))

    def _merged(self, partials: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.schema}
        return partials.groupBy(*self.keys).agg(*(F.sum(c).cast(kinds[c]).alias(c) for c in [*self.measures, N]))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("_change", "long")).parquet(self.path)

    def rebuild(self, rows: DataFrame) -> None:
        """From scratch; changes applied so far are forgotten."""
        self._partial(rows, 1).withColumn("_change", F.lit(-1).cast("long")).write.mode("overwrite").partitionBy("_change").parquet(self.path)

    def apply(self, number: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Change number (0 or more): rows that came and rows that went; an updated row went as it was and came as it is."""
        parts = [self._partial(r, s).select(*self.schema.names) for r, s in ((inserted, 1), (deleted, -1)) if r is not None]
        both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        whole = self._merged(both).withColumn("_change", F.lit(number).cast("long"))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_change").parquet(self.path)

    def current(self) -> DataFrame:
        """The aggregate now: keys, measures and `n`; groups without rows are gone."""
        return self._merged(self._stored()).filter(F.col(N) != 0).withColumnRenamed(N, "n")

    def compacted(self, path: str) -> MaintainedAggregate:
        """The same with its changes merged into one table, below a new path; changes up to now must not be applied again."""
        out = MaintainedAggregate.__new__(MaintainedAggregate)
        out.__dict__ |= self.__dict__ | {"path": path}
        merged = self._merged(self._stored()).filter(F.col(N) != 0).withColumn("_change", F.lit(-1).cast("long"))
        merged.write.partitionBy("_change").parquet(path)
        return out


class Revalidated:
    """Results by name below a path, each built again when it is older than its time or its tag has been purged.

    Lists are asked for with 3,600 seconds, profiles with 86,400. A result is a folder named by the time of its building, with a
    note of its tags; a reader that began with an older one keeps it until forget_old().
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self, name: str) -> list[int]:
        """Times of the finished results of a name, oldest first."""
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/{name}/*/rows/_SUCCESS"))
        return sorted(int(s.getPath().getParent().getParent().getName()) for s in found or [])

    def get(self, name: str, build: Callable[[], DataFrame], max_age: int, now: int, tags: Iterable[str] = ()) -> DataFrame:
        """The stored result, if it was built less than max_age seconds before now, else a new one; name is a path of its own."""
        times = self._entries(name)
        if not times or now - times[-1] >= max_age:
            at = f"{self.path}/{name}/{now}"
            self.spark.createDataFrame([(json.dumps(sorted(tags)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/tags")
            build().write.mode("overwrite").parquet(f"{at}/rows")
            times = [now]
        return self.spark.read.parquet(f"{self.path}/{name}/{times[-1]}/rows")

    def _drop(self, name: str, time: int) -> None:
        self._fs.delete(self._hadoop.Path(f"{self.path}/{name}/{time}"), True)

    def purge_path(self, name: str) -> int:
        """Forget the results of a name; returns how many."""
        times = self._entries(name)
        for t in times:
            self._drop(name, t)
        return len(times)

    def purge_tag(self, tag: str, names: Iterable[str]) -> list[str]:
        """Forget the results with a tag among names; returns the names that had some."""
        hit = []
        for name in names:
            for t in self._entries(name):
                if tag in json.loads(self.spark.read.text(f"{self.path}/{name}/{t}/tags").first()[0]):
                    self._drop(name, t)
                    hit.append(name)
        return sorted(set(hit))

    def forget_old(self, name: str) -> None:
        """Forget all results of a name but the newest."""
        for t in self._entries(name)[:-1]:
            self._drop(name, t)
