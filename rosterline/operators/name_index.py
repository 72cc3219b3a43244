"""An inverted index of three-character pieces: substring search and autocomplete without reading every name.

A posting says that a row's lower-case name holds a piece. Postings are plain rows, sorted by piece and key in files by
the piece's first character, so a frequent piece is spread over files and a look-up reads few of them. A search joins
the rarest pieces of what is asked and tests what is left as the unindexed search does, so both give the same rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterline.operators.ranked import RankedTable
from rosterline.operators.search import SearchParams, contains_ci, reranked, search_filter

#: Behind every name, so that its last two characters begin a piece too.
END = "\0\0"
#: Lists of at most that many keys are sent to all tasks.
SENT = 1_000_000


def pieces(name: Column) -> Column:
    """The distinct three-character pieces of a name in lower case, one from each character on; null gives null."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lower(name), F.lit(END)), F.lit("(?s)(?=(.{3}))."), F.lit(1)))


def bucket_of(piece: str, buckets: int) -> int:
    return zlib.crc32(piece[:1].encode("utf-8", "replace")) % buckets


class NameIndex:
    """An index below a path; `keys` name a row, `name` is the indexed column."""

    def __init__(self, spark: SparkSession, path: str, key_schema: StructType, name: str, buckets: int) -> None:
        self.spark, self.path, self.key_schema, self.name, self.buckets = spark, path, key_schema, name, buckets
        self.keys = key_schema.names
        posting = StructType().add("_piece", "string")
        for f in key_schema:
            posting.add(f)
        self.postings = spark.read.schema(posting.add("_bucket", "integer")).parquet(f"{path}/postings")
        self.counts = spark.read.schema("_piece string, n long, _bucket int").parquet(f"{path}/counts")

    def append(self, rows: DataFrame, parts: int | None = None) -> NameIndex:
        """The index with further rows; their keys must be new to it."""
        _write(rows, self.name, self.keys, self.path, self.buckets, parts)
        return NameIndex(self.spark, self.path, self.key_schema, self.name, self.buckets)

    def _held(self, table: DataFrame, piece: str) -> DataFrame:
        """Rows of a table of pieces with this piece, or with pieces that begin so; both tests reach the scan."""
        test = F.col("_piece") == piece if len(piece) == 3 else F.col("_piece").startswith(piece)
        return table.filter((F.col("_bucket") == bucket_of(piece, self.buckets)) & test)

    def narrowed(self, rows: DataFrame, part: str, lists: int = 1) -> DataFrame:
        """rows (which have the keys) that may hold part, whatever its case: those with its `lists` rarest pieces.

        One list is mostly the cheapest, as the rows are tested anyway; more pay where the rows are much wider than their keys. One or two characters are looked up as beginnings of pieces. The empty text keeps all rows.
        """
        low = part.lower()
        if not low:
            return rows
        asked = sorted({low[i : i + 3] for i in range(len(low) - 2)}) or [low]
        if len(low) < 3:
            n = self._held(self.counts, low).agg(F.sum("n")).first()[0]
            found = [(n, low)] if n else []
        else:
            stored = self.counts.filter(F.col("_bucket").isin(sorted({bucket_of(p, self.buckets) for p in asked})) & F.col("_piece").isin(asked))
            found = sorted((r["n"], r["_piece"]) for r in stored.groupBy("_piece").agg(F.sum("n").alias("n")).collect())  # a row per piece of the query
        if len(found) < len(asked):
            return rows.filter(F.lit(False))
        for n, piece in found[:lists]:
            keys = self._held(self.postings, piece).select(*self.keys)
            rows = rows.join(F.broadcast(keys) if n <= SENT else keys, self.keys, "left_semi")
        return rows

    def matching(self, rows: DataFrame, part: str) -> DataFrame:
        """rows whose name holds part, whatever the case; % and _ are plain characters."""
        return self.narrowed(rows, part).filter(contains_ci(F.col(self.name), part))


def _write(rows: DataFrame, name: str, keys: list[str], path: str, buckets: int, parts: int | None) -> None:
    bucket = F.pmod(F.crc32(F.substring("_piece", 1, 1).cast("binary")), F.lit(buckets)).cast("int")
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.select(F.explode(pieces(F.col(name))).alias("_piece"), *keys).withColumn("_bucket", bucket)
    order = ["_bucket", "_piece", *keys]  # with the keys: a frequent piece is many ranges
    flat.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("append").partitionBy("_bucket").parquet(f"{path}/postings")
    flat.groupBy("_bucket", "_piece").agg(F.count("*").alias("n")).write.mode("append").partitionBy("_bucket").parquet(f"{path}/counts")


def write_index(rows: DataFrame, name: str, keys: list[str], path: str, buckets: int = 64, parts: int | None = None) -> NameIndex:
    """An index of a name column below path. Null and empty names have no pieces; only the empty search finds the latter."""
    _write(rows, name, keys, path, buckets, parts)
    return NameIndex(rows.sparkSession, path, rows.select(*keys).schema, name, buckets)


def search_indexed(table: RankedTable, index: NameIndex, p: SearchParams) -> tuple[DataFrame, DataFrame]:
    """F1, L3: as search.search() does over the same rows, by the index and the ranges of a table ordered by name and judge."""
    found = search_filter(index.narrowed(table.rows, p.q) if p.q else table.rows, p)
    rows = table.page(p.page, p.limit, found)
    total = table.total(found).withColumn("total_pages", F.ceil(F.col("total") / p.limit))
    return (reranked(rows, index.name, p.q) if p.q else rows.withColumn("rank", F.col("position"))), total


def suggestions_indexed(table: RankedTable, index: NameIndex, q: str) -> DataFrame | None:
    """Five results for two characters or more, by the index."""
    return search_indexed(table, index, SearchParams(q=q, limit=5))[0] if len(q.strip()) >= 2 else None
