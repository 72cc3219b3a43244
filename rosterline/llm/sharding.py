"""Shards of nearly equal bytes by longest-processing-time scheduling.

Rows that must stay together form a group; groups go, largest first, to the shard that has
least so far. The classic algorithm needs all groups in one sorted list. Here the list is
reduced to size classes first: group weights below EXACT bytes are classes of their own and
larger ones share a class with weights that differ by at most 1 part in STEPS. There are
never more than EXACT + 64 * STEPS classes whatever the input, so the heap on the driver
works on a table of proven size; groups then find their shard by their rank within the class.
The heap works from octave to octave of weights, largest first. Before each, Spark adds up what the shards really hold, so
what classes have rounded is levelled by the next octave, and what remains is the rounding of the
smallest one. Within a class the shards take lighter and heavier groups by turns.
"""

from __future__ import annotations

import heapq
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import forget, free_name, materialize, salted_rank

#: Weights below this are scheduled exactly; above it a class spans 1/STEPS of its weight.
EXACT, STEPS = 4096, 256
#: Groups or rows of a class or shard that are numbered in one task.
ROWS_PER_TASK = 20_000


def weight_class(weight: Column) -> Column:
    """A class number that grows with the weight."""
    power = F.floor(F.log2(weight.cast("double")))
    step = F.floor((weight / F.pow(F.lit(2.0), power) - 1) * STEPS)
    return F.when(weight < EXACT, weight).otherwise(EXACT + power * STEPS + step).cast("long")


def lpt(classes: list[tuple[int, int, int]], shards: int, loads: list[float] | None = None) -> list[tuple[int, int, int, int]]:
    """(class, first rank, last rank, shard) for (class, groups, bytes), given largest class first; loads: what shards hold already.

    Equal items given one by one to the least loaded of a heap fill the shards like water;
    that level is found by bisection and the items that remain go through the heap.
    """
    loads, runs = list(loads or [0.0] * shards), []
    for turn, (label, count, total) in enumerate(classes):
        size = total / count
        take = [0] * shards
        if count > 2 * shards:
            low, high = min(loads), max(loads) + size * (count / shards + 1)
            for _ in range(80):
                level = (low + high) / 2
                if sum(max(0, int((level - x) // size)) for x in loads) <= count:
                    low = level
                else:
                    high = level
            take = [max(0, int((low - x) // size)) for x in loads]
        heap = [(x + k * size, j) for j, (x, k) in enumerate(zip(loads, take, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(take)):
            load, j = heap[0]
            take[j] += 1
            heapq.heapreplace(heap, (load + size, j))
        first = 0
        for j in range(shards) if turn % 2 else range(shards - 1, -1, -1):
            if k := take[j]:
                runs.append((label, first, first + k - 1, j))
                first += k
                loads[j] += k * size
    return runs


def shard_by_bytes(rows: DataFrame, key: str, size: str, order: list[str], shards: int) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard) to rows.

    key: equal values (nulls too) stay together. size: bytes of a row, at least 1 in each
    group. order: columns that settle the slots; rows equal in all of them are alike, so any
    order of theirs will do. An empty table gives an empty table. A group is never split: one
    that outweighs the others fills a shard alone. Where rows have a shard or slot already, the new
    columns have underscores behind their names.
    """
    spark = rows.sparkSession
    taken = rows.columns
    shard_, slot_ = free_name("shard", taken), free_name("slot", taken)
    w_, class_, rank_, key_ = (free_name(x, taken) for x in ("_w", "_class", "_rank", "_key"))
    rows = materialize(rows)
    groups = rows.groupBy(F.col(key).alias(key_)).agg(F.greatest(F.sum(size), F.lit(1)).alias(w_))
    groups = materialize(groups.withColumn(class_, weight_class(F.col(w_))))
    classes = groups.groupBy(class_).agg(F.count("*").alias("n"), F.sum(w_).alias("w"))
    table = [(r[0], r[1], r[2]) for r in classes.orderBy(F.desc(class_)).collect()]  # bounded, see above
    many = max(1, sum(n for _, n, _ in table) // ROWS_PER_TASK)
    ranked = salted_rank(groups, class_, [w_, key_], many, rank_)
    ranked = materialize(ranked)  # every octave reads it

    def placed(runs: list[tuple]) -> DataFrame:
        plan = spark.createDataFrame(runs, "_c long, _from long, _to long, _shard int")
        plan = F.broadcast(plan) if len(runs) <= 200_000 else plan  # 24 bytes each
        return ranked.join(plan, (F.col(class_) == F.col("_c")) & F.col(rank_).between(F.col("_from"), F.col("_to"))).select(key_, F.col("_shard").alias(shard_), w_)

    octave = lambda c: 0 if c < EXACT else 1 + (c - EXACT) // STEPS
    loads, runs = [0.0] * shards, []
    for _, band in groupby(table, lambda c: octave(c[0])):
        own = lpt(list(band), shards, loads)
        runs += own
        if own[-1][0] >= EXACT:
            for shard, held in placed(own).groupBy(shard_).agg(F.sum(w_)).collect():  # a row per shard
                loads[shard] += float(held)
    own = placed(runs).drop(w_)
    joined = materialize(rows.join(own, F.col(key).eqNullSafe(F.col(key_))).drop(key_))
    forget(rows, groups, ranked)
    return salted_rank(joined, shard_, order, max(1, joined.count() // ROWS_PER_TASK // shards), slot_)


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; equal texts share a shard.

    A null text has no bytes and no CRC; null texts count as equal to each other.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("_text"),
    )
    return shard_by_bytes(rows, "_text", "size", ["doc_id", "size", "text_crc32"], shards).drop("_text")
