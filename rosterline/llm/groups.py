"""Exact links inside groups of candidates, however large a group is.

A group is cut into blocks of bounded size and every pair of blocks is one unit of work, so a
hot group is spread over tasks. A unit compares its rows inside the task and returns at most
two rows per member: how many links it found for each, and edges enough to connect what is
linked. No row per pair is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: values of the members -> square boolean matrix
Links = Callable[[list], np.ndarray]

RESULT = "id long, links long, other long"


def sizes_of(rows: DataFrame, group: str, block: int, weight: Column | None = None, heaviest: int = 1 << 22) -> DataFrame:
    """(_group, _blocks) of the groups with two members or more: blocks of about `block` members, or `heaviest` by weight."""
    weight_ = F.lit(0) if weight is None else F.sum(weight)
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size"), weight_.alias("_weight")).filter("_size > 1")
    return sizes.select("_group", F.greatest(F.ceil(F.col("_size") / block), F.ceil(F.col("_weight") / heaviest), F.lit(1)).cast("int").alias("_blocks"))


def blocked(rows: DataFrame, group: str, id_: str, sizes: DataFrame) -> DataFrame:
    """rows of the groups in sizes_of(), once per pair of blocks: _group, _i, _j, _own (the row's block).

    sizes should be a written table, so that a hot group's join can be split.
    """
    own = rows.join(sizes, F.col(group) == F.col("_group")).drop(group)
    own = own.withColumn("_own", F.pmod(F.xxhash64(id_, F.lit(7)), F.col("_blocks")).cast("int"))
    own = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = {"_i": F.least("_own", "_with"), "_j": F.greatest("_own", "_with")}
    return own.withColumns(pair).drop("_blocks", "_with")


def connected(same: Callable[[int, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """For each of n members the first member it is connected to; same(k, others) tells which others k is like.

    Members that have been reached are not compared again, so a group of likes costs one
    comparison a member.
    """
    root, open_ = np.full(n, -1), np.arange(n)
    while len(open_):
        start, front, open_ = open_[0], [open_[0]], open_[1:]
        root[start] = start
        while front and len(open_):
            hit = same(front.pop(), open_)
            root[open_[hit]] = start
            front.extend(open_[hit])
            open_ = open_[~hit]
    return root


def in_units(units: DataFrame, keys: list[str], columns: list[str], values: str, work: Callable[[tuple, list], Iterator[tuple]]) -> DataFrame:
    """Rows (id, links, other) that work(key, members) yields for each unit; a member is (_own, *columns, values as an array).

    Units come one after another in their tasks, and a task holds one unit at a time.
    """
    near = units.select(*keys, "_own", *columns, values).repartition(*keys).sortWithinPartitions(*keys, "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, [], []
        kind = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], schema=kind)
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in (*keys, "_own", *columns)]
            column = batch.column(values)
            for n, row in enumerate(zip(*lists, strict=True)):
                if row[: len(keys)] != at:
                    done.extend(work(at, held)) if len(held) > 1 else None
                    at, held = row[: len(keys)], []
                    if len(done) > 20_000:
                        yield out()
                        done.clear()
                value = column[n]
                held.append((*row[len(keys) :], np.frombuffer(value.as_buffer(), np.uint8) if pa.types.is_binary(value.type) else value.values.to_numpy()))
        done.extend(work(at, held)) if len(held) > 1 else None
        if done:
            yield out()

    return near.mapInArrow(run, RESULT)


def link_units(links: Links) -> Callable[[tuple, list], Iterator[tuple]]:
    """Work for in_units() over (_own, id, weight, value): counts and connects all links of a unit.

    Keys end with the two blocks; members of the first come first. links gives the matrix of
    links for the values. Pairs within a block count in that block's own unit only.
    """

    def work(key: tuple, held: list) -> Iterator[tuple]:
        i, j = key[-2], key[-1]
        first = sum(h[0] == i for h in held)
        if i != j and first in (0, len(held)):
            return
        found = links([h[3] for h in held])
        np.fill_diagonal(found, False)
        if i != j:
            found[:first, :first] = False
            found[first:, first:] = False
        count = found @ np.array([h[2] for h in held], np.int64)
        root = connected(lambda k, others: found[k, others], len(held))
        for k in np.flatnonzero(count):
            yield held[k][1], int(count[k]), held[root[k]][1]

    return work
