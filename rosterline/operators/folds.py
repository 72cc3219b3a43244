"""Ordered folds: rows of a key, one after another, through a state that decides about the next row.

Rows are dealt by key and sorted in their task; a task holds the state of one key at a time and never
its rows, so a key may have any number of them. A fold whose next step hangs on the last can't be split: a hot key is the
work of one task, in bounded memory as far as its state is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Row = dict[str, Any]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], schema: str | StructType, begin: Callable[[], Any], step: Callable[[Any, Row], Iterator[Row]], end: Callable[[Any], Iterator[Row]]) -> DataFrame:
    """Rows that step(state, row) yields for every row in order, then end(state), for every key; begin() gives a key's first state.

    Null keys are a key. Rows that are equal in keys and order come in any order.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        at, state, out = None, None, []
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != at:
                    out.extend(end(state)) if at is not None else None
                    at, state = key, begin()
                out.extend(step(state, row))
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
        out.extend(end(state)) if at is not None else None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, kind)
