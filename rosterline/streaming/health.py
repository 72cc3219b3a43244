"""Scrape events as streams: rolling health, first writes, resolutions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterline.operators.health import DEFAULT_YIELD, WINDOW

EVENT = "url string, log_id long, anomaly boolean, avg_yield double, volume double, total long"
STATE = "success array<boolean>, yields array<double>, average double, total long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Score each event of one url, in the order of its time, against the average stored before it."""
    success, yields, average, total = state.get if state.exists else ([], [], None, 0)
    success, yields = list(success), list(yields)
    rows = pd.concat(list(batches)).sort_values(["scraped_at", "log_id"])
    out = []
    for log_id, ok, found in zip(rows["log_id"], rows["success"], rows["judges_found"], strict=True):
        success, yields = [*success, bool(ok)][-WINDOW:], [*yields, float(found)][-WINDOW:]
        wins = [y for s, y in zip(success, yields, strict=True) if s]
        last = wins[-1] if wins else 0.0
        expected = average if average and average > 0 else DEFAULT_YIELD
        anomaly = bool(wins and average and average > 0 and 1 - last / average > 0.5)
        average, total = (sum(wins) / len(wins) if wins else None), total + 1
        out.append((key[0], int(log_id), anomaly, average, min(1.0, last / expected), total))
    state.update((success, yields, average, total))
    yield pd.DataFrame(out, columns=["url", "log_id", "anomaly", "avg_yield", "volume", "total"])


def rolling_health(logs: DataFrame) -> DataFrame:
    """M1: a row per event of a stream of logs(url, log_id, success, judges_found, scraped_at).

    A url's state is ten logs, whatever its history. Within a batch events are taken in the
    order of their time; a batch must not hold events older than those of the batch before.
    """
    rows = logs.select("url", "log_id", "success", "judges_found", "scraped_at")
    return rows.groupBy("url").applyInPandasWithState(_update, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


def first_writes(urls: DataFrame, time: str, lateness: str) -> DataFrame:
    """The first row of each url within the watermark."""
    return urls.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["url"])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """M3, K8: hand everything that is there to sink(batch, id) and stop; a later run with the same checkpoint goes on from there."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> dict[str, object]:
    """What the last batch of a query did."""
    last = query.lastProgress
    return {} if last is None else {"batch": last["batchId"], "rows": last["numInputRows"], "active": query.isActive, "error": str(query.exception() or "")}


def run_until(query: StreamingQuery, cancelled: Callable[[], bool], every: float = 1.5) -> bool:
    """M9: wait for a query, asking in between whether it is cancelled; True if it was stopped. A batch that runs is finished or done again later."""
    while query.isActive:
        if cancelled():
            query.stop()
            return True
        query.awaitTermination(every)
    return False
