"""Events that come late and in any order, jobs that fall silent, and a sink that a repeated batch can't write twice (M1, M8, K8).

State lies in the RocksDB store of Structured Streaming. An event waits in its key's list until the watermark has
passed it: then nothing older can come any more, and event-time timers hand events on in the order of their
time, whatever batches they came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rosterline.operators.health import DEFAULT_YIELD, WINDOW

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORED = "url string, log_id long, scraped_at timestamp, anomaly boolean, avg_yield double, volume double, total long"
#: Hours without a sign after which a running job has failed, and what then is said; states that end a job.
SILENT_HOURS, SILENT, ENDED = 2, "No progress for 2 hours", ("COMPLETED", "FAILED", "CANCELLED")


def _with_state(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def scored(window: tuple[list[bool], list[float], float | None, int], ok: bool, found: float) -> tuple[tuple, bool, float]:
    """(state after an event, whether its yield is an anomaly, its volume) against the average stored before it."""
    success, yields, average, total = window
    success, yields = [*success, ok][-WINDOW:], [*yields, found][-WINDOW:]
    wins = [y for s, y in zip(success, yields, strict=True) if s]
    last = wins[-1] if wins else 0.0
    known = average is not None and average > 0
    anomaly = bool(wins) and known and 1 - last / average > 0.5
    volume = min(1.0, last / (average if known else DEFAULT_YIELD))
    return (success, yields, sum(wins) / len(wins) if wins else None, total + 1), anomaly, volume


class _Health(StatefulProcessor):
    """A url's waiting events as a list, and its last ten as a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, log_id long, success boolean, found double")
        self.window = handle.getValueState("window", "success array<boolean>, yields array<double>, average double, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            times = (batch["scraped_at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            new = list(zip(times, batch["log_id"].tolist(), batch["success"].fillna(False).astype(bool).tolist(), batch["judges_found"].fillna(0).astype(float).tolist(), strict=True))
            self.waiting.appendList(new)
            for at in set(times):
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.waiting.get())
        ripe = [w for w in waiting if w[0] <= until]
        if not ripe:
            return
        rest = waiting[len(ripe) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        state = tuple(self.window.get()) if self.window.exists() else ([], [], None, 0)
        out = []
        for at, log_id, ok, found in ripe:
            state, anomaly, volume = scored((list(state[0]), list(state[1]), state[2], state[3]), ok, found)
            out.append((key[0], log_id, datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None), anomaly, state[2], volume, state[3]))
        self.window.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    def close(self) -> None:
        pass


def ordered_health(logs: DataFrame, lateness: str) -> DataFrame:
    """M1: a row per event of a stream of logs(url, log_id, success, judges_found, scraped_at), in the order of time and log_id.

    Events may come in any order and batch, up to `lateness` behind the newest; later ones are dropped. An event is
    scored once the watermark has passed it, so those of the last `lateness` wait for newer ones. A url's state is ten
    logs and what waits. Times count in milliseconds; the session's time zone must be UTC. Null yields are 0, null
    success is none.
    """
    _with_state(logs)
    rows = logs.select("url", "log_id", "success", F.col("judges_found").cast("double").alias("judges_found"), F.col("scraped_at").cast("timestamp").alias("scraped_at"))
    late = rows.withWatermark("scraped_at", lateness).groupBy("url")
    return late.transformWithStateInPandas(statefulProcessor=_Health(), outputStructType=SCORED, outputMode="Append", timeMode="EventTime")


class _Silence(StatefulProcessor):
    """A running job's last sign, and a timer behind it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, ended = tuple(self.last.get()) if self.last.exists() else (None, False)
        for batch in rows:
            times = (batch["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            at = max([*times, at] if at is not None else times)
            ended = ended or bool(batch["status"].isin(ENDED).any())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((at, ended))
        # An ended job is remembered as long as a late sign of it could still come, then forgotten.
        self.handle.registerTimer(at + SILENT_HOURS * 3_600_000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ended = tuple(self.last.get()) if self.last.exists() else (None, True)
        self.last.clear()
        if not ended:
            last = datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None)
            yield pd.DataFrame([(key[0], "FAILED", SILENT, last)], columns=["job_id", "status", "message", "last_sign"])

    def close(self) -> None:
        pass


def silent_jobs(signs: DataFrame, lateness: str) -> DataFrame:
    """M8: a row for each running job that two hours pass without a sign of, from a stream of signs(job_id, status, at).

    The watermark is the clock: a job fails once signs of others are two hours and `lateness` ahead of its last one. A job
    that is completed, failed or cancelled can't fail; a sign after a failure begins the job anew.
    """
    _with_state(signs)
    kind = signs.schema["job_id"].dataType.simpleString()
    rows = signs.select("job_id", "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", lateness)
    schema = f"job_id {kind}, status string, message string, last_sign timestamp"
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Silence(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """K8: a sink for foreachBatch that keeps each batch under its number; a batch that is done again replaces what it had written."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def sunk(spark: SparkSession, path: str, schema: str, keys: list[str], newest: str) -> DataFrame:
    """K8: the rows of a batch_sink(), of each key the one with the greatest `newest` (of equals that of the latest batch)."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    value = F.struct(*[c for c in rows.columns if c not in keys])
    place = F.struct(newest, "batch")
    return rows.groupBy(*keys).agg(F.max_by(value, place).alias("_v")).select(*keys, "_v.*").drop("batch")
