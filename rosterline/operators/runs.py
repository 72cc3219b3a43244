"""Batch runs that are watched, counted and stopped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def progress_rows(logs: DataFrame, run: list[str], order: list[str], every: int = 5) -> DataFrame:
    """The counters of each run after every `every` urls and after its last: done, succeeded, failed, judges_found.

    logs has a row per url with success and judges_found; a null success has failed, null judges_found are none. order must tell the
    rows of a run apart. The sums run along the sorted rows of a run, in one task with the state of one row.
    """
    along = Window.partitionBy(*run).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.coalesce("success", F.lit(False)).cast("int")
    sums = {"done": F.count("*"), "succeeded": F.sum(ok), "failed": F.sum(1 - ok), "judges_found": F.sum(F.coalesce("judges_found", F.lit(0)))}
    last = F.lead(F.lit(True)).over(along).isNull()
    out = logs.select(*run, *order, *(s.over(so_far).cast("long").alias(n) for n, s in sums.items()), last.alias("last"))
    return out.filter((F.col("done") % every == 0) | F.col("last"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df that counts its rows and sums up metrics (aggregates) as it passes; .get of the second has them once an action is done."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in metrics.items())), seen


class Run:
    """An action (a function that runs Spark jobs) on a thread of its own, with a job tag; result and error once it is done."""

    def __init__(self, spark: SparkSession, tag: str, action: Callable[[], Any]) -> None:
        self.tag, self.result, self.error, self.cancelled = tag, None, None, False
        self._context = spark.sparkContext

        def body() -> None:
            self._context.addJobTag(tag)
            self._context.setJobGroup(tag, f"run {tag}")  # the tracker asks by group
            try:
                self.result = action()
            except Exception as e:  # noqa: BLE001 - told by `error`
                self.error = e
            finally:
                self._context.removeJobTag(tag)

        self._thread = InheritableThread(target=body, session=spark)
        self._thread.start()

    @property
    def active(self) -> bool:
        return self._thread.is_alive()

    def cancel(self) -> None:
        """M9: stop the jobs that run under the tag, of all sessions of this application; what they have committed stays."""
        self.cancelled = True
        self._context.cancelJobsWithTag(self.tag)

    def progress(self) -> dict[str, object]:
        """Jobs of the run so far and the tasks of its stages that have begun; stages that Spark skips or has forgotten don't count."""
        tracker = self._context.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.tag)
        stages = [s for j in jobs if (i := tracker.getJobInfo(j)) for x in i.stageIds if (s := tracker.getStageInfo(x)) and s.numActiveTasks + s.numCompletedTasks + s.numFailedTasks]
        state = "running" if self.active else "cancelled" if self.cancelled and self.error else "failed" if self.error else "completed"
        return {"tag": self.tag, "state": state, "jobs": len(jobs), "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}

    def feed(self, every: float = 1.5) -> Iterator[dict[str, object]]:
        """Progress again and again until the run has ended; the last one says how."""
        while self.active:
            yield self.progress()
            self._thread.join(every)
        yield self.progress()

    def wait(self, cancelled: Callable[[], bool] = lambda: False, every: float = 1.5, most: float = float("inf")) -> bool:
        """Wait, asking in between whether it is cancelled or has taken longer than `most` seconds; True if it was stopped."""
        began = time.monotonic()
        while self.active:
            if not self.cancelled and (cancelled() or time.monotonic() - began > most) or self.cancelled:
                self.cancel()  # again, as an action may begin further jobs
            self._thread.join(every)
        return self.cancelled
