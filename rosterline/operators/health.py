"""Rolling health of scraped URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.functions.values import clamp01, round_half_up

#: Logs in the window, decay of freshness in days, yield expected of a new URL, weights of the score.
WINDOW, DECAY_DAYS, DEFAULT_YIELD = 10, 90.0, 5.0
WEIGHTS = {"success": 0.4, "consistency": 0.3, "freshness": 0.2, "volume": 0.1}


def latest(logs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The n newest logs of each url, with their place from 1."""
    newest = Window.partitionBy("url").orderBy(F.desc("scraped_at"), F.desc("log_id"))
    return logs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def _scored(df: DataFrame, as_of: Column) -> DataFrame:
    """Score columns from window (array of struct(success, judges_found, scraped_at), newest first) and previous_avg."""
    wins = F.filter("window", lambda x: x.success)
    yields = F.transform(wins, lambda x: x.judges_found.cast("double"))
    df = df.withColumn("_yields", yields).withColumn("_n", F.size("_yields"))
    total = F.aggregate("_yields", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("avg_yield", F.when(F.col("_n") > 0, total / F.col("_n")))
    squares = F.aggregate("_yields", F.lit(0.0), lambda a, x: a + (x - F.col("avg_yield")) * (x - F.col("avg_yield")))
    spread = F.sqrt(squares / F.col("_n"))
    consistency = F.when(F.col("_n") < 2, 0.5).when(F.col("avg_yield") == 0, 0.0).otherwise(clamp01(1 - F.least(F.lit(1.0), spread / F.col("avg_yield"))))
    days = (as_of.cast("double") - F.get(wins, F.lit(0)).scraped_at.cast("timestamp").cast("double")) / 86400.0
    last = F.coalesce(F.get("_yields", F.lit(0)), F.lit(0.0))
    expected = F.when(F.col("previous_avg") > 0, F.col("previous_avg")).otherwise(DEFAULT_YIELD)
    three = lambda at: (F.get("_yields", F.lit(at)) + F.get("_yields", F.lit(at + 1)) + F.get("_yields", F.lit(at + 2))) / 3
    df = df.withColumns(
        {
            "success_rate": F.size(wins).cast("double") / F.size("window").cast("double"),
            "consistency": consistency,
            "freshness": F.coalesce(clamp01(1 - days / DECAY_DAYS), F.lit(0.0)),
            "volume": F.least(F.lit(1.0), last / expected),
            "_recent": F.when(F.col("_n") >= 6, three(0)),
            "_before": F.when(F.col("_n") >= 6, three(3)),
            "_drop": F.when((F.col("_n") > 0) & (F.col("previous_avg") > 0), 1 - last / F.col("previous_avg")),
            "_last": last,
        }
    )
    score = sum((F.col(c) * F.lit(w) for c, w in (("consistency", 0.3), ("freshness", 0.2), ("volume", 0.1))), F.col("success_rate") * F.lit(0.4))
    trend = (
        F.when(F.col("_before") == 0, "STABLE").when(F.col("_recent") > F.col("_before") * 1.2, "IMPROVING").when(F.col("_recent") < F.col("_before") * 0.8, "DECLINING")
    )
    whole = lambda c: F.floor(c + 0.5).cast("long")
    message = F.format_string("yield dropped %d → %d (%d%% decline)", whole(F.col("previous_avg")), F.col("_last").cast("long"), whole(F.col("_drop") * 100))
    df = df.withColumns(
        {
            "health_score": clamp01(score),
            "yield_trend": F.coalesce(trend, F.lit("STABLE")),
            "anomaly": F.coalesce(F.col("_drop") > 0.5, F.lit(False)),
        }
    ).withColumn("anomaly_message", F.when(F.col("anomaly"), message))
    return df.drop("_yields", "_n", "_recent", "_before", "_drop", "_last")


SCORE = ["health_score", "success_rate", "consistency", "freshness", "volume", "avg_yield", "yield_trend", "anomaly", "anomaly_message"]


def recomputed(logs: DataFrame, as_of: Column, previous: DataFrame | None = None) -> DataFrame:
    """The score of every url from its newest logs; previous has url and avg_yield as stored before.

    One aggregation per url; its array holds WINDOW logs at most.
    """
    entry = F.struct("scraped_at", "log_id", "success", "judges_found")
    windows = latest(logs).groupBy("url").agg(F.sort_array(F.collect_list(entry), asc=False).alias("window"))
    before = previous.select("url", F.col("avg_yield").alias("previous_avg")) if previous is not None else None
    df = windows.join(before, "url", "left") if before is not None else windows.withColumn("previous_avg", F.lit(None).cast("double"))
    return _scored(df, as_of).select("url", *SCORE)


def history(logs: DataFrame) -> DataFrame:
    """R18 at every event: the score as it was right after each log, with the average stored before it as baseline.

    The stored average is that of the window after the previous log, so a lag over a rolling
    window gives it. as_of is the time of the log itself.
    """
    in_order = Window.partitionBy("url").orderBy("scraped_at", "log_id")
    rolling = in_order.rowsBetween(-(WINDOW - 1), 0)
    entry = F.struct("scraped_at", "log_id", "success", "judges_found")
    wins = F.when(F.col("success"), F.col("judges_found").cast("double"))
    df = logs.withColumns({"window": F.sort_array(F.collect_list(entry).over(rolling), asc=False), "_avg": F.avg(wins).over(rolling)})
    df = df.withColumn("previous_avg", F.lag("_avg").over(in_order))
    return _scored(df, F.col("scraped_at").cast("timestamp")).select("url", "log_id", "scraped_at", *SCORE)


def summary_by_state(health: DataFrame) -> DataFrame:
    """Bands of the active urls, anomalies, mean score and last scrape by state."""
    band = lambda cond: F.count_if(F.col("active") & cond)
    s = F.col("health_score")
    return health.groupBy("state_abbr").agg(
        F.count("*").alias("total"),
        band(s >= 0.7).alias("healthy"),
        band((s >= 0.3) & (s < 0.7)).alias("moderate"),
        band(s < 0.3).alias("unhealthy"),
        F.count_if("anomaly").alias("anomalies"),
        round_half_up(F.avg(s)).alias("mean_score"),
        F.max("last_scraped_at").alias("last_scraped_at"),
    )


def band(status: str) -> Column:
    """the filter of one band."""
    s, active = F.col("health_score"), F.col("active")
    return {
        "healthy": active & (s >= 0.7),
        "moderate": active & (s >= 0.3) & (s < 0.7),
        "unhealthy": active & (s < 0.3),
        "anomaly": F.col("anomaly"),
        "inactive": ~active,
    }[status]


def resolved_failures(logs: DataFrame) -> DataFrame:
    """M7: failed logs with the time of the first later success of their url.

    The window runs from the newest log down and keeps a running minimum, so its cost is linear in a url's logs.
    """
    newest_first = Window.partitionBy("url").orderBy(F.desc("scraped_at"), F.desc("log_id")).rowsBetween(Window.unboundedPreceding, -1)
    with_next = logs.withColumn("resolved_at", F.min(F.when(F.col("success"), F.col("scraped_at"))).over(newest_first))
    return with_next.filter("not success")


def timed_out(jobs: DataFrame, as_of: Column, hours: float = 2.0) -> DataFrame:
    """M8: running jobs without progress for so long, as FAILED."""
    idle = (as_of.cast("double") - F.col("last_progress_at").cast("timestamp").cast("double")) > hours * 3600
    late = (F.col("status") == "RUNNING") & idle
    return jobs.withColumns({"status": F.when(late, "FAILED").otherwise(F.col("status")), "timed_out": late})


def due_states(states: DataFrame, last_runs: DataFrame, as_of: Column, months: int = 11) -> DataFrame:
    """M6: what the scheduler does with each state: last_runs has state_abbr, active (a job runs) and completed_at."""
    runs = last_runs.groupBy("state_abbr").agg(F.bool_or("active").alias("active"), F.max("completed_at").alias("completed_at"))
    df = states.join(runs, states.abbr == runs.state_abbr, "left")
    fresh = F.col("completed_at") > F.add_months(as_of.cast("date"), -months).cast("timestamp")
    reason = F.when(F.col("active"), "active job").when(fresh, "fresh").when(F.col("completed_at").isNull(), "never harvested").otherwise("stale")
    return df.select("abbr", "completed_at", reason.alias("reason")).withColumn("due", F.col("reason").isin("stale", "never harvested"))


def not_recent(urls: DataFrame, logs: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """M5: urls without a success within so many days."""
    recent = logs.filter(F.col("success") & (F.col("scraped_at").cast("timestamp").cast("double") > as_of.cast("double") - days * 86400.0))
    return urls.join(recent.select("url").distinct(), "url", "left_anti")
