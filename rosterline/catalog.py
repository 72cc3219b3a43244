"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterline.plans import backoffice, directory, records, telemetry, webpages

Query = Callable[[SparkSession, str], DataFrame]
PLANS = [directory, telemetry, records, webpages, backoffice]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges by state and status: the dashboard's one query over all four levels."""
    return directory.a2_status_by_state(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.SQL.items()}
