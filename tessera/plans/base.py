"""Registry of queries over the driver's tables and of the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.detections import DET_SQL, detections

Query = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``@DET`` in its SQL begins a WITH clause that defines the detections view."""

    def add(f: Query) -> Query:
        PLANS[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace("@DET", f"WITH det AS ({DET_SQL})")
        return f

    return add


def det_plan(name: str, sql: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a query that reads nothing but the detections view."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        plan(name, sql)(lambda spark, sf_dir: f(detections(spark, sf_dir)))
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
