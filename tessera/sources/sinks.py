"""Sinks: keyed upserts published as a whole, partitioned splits, and revision fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .buckets import upsert_table


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key; where both sides have one, the new row replaces the old one whole."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def upsert_stream(path: str, keys: list[str], buckets: int = 64):
    """A ``foreachBatch`` function that upserts each micro-batch into a table of buckets."""
    return lambda batch, _: upsert_table(batch.sparkSession, path, batch, keys, buckets)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder for each part of a split, each in as many files as its rows make."""
    df.repartition(column, F.pmod(F.xxhash64(*df.columns), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).write.partitionBy(column).parquet(path)


def write_runs(plan: DataFrame, keys: list[str], order: list[str], writer: Callable[[dict], AbstractContextManager]) -> None:
    """Hand the rows of a render plan to writers, run by run and in order.

    Rows of one run come together and sorted; at each new run ``writer``
    is called with the run's keys, and returns a context whose value takes
    the rows one by one. A task holds one open writer and no rows. A task
    that is run again opens its writers again, so a writer must replace
    what one before it left.
    """

    def run(rows: Iterator[Row]) -> None:
        for names, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            with writer(dict(zip(keys, names))) as put:
                for r in group:
                    put(r.asDict())

    plan.repartition(*keys).sortWithinPartitions(*keys, *order).foreachPartition(run)


def write_runs_stream(keys: list[str], order: list[str], writer: Callable[[dict], AbstractContextManager]):
    """A ``foreachBatch`` function that hands each micro-batch to ``write_runs``."""
    return lambda batch, _: write_runs(batch, keys, order, writer)


def fan_out(revisions: DataFrame, clients: DataFrame) -> DataFrame:
    """What each subscriber gets: every revision from its subscription until it leaves."""
    on = (F.col("c.match_id") == F.col("r.match_id")) & (F.col("r.at") >= F.col("c.since")) & (F.col("c.until").isNull() | (F.col("r.at") < F.col("c.until")))
    return clients.alias("c").join(revisions.alias("r"), on).select("c.client", "c.match_id", "r.seq", "r.at")
