"""Running values that never fall below zero, as a two-level segmented scan.

A step adds an amount and is floored at zero, or sets a value. Steps
compose: a stretch of steps either ends at a value that does not depend on
what came before, or is known by its sum and its least prefix sum. So the
rows are dealt to ranges of keys and order, each range's rows are scanned
on their own, what the ranges amount to is scanned in turn, and each row
is put together from both. A key that holds all rows is scanned by as many
tasks as there are ranges; a key's ranges, not its rows, pass one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise


def _floored(before: Column, total: Column, least: Column) -> Column:
    """The value after steps of the given sum and least prefix sum that begin at ``before``."""
    return total - F.least(-before, least)


def ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows dealt to ranges of keys and order, numbered by ``part`` in that order; written, so that the numbers stay."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()))


def floored_scan(df: DataFrame, keys: list[str], order: list[str], delta: str = "delta", absolute: str | None = None, parts: int | None = None) -> DataFrame:
    """``score``: the running value of each row of a key, in order.

    A row whose ``absolute`` is not null sets the value (below zero: to
    zero), any other adds ``delta`` (null: nothing) and is floored at
    zero. The order should be total; rows that tie are taken together.
    Null keys are a group of their own.
    """
    fresh = F.lit(None).cast("bigint") if absolute is None else F.greatest(F.lit(0), F.col(absolute)).cast("bigint")
    if absolute is not None:
        fresh = F.when(F.col(absolute).isNotNull(), fresh)
    d = df.withColumn("fresh", fresh).withColumn("step", F.when(F.col("fresh").isNotNull(), F.col("fresh")).otherwise(F.coalesce(F.col(delta).cast("bigint"), F.lit(0))))
    d = ranges(d, keys, order, parts)
    here = W.partitionBy("part", *keys).orderBy(*order)
    d = d.withColumn("stretch", F.count("fresh").over(here))
    own = W.partitionBy("part", *keys, "stretch").orderBy(*order)
    d = d.withColumn("total", F.sum("step").over(own)).withColumn("low", F.min("total").over(own))
    # of a range's stretches the last one tells what it amounts to: a value, or a sum and its least prefix
    last = F.max(F.struct("stretch", *order, "total", "low")).alias("last")
    low = F.min(F.when(F.col("stretch") == 0, F.col("low")))
    p = d.groupBy("part", *keys).agg(last, low.alias("low"))
    done = F.col("last.stretch") > 0
    p = p.select("part", *keys, F.when(done, _floored(F.lit(0), F.col("last.total"), F.col("last.low"))).alias("value"), F.col("last.total").alias("total"), "low")
    w = W.partitionBy(*keys).orderBy("part")
    p = p.withColumn("stretch", F.count("value").over(w))
    v = W.partitionBy(*keys, "stretch").orderBy("part")
    p = p.withColumn("run", F.sum(F.coalesce("value", "total")).over(v))
    p = p.withColumn("deep", F.min(F.when(F.col("value").isNull(), F.col("run") - F.col("total") + F.col("low"))).over(v))
    p = p.withColumn("end", F.col("run") - F.least(F.lit(0), F.coalesce("deep", F.lit(0))))
    p = p.select(F.col("part").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.lag("end").over(w), F.lit(0)).alias("before"))
    on = F.col("part") == F.col("of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    score = _floored(F.when(F.col("stretch") > 0, F.lit(0)).otherwise(F.col("before")), F.col("total"), F.col("low"))
    return d.join(p, on).withColumn("score", score).drop("fresh", "step", "part", "stretch", "total", "low", "of", *[f"of_{k}" for k in keys], "before")


def running_best(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``name``: the largest value of a key so far, by the same two levels."""
    d = ranges(df, keys, order, parts)
    d = d.withColumn("own", F.max(value).over(W.partitionBy("part", *keys).orderBy(*order)))
    w = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    p = d.groupBy("part", *keys).agg(F.max(value).alias("most")).withColumn("before", F.max("most").over(w))
    return _with_before(d, p, keys, F.greatest("own", "before"), name)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``name``: the sum of a key's values so far (of all rows, without keys), by the same two levels."""
    return running_sums(df, keys, order, {name: value}, parts)


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], parts: int | None = None) -> DataFrame:
    """As ``running_sum``, of several values at once: the new columns' names and what they sum."""
    d = ranges(df, keys, order, parts)
    here = W.partitionBy("part", *keys).orderBy(*order)
    d = d.withColumns({f"own_{n}": F.sum(v).over(here) for n, v in values.items()})
    w = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    p = d.groupBy("part", *keys).agg(*[F.sum(v).alias(f"all_{n}") for n, v in values.items()])
    p = p.select(F.col("part").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys], *[F.sum(f"all_{n}").over(w).alias(f"before_{n}") for n in values])
    on = F.col("part") == F.col("of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    out = d.join(p, on).withColumns({n: F.col(f"own_{n}") + F.coalesce(F.col(f"before_{n}"), F.lit(0)) for n in values})
    return out.drop("part", "of", *[f"of_{k}" for k in keys], *[f"{x}_{n}" for x in ("own", "before") for n in values])


def _with_before(d: DataFrame, parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add what stands ``before`` each range to its rows, and from both and ``own`` the value."""
    p = parts.select(F.col("part").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys], "before")
    on = F.col("part") == F.col("of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return d.join(p, on).withColumn(name, value).drop("part", "own", "of", *[f"of_{k}" for k in keys], "before")
