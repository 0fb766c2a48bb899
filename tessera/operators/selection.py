"""Exact numbers of rows of every group, chosen by hash, without ordering any group.

The first rows of a group in the order of a hash are found by histograms:
of the hash's first digits for all groups at once, then of its next digits
for the one bucket that holds a cut. Only what is left of that bucket is
ranked. Histograms have 4096 buckets a group, so that a bucket of the
second one holds one row of 16 million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits of a histogram's buckets.
DIGITS = 3


def mixed(key: str, seed: str = "") -> Column:
    """The hash that orders rows: md5 of the key as text and a seed."""
    text = F.col(key).cast("string")
    return F.md5((F.concat(text, F.lit(seed)) if seed else text).cast("binary"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; ``b``'s are dropped."""
    b = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return a.join(b, on, how).drop(*[f"other_{k}" for k in keys])


def _edges(rows: DataFrame, keys: list[str], digits: Column, cuts: list[Column]) -> DataFrame:
    """For each group its size ``n`` and, for each cut, the bucket that holds the first row beyond it, with the number of rows before that bucket."""
    w = W.partitionBy(*keys)
    h = rows.groupBy(*keys, digits.alias("digits")).agg(F.count("*").alias("c"))
    h = h.withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("digits")) - F.col("c"))
    edge = [F.min(F.when(F.col("before") + F.col("c") > cut, F.struct("digits", "before"))).alias(f"edge_{i}") for i, cut in enumerate(cuts)]
    return h.groupBy(*keys).agg(F.first("n").alias("n"), *edge)


def place_by_hash(df: DataFrame, groups: list[str], key: str, cuts: list[Column], seed: str = "") -> DataFrame:
    """``place``: how many cuts a row stands beyond, in its group's order of ``mixed(key, seed)`` and, of equal hashes, of key.

    A cut is a number of rows, as an expression of the group's size ``n``;
    cut ``c`` leaves exactly the first ``c`` rows before it. Null groups
    are a group of their own; a null key stands first; rows that tie in
    key are interchangeable.
    """
    rows = df.withColumn("hash", F.coalesce(mixed(key, seed), F.lit("")))
    part = lambda i: F.substring("hash", 1 + DIGITS * i, DIGITS)
    edges = _edges(rows, groups, part(0), cuts)
    rows = _same(rows, edges, groups)
    beyond, open_ = [], []
    for i, cut in enumerate(cuts):
        e = F.col(f"edge_{i}")
        here = e.isNotNull() & (part(0) == e["digits"])
        open_.append(F.when(here & (e["before"] < cut), F.lit(i)))
        beyond.append(F.when(e.isNotNull() & ((part(0) > e["digits"]) | (here & (e["before"] >= cut))), 1).otherwise(0))
    rows = rows.withColumn("sure", sum(beyond, F.lit(0))).withColumn("cut", F.array_compact(F.array(*open_)))
    goal = F.coalesce(*[F.when(F.col("cut") == i, F.least(c, F.col("n")) - F.col(f"edge_{i}.before")) for i, c in enumerate(cuts)])
    told = rows.where(F.size("cut") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("cut", F.explode("cut"))
    told = told.withColumn("goal", goal.cast("bigint")).drop("n", *[f"edge_{i}" for i in range(len(cuts))])
    by = [*groups, "cut"]
    second = _edges(told.select(*by, "hash", "goal"), [*by, "goal"], part(1), [F.col("goal")]).drop("n", "goal").withColumnRenamed("edge_0", "edge")
    told = _same(told, second, by, "left")
    at = F.row_number().over(W.partitionBy(*by, part(1)).orderBy("hash", key))
    out = F.when(F.col("edge").isNull() | (part(1) < F.col("edge.digits")), 0).when(part(1) > F.col("edge.digits"), 1)
    told = told.withColumn("out", out.otherwise((F.col("edge.before") + at > F.col("goal")).cast("int")))
    told = told.groupBy("row").agg(F.first(F.struct(*df.columns, "sure")).alias("r"), F.sum("out").alias("out"))
    told = told.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col("r.sure") + F.col("out")).cast("int").alias("place"))
    return rows.where(F.size("cut") == 0).select(*df.columns, F.col("sure").cast("int").alias("place")).unionByName(told)
