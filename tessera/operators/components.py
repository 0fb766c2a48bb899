"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, component)`` of every node with an edge ``(src, dst)``; the component is its least node.

    Every step is a grouped minimum and a join; the state is cut after
    each round, so that neither lineage nor a hub's links gather anywhere.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    e, before = materialise(e), None
    for _ in range(rounds):
        sym = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(e.select("lo", "hi"))
        least = sym.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x"))
        star = sym.where("m > n").join(least, "n").select(F.col("m").alias("n"), "x").where("n <> x").distinct()
        least = star.groupBy("n").agg(F.min("x").alias("y"))
        e = star.join(least, "n").where("x <> y").select(F.col("x").alias("hi"), F.col("y").alias("lo")).union(least.select("n", "y")).distinct()
        e = materialise(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
        before = now
    raise RuntimeError("no fixed point")
