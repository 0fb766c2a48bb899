"""Breadth-first attribution over edges, and deterministic layouts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select("target", "source")).distinct()


def nearest(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """``(id, hop, rank)``: the seed fewest steps away from each node it reaches; of equals the lowest rank.

    One frontier serves all seeds: the lowest rank among a node's nearest
    seeds is the lowest among its predecessors' ranks. The search goes on
    until nothing is new; ``most`` steps, if given, are an error beyond.
    """
    both = materialise(undirected(edges))
    seen = front = materialise(seeds.select("id", F.lit(0).alias("hop"), "rank"))
    for hop in count(1):
        _not_beyond(hop, most)
        step = both.join(front.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.min("rank").alias("rank"))
        front = materialise(step.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop"), "rank"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % 16 == 0:
            seen = materialise(seen)
    return seen


def _not_beyond(hop: int, most: int | None) -> None:
    if most is not None and hop > most + 1:
        raise RuntimeError(f"there are nodes more than {most} steps away")


def nearest_within(edges: DataFrame, seeds: DataFrame, owned: DataFrame, most: int | None = None) -> DataFrame:
    """As ``nearest``, but an owned node ``(id, owner)`` may be entered from its owner's seed alone.

    What may be entered depends on the seed, so the state is kept for
    each seed.
    """
    both = materialise(undirected(edges).join(owned.withColumnRenamed("id", "target"), "target", "left"))
    seen = front = materialise(seeds.select("id", F.lit(0).alias("hop"), "rank", F.col("id").alias("seed")))
    for hop in count(1):
        _not_beyond(hop, most)
        step = both.join(front.select(F.col("id").alias("source"), "rank", "seed"), "source").where(F.col("owner").isNull() | (F.col("owner") == F.col("seed")))
        step = step.select(F.col("target").alias("id"), F.lit(hop).alias("hop"), "rank", "seed").distinct()
        front = materialise(step.join(seen, ["id", "seed"], "left_anti").select("id", "hop", "rank", "seed"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if hop % 16 == 0:
            seen = materialise(seen)
    best = seen.groupBy("id").agg(F.min(F.struct("hop", "rank", "seed")).alias("m"))
    return best.select("id", "m.hop", "m.rank", "m.seed")


def ranked(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Adds ``i``, the place of each row from 0, and ``n``, their number, with no task that holds all rows.

    Rows are dealt to ranges of ``order``, a column without repeats; what
    passes one task is the table of the ranges' sizes.
    """
    spread = df.repartitionByRange(buckets, order) if buckets else df.repartitionByRange(order)
    part = materialise(spread.withColumn("range", F.spark_partition_id()))
    sizes = part.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", (F.sum("size").over(W.orderBy("range")) - F.col("size")).alias("before"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))
    out = part.withColumn("i", F.row_number().over(W.partitionBy("range").orderBy(order)) - 1).join(before, "range")
    return out.withColumn("i", F.col("before") + F.col("i")).drop("range", "before").crossJoin(F.broadcast(total))  # one row


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(id, label)`` after some rounds in which every node takes the label that most of its neighbours have, the least of equals.

    A node begins with its own name; all change at once, so that the
    result depends on nothing but the edges.
    """
    both = materialise(undirected(edges).where("source <> target"))
    state = both.select(F.col("source").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(state.withColumnRenamed("id", "target"), "target").groupBy("source", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
        state = materialise(best.select(F.col("source").alias("id"), F.col("best.label").alias("label")))
    return state


def grid(rank: Column, n: Column, cell: float = 36.0) -> tuple[Column, Column]:
    """Place of a rank in a square grid about the origin."""
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(n)))
    return (rank % cols - cols / 2) * cell, (F.floor(rank / cols) - cols / 2) * cell


def hashed_share(text: Column, part: int) -> Column:
    """A number from 0 to 1 from four bytes of the text's SHA-1."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 8 * part + 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def galaxy(text: Column, radius: float = 110.0) -> dict[str, Column]:
    """A pseudo-random offset on a ball's shells, the same at every run."""
    turn, cos = hashed_share(text, 0) * 2 * F.pi(), hashed_share(text, 1) * 2 - 1
    sin, r = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos)), radius * (0.5 + hashed_share(text, 2) * 0.5)
    return {"dx": r * sin * F.cos(turn), "dy": r * cos, "dz": r * sin * F.sin(turn)}


def spiral(rank: Column, base: float, azimuth: float = 70.0, growth: float = 0.15, lift: float = 15.0, step: float = 29.0, top: float = 60.0) -> dict[str, Column]:
    """A spiral about the z axis: turning, growing, and rising and falling between the plane and ``top`` degrees."""
    wave = (F.lit(lift) + step * rank) % (2 * top)
    up, turn, r = F.radians(F.least(wave, 2 * top - wave)), F.radians(azimuth * rank), base * (1 + growth * rank)
    return {"dx": -r * F.cos(up) * F.cos(turn), "dy": r * F.cos(up) * F.sin(turn), "dz": r * F.sin(up)}
