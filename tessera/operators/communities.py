"""Communities by modularity: nodes move to the neighbouring community of the largest gain, then communities become nodes.

All nodes look at once; half of them, by a hash of node and round, may
move, so that neighbours do not change places for ever. A round that does
not raise the modularity is taken back and ends the level. Weights are
whole numbers, and so are gains: results do not depend on the order of
sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import chance
from .store import materialise

_WIDE = "decimal(38,0)"


def _weights(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, w)`` in both directions, and ``(node, k)``: the weight that ends at each node, its loops counted twice."""
    loops = edges.where("a = b").groupBy(F.col("a").alias("node")).agg((2 * F.sum("w")).alias("loop"))
    one = edges.where("a <> b")
    links = one.select("a", "b", "w").union(one.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    links = materialise(links)
    k = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(loops, "node", "full_outer")
    return links, materialise(k.select("node", (F.coalesce("k", F.lit(0)) + F.coalesce("loop", F.lit(0))).alias("k"), F.coalesce("loop", F.lit(0)).alias("loop")))


def _score(links: DataFrame, state: DataFrame, total: int) -> int:
    """Modularity times the square of the total weight."""
    inside = links.join(state.select(F.col("node").alias("a"), F.col("com").alias("ca")), "a").join(state.select(F.col("node").alias("b"), F.col("com").alias("cb")), "b")
    w = inside.where("ca = cb").agg(F.sum("w")).first()[0] or 0
    loops = state.agg(F.sum("loop")).first()[0] or 0
    tot = state.groupBy("com").agg(F.sum("k").cast(_WIDE).alias("t")).agg(F.sum((F.col("t") * F.col("t")).cast(_WIDE))).first()[0] or 0
    return total * (w + loops) - int(tot)


def _round(links: DataFrame, state: DataFrame, total: int, turn: str) -> DataFrame:
    """The state after one round of moves."""
    near = links.join(state.select(F.col("node").alias("b"), "com"), "b").groupBy(F.col("a").alias("node"), "com").agg(F.sum("w").alias("w"))
    own = state.select("node", "k", F.col("com").alias("mine"))
    seen = own.select("node", F.col("mine").alias("com"), F.lit(0).cast("bigint").alias("w"))  # a node may always stay
    seen = near.union(seen).groupBy("node", "com").agg(F.sum("w").alias("w"))
    tot = state.groupBy("com").agg(F.sum("k").alias("t"))
    c = seen.join(tot, "com").join(own, "node")
    others = F.col("t") - F.when(F.col("com") == F.col("mine"), F.col("k")).otherwise(0)
    gain = (F.lit(total).cast(_WIDE) * F.col("w").cast("decimal(18,0)") - F.col("k").cast("decimal(18,0)") * others.cast("decimal(19,0)")).cast(_WIDE)
    c = c.withColumn("gain", gain)
    best = c.groupBy("node").agg(F.max(F.struct("gain", (F.col("com") == F.col("mine")).alias("stays"))).alias("top"), F.first("mine").alias("mine"))
    c = c.join(best.select("node", F.col("top.gain").alias("most"), F.col("top.stays").alias("stays")), "node").where(F.col("gain") == F.col("most"))
    goal = c.groupBy("node").agg(F.min("com").alias("goal"), F.first("stays").alias("stays"))
    may = (chance(F.lit(turn), "node") % 2 == 0) & ~F.col("stays")
    return materialise(state.join(goal, "node").select("node", "k", "loop", F.when(may, F.col("goal")).otherwise(F.col("com")).alias("com")))


def louvain(edges: DataFrame, rounds: int = 12, levels: int = 8) -> DataFrame:
    """``(id, community)`` of every node with an edge ``(source, target)``; a community is named by its least member.

    Edges are undirected and count as often as they are there, loops too;
    null ends are left out.
    """
    e = edges.where("source is not null and target is not null")
    e = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).groupBy("a", "b").agg(F.count("*").alias("w"))
    links, nodes = _weights(materialise(e))
    total = nodes.agg(F.sum("k")).first()[0] or 0
    of = nodes.select(F.col("node").alias("id"), F.col("node").alias("community"))
    for level in range(levels):
        state = nodes.withColumn("com", F.col("node"))
        score, first = _score(links, state, total), None
        for r in range(rounds):
            new = _round(links, state, total, f"{level}:{r}")
            now = _score(links, new, total)
            if now < score or (now == score and r % 2):
                break
            state, score, first = new, now, first or now > score
        if not first:
            break
        # a community is named by its least node before its nodes become one
        name = state.groupBy("com").agg(F.min("node").alias("name"))
        named = materialise(state.join(name, "com").select("node", "name", "loop"))
        of = materialise(of.join(named.select(F.col("node").alias("community"), "name"), "community").select("id", F.col("name").alias("community")))
        a, b = (named.select(F.col("node").alias(c), F.col("name").alias(f"n{c}")) for c in "ab")
        half = links.where("a < b").join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "w")
        loops = named.where("loop > 0").select(F.col("name").alias("a"), F.col("name").alias("b"), F.expr("loop div 2").alias("w"))
        links, nodes = _weights(materialise(half.union(loops).groupBy("a", "b").agg(F.sum("w").alias("w"))))
    return of.select("id", "community")
