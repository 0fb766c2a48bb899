"""k-means of every group at once, with restarts.

A group may have any size: its points are never gathered. Seeds are drawn
as k-means++ draws them, the next centre in proportion to the squared
distance from those before it, by exponential keys: the point of the least
key is a grouped minimum. All starts of all groups advance in the same
grouped sums; of a group's starts the one of least inertia stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import chance, exponential
from .store import materialise


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _distances(centres: Column) -> Column:
    return F.transform(centres, lambda c: _distance(F.col("v"), c))


#: Numbers of all groups' centres that are broadcast; more are merged.
FEW = 100_000


def _met(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """Points with their group's centres, which are broadcast only if their count is small."""
    size = centres.agg(F.sum(F.size(F.flatten(F.flatten("centres"))))).first()[0] or 0
    return points.join(F.broadcast(centres) if size <= FEW else centres.hint("merge"), key)


def _seeds(points: DataFrame, key: str, k: int, starts: int, seed: str) -> DataFrame:
    """``key, centres``: for each start ``k`` points, the first by chance and the next far from those before."""
    first = [F.min(F.struct(chance(F.lit(seed), F.lit(s), F.lit(0), "id").alias("wait"), "id", "v"))["v"] for s in range(starts)]
    c = points.groupBy(key).agg(F.array(*[F.array(x) for x in first]).alias("centres"))
    for i in range(1, k):
        c = materialise(c)
        near = _met(points, c, key)
        nxt = []
        for s in range(starts):
            far = F.array_min(_distances(F.col("centres")[s]))
            wait = F.when(far > 0, exponential(far, F.lit(seed), F.lit(s), F.lit(i), "id"))
            nxt.append(F.min(F.when(wait.isNotNull(), F.struct(wait.alias("wait"), "id", "v")))["v"])
        c = c.join(near.groupBy(key).agg(F.array(*nxt).alias("nxt")).hint("merge"), key)
        # where all points lie on centres, the last one is repeated
        c = c.select(key, F.zip_with("centres", "nxt", lambda a, b: F.concat(a, F.array(F.coalesce(b, F.element_at(a, -1))))).alias("centres"))
    return materialise(c.withColumn("done", F.array_repeat(F.lit(False), starts)))


def grouped_kmeans(
    df: DataFrame, key: str, ident: str, columns: list[str], k: int = 2, starts: int = 10, rounds: int = 30, eps: float = 0.5, seed: str = "0"
) -> DataFrame:
    """``key, cluster, centre, n``: the centres of each group's ``k`` clusters, in their own order, and the clusters' sizes.

    A start whose centres all move by less than ``eps`` stands still from
    then on. Of starts of equal inertia (to three decimals) the first is
    taken, of equally near centres too; a centre without points stays
    where it was. Rows with a null column, key or id are left out; ids
    tell points of a group apart.
    """
    points = df.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    points = materialise(points.where(F.col("key").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull())))
    c = _seeds(points, "key", k, starts, seed)

    def owned(open_: bool) -> DataFrame:
        """Each point with each start, its nearest centre and the squared distance."""
        p = _met(points, c, "key").select("v", "key", F.posexplode("centres").alias("s", "at"), "done")
        p = p.where(~F.col("done")[F.col("s")]) if open_ else p
        p = p.withColumn("far", _distances(F.col("at"))).withColumn("d", F.array_min("far"))
        return p.withColumn("own", (F.array_position("far", F.col("d")) - 1).cast("int"))

    for _ in range(rounds):
        mean = F.array(*[F.sum(F.col("v")[i]) / F.count("*") for i in range(len(columns))])
        new = owned(True).groupBy("key", "s", "own").agg(mean.alias("mean"))
        new = new.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s") * k + F.col("own"), "mean"))).alias("new"))  # starts * k entries
        both = c.join(new.hint("merge"), "key", "left").withColumn("new", F.coalesce("new", F.create_map().cast("map<int, array<double>>")))
        moved = F.transform("centres", lambda cs, s: F.transform(cs, lambda x, i: F.coalesce(F.try_element_at("new", s * k + i), x)))
        both = both.withColumn("moved", moved)
        far = F.zip_with("centres", "moved", lambda a, b: F.array_max(F.flatten(F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.abs(p - q))))))
        both = both.withColumn("done", F.zip_with("done", far, lambda d, m: d | (m < eps)))
        c = materialise(both.select("key", F.col("moved").alias("centres"), "done"))
        if c.where(F.exists("done", lambda d: ~d)).isEmpty():
            break
    sizes = owned(False).groupBy("key", "s", "own").agg(F.count("*").alias("n"), F.sum("d").alias("inertia"))
    every = F.map_from_entries(F.collect_list(F.struct("own", "n")))
    best = sizes.groupBy("key", "s").agg(F.round(F.sum("inertia"), 3).alias("inertia"), every.alias("n"))
    best = best.groupBy("key").agg(F.min_by(F.struct("s", "n"), F.struct("inertia", "s")).alias("b"))
    out = c.join(best.hint("merge"), "key").withColumn("centres", F.col("centres")[F.col("b.s")])
    told = F.transform("centres", lambda x, i: F.struct(x.alias("centre"), F.coalesce(F.try_element_at("b.n", i), F.lit(0)).cast("bigint").alias("n")))
    out = out.select(F.col("key").alias(key), F.posexplode(F.array_sort(told)).alias("cluster", "c"))
    return out.select(key, "cluster", "c.centre", "c.n")
