"""Neighbour graphs of vectors and their spectral coordinates, for all groups at once.

The nearest neighbours of a group's vectors are exact: its rows are dealt
to blocks, every pair of blocks is one product of two matrices, and of
each only a row's best neighbours go on. The work is quadratic in a group
(the crops of one clip), in tasks of one pair of blocks each; nothing of
it is emitted but ``k`` neighbours a row and block. The graph becomes
fuzzy by a bandwidth of each point's own and is made symmetrical by the
union of both directions. Coordinates are the leading eigenvectors of the
normalised graph, by orthogonal iteration in grouped sums: only a few
numbers of each group pass one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import unit
from .sampling import chance
from .store import materialise

#: Rows of a block; blocks from which on they grow, up to so many rows; rows whose products are held at once.
BLOCK, BLOCKS, LARGE, TILE = 2000, 16, 16_000, 500


def blocks(rows: Column) -> Column:
    """Blocks of a group: each row is sent to all of them, so their number grows late."""
    return F.greatest(F.least(F.ceil(rows / F.lit(float(BLOCK))), F.lit(BLOCKS)), F.ceil(rows / F.lit(float(LARGE)))).cast("int")


def best_of(sim: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(row, column)`` of each row's ``k`` largest, rounded to nine decimals, best first; of equals those of the lesser ``others``."""
    if sim.shape[1] > k:
        # what may round to the last place's value stays
        last = -np.partition(-sim, k - 1, axis=1)[:, k - 1] - 1.5e-9
        row, column = np.nonzero((sim >= last[:, None]) & (sim > -np.inf))
    else:
        row, column = np.nonzero(sim > -np.inf)
    order = np.lexsort((others[column], -np.round(sim[row, column], 9), row))
    row, column = row[order], column[order]
    first = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sim)))[:-1]]
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def nearest(df: DataFrame, group: str, ident: str, vector: str, k: int = 15) -> DataFrame:
    """``(grp, id, near)``: of each row the ``k`` rows of its group with the largest cosine, as ``(sim, other)``, best first.

    Cosines are rounded to nine decimals; of equals the lesser id comes
    first. Rows with a null group, id or vector are left out.
    """
    v = df.select(F.col(group).alias("grp"), F.col(ident).alias("id"), unit(F.col(vector).cast("array<double>")).alias("v")).dropna()
    n = v.groupBy("grp").agg(blocks(F.count("*")).alias("blocks"))
    v = v.join(n, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    v = materialise(v)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ask = v.select("grp", "id", "v", F.col("own").alias("a"), each.alias("b"))
    base = v.select("grp", "id", "v", F.col("own").alias("b"), each.alias("a"))
    kinds = [f"{c} {t.simpleString()}" for c, t in ((f.name, f.dataType) for f in v.select("grp", "id").schema)]

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"grp": [], "id": [], "near": []})
        right = right.sort_values("id", ignore_index=True)
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        to = np.stack(right["v"]).T
        near: list[list[dict]] = [[] for _ in ids]
        for at in range(0, len(ids), TILE):
            sim = np.stack(left["v"].iloc[at : at + TILE]) @ to
            sim[np.isnan(sim)] = -np.inf
            if left["a"].iloc[0] == right["b"].iloc[0]:
                sim[ids[at : at + TILE, None] == others[None, :]] = -np.inf
            row, column = best_of(sim, others, k)
            for i, s, o in zip(row.tolist(), np.round(sim[row, column], 9).tolist(), others[column]):
                near[at + i].append({"sim": s, "other": o})
        return pd.DataFrame({"grp": left["grp"], "id": ids, "near": near})

    other = v.schema["id"].dataType.simpleString()
    part = ask.groupBy("grp", "a", "b").cogroup(base.groupBy("grp", "a", "b")).applyInPandas(pairs, ", ".join([*kinds, f"near array<struct<sim: double, other: {other}>>"]))
    order = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-x["sim"]).alias("less"), x["other"].alias("other"))))  # k entries of each block
    out = part.groupBy("grp", "id").agg(F.slice(order, 1, k).alias("near"))
    return out.select("grp", "id", F.transform("near", lambda x: F.struct((-x["less"]).alias("sim"), x["other"].alias("other"))).alias("near"))


def bandwidths(d: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Membership of each neighbour: falls from 1 beyond the nearest one, with a width by which all of a row's add up to log2 of their number."""
    real = np.arange(d.shape[1]) < size[:, None]
    rho = np.where(real & (d > 0), d, np.inf).min(1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    over = np.maximum(d - rho[:, None], 0)
    goal, low, high = np.log2(np.maximum(size, 2)), np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    for _ in range(64):
        total = np.where(real, np.exp(-over / width[:, None]), 0).sum(1)
        more = total < goal
        low, high = np.where(more, width, low), np.where(more, high, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    # a row of equal distances has no width that fits
    width = np.maximum(width, 1e-3 * np.where(real, d, 0).sum(1) / np.maximum(size, 1))
    return np.where(real, np.exp(-over / np.maximum(width, 1e-12)[:, None]), 0)


def fuzzy(near: DataFrame) -> DataFrame:
    """``(grp, src, dst, w)`` in both directions: the fuzzy union of the memberships that two rows give each other."""
    kinds = {c: near.schema[c].dataType.simpleString() for c in ("grp", "id")}

    def run(parts):
        for pdf in parts:
            size = pdf["near"].map(len).to_numpy()
            d = np.zeros((len(pdf), max(1, int(size.max(initial=0)))))
            for i, row in enumerate(pdf["near"]):
                d[i, : len(row)] = [max(0.0, 1 - x["sim"]) for x in row]
            p = bandwidths(d, size)
            yield pd.DataFrame(
                {
                    "grp": np.repeat(pdf["grp"].to_numpy(), size), "src": np.repeat(pdf["id"].to_numpy(), size),
                    "dst": [x["other"] for row in pdf["near"] for x in row], "p": p[np.arange(p.shape[1]) < size[:, None]],
                }
            )

    one = near.mapInPandas(run, f"grp {kinds['grp']}, src {kinds['id']}, dst {kinds['id']}, p double")
    both = one.union(one.select("grp", F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    w = F.when(F.count("*") == 2, F.min("p") + F.max("p") - F.min("p") * F.max("p")).otherwise(F.max("p"))
    return both.groupBy("grp", "src", "dst").agg(w.alias("w")).where("w > 0")


def _orthonormal(x: DataFrame, dims: int) -> DataFrame:
    """Columns made orthonormal within each group, the first before the next, by the triangular root of their products."""
    kind = x.schema["grp"].dataType.simpleString()
    gram = x.groupBy("grp").agg(F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(dims) for j in range(dims)]).alias("g"))

    def root(parts):
        for pdf in parts:
            out = []
            for g in pdf["g"]:
                g = np.array(g).reshape(dims, dims)
                out.append(np.linalg.inv(np.linalg.cholesky(g + 1e-12 * max(np.trace(g), 1e-300) * np.eye(dims))).T.reshape(-1).tolist())
            yield pd.DataFrame({"grp": pdf["grp"], "r": out})

    r = gram.mapInPandas(root, f"grp {kind}, r array<double>")
    turned = F.array(*[sum((F.col("x")[i] * F.col("r")[i * dims + j] for i in range(dims)), F.lit(0.0)) for j in range(dims)])
    return x.join(r, "grp").withColumn("x", turned).drop("r")


def spectral(graph: DataFrame, dims: int = 3, rounds: int = 25, seed: str = "0") -> DataFrame:
    """``(grp, id, x)``: coordinates of each node, the ``dims`` leading eigenvectors of its group's normalised graph after the trivial one.

    A group is an orthonormal system; its axes may point either way. Each
    round is one join and one grouped sum, and its state is written.
    """
    graph = materialise(graph)
    degree = graph.groupBy("grp", "src").agg(F.sum("w").alias("d"))
    x = degree.select("grp", F.col("src").alias("id"), F.sqrt("d").alias("s"), F.array(F.sqrt("d"), *[chance(F.lit(seed), F.lit(j), "src") / F.lit(2.0**47) - 1 for j in range(dims)]).alias("x"))
    x = materialise(_orthonormal(x, dims + 1))
    for _ in range(rounds):
        to = x.select("grp", F.col("id").alias("dst"), F.transform("x", lambda v: v / F.col("s")).alias("y"))
        moved = graph.join(to, ["grp", "dst"]).groupBy("grp", F.col("src").alias("id")).agg(F.array(*[F.sum(F.col("w") * F.col("y")[i]) for i in range(dims + 1)]).alias("y"))
        x = x.join(moved, ["grp", "id"]).withColumn("x", F.zip_with("x", "y", lambda a, b: (a + b / F.col("s")) / 2)).drop("y")
        x = materialise(_orthonormal(x, dims + 1).select("grp", "id", "s", "x"))
    return x.select("grp", "id", F.slice("x", 2, dims).alias("x"))
