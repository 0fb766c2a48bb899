"""Projections, samples, votes and spans of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clamp_box, col, digits, dot, rounded


def remap_classes(df: DataFrame, table: list[tuple[int, int, str]]) -> DataFrame:
    """Replace native classes by the table's; rows of other classes are dropped. The table is a literal."""
    pairs = [x for n, c, name in table for x in (F.lit(n), F.struct(F.lit(c).alias("class_id"), F.lit(name).alias("class_name")))]
    to = F.try_element_at(F.create_map(*pairs), F.col("native"))
    return df.withColumn("to", to).where("to is not null").select("*", "to.class_id", "to.class_name").drop("to")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; plans as partial and final group limits."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def top_puck(det: DataFrame) -> DataFrame:
    """Of several pucks in a frame the surest stays; persons are left alone."""
    best = F.row_number().over(W.partitionBy("frame", "class_id").orderBy(F.desc("conf_c"), "event_id"))
    return det.withColumn("rn", best).where("class_id <> 32 or rn = 1").drop("rn")


def carry_forward(df: DataFrame, stride: int, keys: list[str]) -> DataFrame:
    """Each record stands for the frames up to the next sample; of two for one frame the later wins."""
    wide = df.withColumn("source_frame", F.col("frame")).withColumn("frame", F.explode(F.sequence("source_frame", F.col("source_frame") + stride - 1)))
    return top_n(wide, [*keys, "frame"], [F.desc("source_frame"), F.desc("event_id")], 1).drop("rn")


def safe_crop(df: DataFrame, box: list[Column], w: int, h: int, least: tuple[int, int] = (4, 4)) -> DataFrame:
    """Clamp a box to the frame; what is not wider and higher than ``least`` goes."""
    out = df.withColumns(clamp_box(*box, w, h))
    return out.where((F.col("cx2") > F.col("cx1") + least[0]) & (F.col("cy2") > F.col("cy1") + least[1]))


def torso_boxes(x1: str, y1: str, x2: str, y2: str, share: tuple[float, float, float]) -> list[Column]:
    """The part of a box between two heights, cut by a share of the width on both sides."""
    a, b, c, d = (F.col(k).cast("double") for k in (x1, y1, x2, y2))
    top, bottom, side = share
    return [a + F.lit(side) * (c - a), b + F.lit(top) * (d - b), c - F.lit(side) * (c - a), b + F.lit(bottom) * (d - b)]


def track_spans(det: DataFrame, key: str = "track_id") -> DataFrame:
    return det.groupBy(key).agg(F.count("*").alias("n"), F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))


def goalies(det: DataFrame) -> DataFrame:
    """Tracks seen as a goaltender in more than half of their detections."""
    g = det.groupBy("track_id").agg(F.sum(F.when(F.col("class_name") == "goaltender", 1).otherwise(0)).alias("n_goalie"), F.count("*").alias("n"))
    return g.withColumn("is_goaltender", 2 * F.col("n_goalie") > F.col("n"))


def number_votes(det: DataFrame, least: int = 2) -> DataFrame:
    """The number read most often on each track, if read ``least`` times; of equals the one first seen."""
    v = det.where(digits("num") != "").groupBy("track_id", digits("num").alias("number"))
    v = v.agg(F.count("*").alias("votes"), F.sum("conf_c").alias("conf_sum"), F.min(F.struct("frame", "event_id")).alias("seen"))
    v = top_n(v, ["track_id"], [F.desc("votes"), F.col("seen")], 1)
    return v.select("track_id", F.when(F.col("votes") >= least, F.col("number")).alias("number"), "votes", "conf_sum")


def number_islands(spans: DataFrame, least: int = 2) -> DataFrame:
    """Merge tracks of one team and number into runs of which each begins after the one before it has ended.

    The comparison is with the span before, not with the running maximum;
    a null team is a group of its own; ``frame_end`` is the last span's.
    """
    w = W.partitionBy("team_id", "number").orderBy("frame_start", "frame_end", "track_id")
    s = spans.withColumn("new", F.when(F.lag("frame_end").over(w) < F.col("frame_start"), 0).otherwise(1))
    s = s.withColumn("island", F.sum("new").over(w))
    last = F.max(F.struct("frame_start", "frame_end", "track_id"))
    g = s.groupBy("team_id", "number", "island").agg(
        F.sort_array(F.collect_list("track_id")).alias("ids"), F.min("frame_start").alias("frame_start"), last["frame_end"].alias("frame_end"), F.count("*").alias("n_tracks")
    )
    return g.where(F.col("n_tracks") >= least)


def medoids(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Of each group's vectors ``v`` the one with the largest sum of products with all of them, itself included.

    The sum is the product with the summed vector, rounded to nine
    decimals; of equals the least ``ident`` is taken. Keys must not be null.
    """
    total = rows.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    total = total.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("t"))
    s = rows.join(total, keys).withColumn("s", rounded(dot("v", "t"), 9))
    return top_n(s, keys, [F.desc("s"), F.col(ident)], 1).select(*keys, ident, "v")


def bounded_medoids(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """As ``medoids``, for groups whose number of rows is bounded: each is gathered once and its vectors are not taken apart."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("id"), F.col("v").cast("array<double>").alias("v")))).alias("own_rows"))
    none = F.array_repeat(F.lit(0.0), F.size(F.col("own_rows")[0]["v"]))
    g = g.withColumn("own_total", F.aggregate("own_rows", none, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + F.coalesce(b, F.lit(0.0)))))
    # nulls come last, as in a falling order
    less = lambda x: F.coalesce(-rounded(dot(x["v"], "own_total"), 9), F.lit(float("inf")))
    best = F.array_min(F.transform("own_rows", lambda x: F.struct(less(x).alias("less"), x["id"].alias("id"), x["v"].alias("v"))))
    return g.withColumn("own_best", best).select(*keys, F.col("own_best.id").alias(ident), "own_best.v")


def majority(c0: Column, c1: Column) -> Column:
    """The team with more votes; equal votes give team 0."""
    return F.when(c1 > c0, 1).otherwise(0)


def engine_summary(votes: DataFrame) -> DataFrame:
    """Of several engines' votes the surest wins (the first of equals); consensus is the share that agrees with it.

    ``votes(track_id, engine_pos, team, conf_c)``.
    """
    best = top_n(votes, ["track_id"], [F.desc("conf_c"), F.col("engine_pos")], 1).select("track_id", F.col("team").alias("best"), F.col("conf_c").alias("best_conf"))
    both = votes.join(best, "track_id")
    return both.groupBy("track_id").agg(
        F.first("best").alias("team"), F.first("best_conf").alias("conf_c"), F.sum(F.when(F.col("team") == F.col("best"), 1).otherwise(0)).alias("agree"), F.count("*").alias("engines")
    )


def weighted_vote(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value of the largest summed weight (the least of equals), its weight and the total."""
    s = rows.groupBy(*keys, value).agg(F.sum(weight).alias("won"))
    total = F.sum("won").over(W.partitionBy(*keys))
    s = s.withColumn("total", total)
    return top_n(s, keys, [F.desc("won"), col(value)], 1).drop("rn")


def align_flip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether engine ``b``'s labels are to be swapped to match ``a``: only if more tracks differ than agree."""
    j = a.select("track_id", F.col("team").alias("l")).join(b.select("track_id", F.col("team").alias("r")), "track_id")
    same, swap = F.sum(F.when(F.col("l") == F.col("r"), 1).otherwise(0)), F.sum(F.when(F.col("l") != F.col("r"), 1).otherwise(0))
    return j.agg(F.coalesce(same, F.lit(0)).alias("same"), F.coalesce(swap, F.lit(0)).alias("swap")).withColumn("flip", F.col("swap") > F.col("same"))
