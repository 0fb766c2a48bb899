"""Seeded sampling: weighted, without replacement, and of triplets.

All chance comes from hashes of keys, so that a sample depends on seed and
rows alone, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import running_sum
from .tracks import top_n

#: Hexadecimal digits of a hash that make a number.
DIGITS = 12


def chance(*parts: Column | str) -> Column:
    """A number from 0 to 2 ** 48 from the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def exponential(weight: Column, *parts: Column | str) -> Column:
    """A waiting time with rate ``weight``: the rows with the least times are a weighted sample without replacement."""
    u = (chance(*parts) + 1).cast("double") / F.lit(float(16**DIGITS + 1))
    return -F.log(u) / weight


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: str, groups: list[str] | None = None) -> DataFrame:
    """``n`` rows (of each group, if any), drawn one after the other with chances in proportion to weight, with their ``place`` in the draw.

    Rows of no or null weight are never drawn; of equal times the lesser
    key comes first. Only the first rows of each partition are kept.
    """
    t = df.where(F.col(weight) > 0).withColumn("wait", exponential(F.col(weight).cast("double"), F.lit(seed), key))
    if groups:
        return top_n(t, groups, [F.col("wait"), F.col(key)], n).withColumnRenamed("rn", "place").drop("wait")
    first = t.orderBy("wait", key).limit(n)  # n rows
    return first.withColumn("place", F.row_number().over(W.orderBy("wait", key))).drop("wait")


def intervals(df: DataFrame, weight: str, order: list[str]) -> DataFrame:
    """``since, until``: the stretch of the running sum of whole weights that belongs to each row, in order."""
    s = running_sum(df.where(F.col(weight) > 0), [], order, weight, "until")
    return s.withColumn("since", F.col("until") - F.col(weight))


def choose(draws: DataFrame, at: str, options: DataFrame, total: int, buckets: int) -> DataFrame:
    """Each draw's option: the one of ``(since, until)`` that holds ``at``, from 0 to ``total``; options are met bucket by bucket."""
    width = max(1, -(-total // buckets))
    o = options.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / width), F.floor((F.col("until") - 1) / width))))
    d = draws.withColumn("bucket", F.floor(F.col(at) / width))
    return d.join(o, "bucket").where((F.col(at) >= F.col("since")) & (F.col(at) < F.col("until"))).drop("bucket", "since", "until")


def triplets(crops: DataFrame, draws: DataFrame, seed: str, buckets: int = 1000) -> DataFrame:
    """Anchors, positives and negatives of one clip, for each of ``draws(draw)``.

    A draw chooses a clip in proportion to ``min(a, b) * (a + b)`` of its
    teams' crops, a team by a coin, two different crops of the team, one
    of the other team, and by another coin whether all are seen in grey;
    draws of a team with a single crop go. ``crops(clip, team, crop)`` with
    teams 0 and 1 and crops unique in their clip. Returns ``draw, clip,
    team, anchor, positive, negative, grey``.
    """
    sizes = crops.groupBy("clip").agg(F.count_if(F.col("team") == 0).alias("a"), F.count_if(F.col("team") == 1).alias("b"))
    sizes = sizes.withColumn("weight", F.least("a", "b") * (F.col("a") + F.col("b")))
    total = sizes.agg(F.sum("weight")).first()[0] or 0  # one number
    d = draws.select("draw", *[chance(F.lit(seed), F.lit(k), "draw").alias(k) for k in ("c", "t", "p", "q", "r", "g")])
    d = d.withColumn("c", F.col("c") % F.lit(max(total, 1)))
    d = choose(d, "c", intervals(sizes, "weight", ["clip"]), total, buckets).withColumn("team", F.col("t") % 2)
    own, other = F.when(F.col("team") == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("team") == 0, F.col("b")).otherwise(F.col("a"))
    d = d.where(own >= 2).withColumn("i", F.try_mod("p", own)).withColumn("j", F.try_mod("q", own - 1)).withColumn("k", F.try_mod("r", other))
    d = d.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("bigint"))
    roster = running_sum(crops.withColumn("one", F.lit(1)), ["clip", "team"], ["crop"], "one", "place").select("clip", F.col("team").cast("bigint").alias("side"), "crop", F.col("place") - 1)
    roster = roster.toDF("clip", "side", "crop", "place")

    def seat(d: DataFrame, side: Column, place: str, name: str) -> DataFrame:
        r = roster.select(F.col("clip").alias("of"), "side", F.col("crop").alias(name), "place")
        return d.join(r, (d["clip"] == r["of"]) & (side == r["side"]) & (d[place] == r["place"])).drop("of", "side", "place")

    for side, place, name in ((F.col("team"), "i", "anchor"), (F.col("team"), "j", "positive"), (1 - F.col("team"), "k", "negative")):
        d = seat(d, side, place, name)
    return d.select("draw", "clip", "team", "anchor", "positive", "negative", (F.col("g") % 2 == 0).alias("grey"))
