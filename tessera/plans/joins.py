"""Joins (J) and set operations (U) over the detections view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import entities as N
from ..operators import tracks as O
from ..operators.bitmaps import frame_words, frames_of, merge_words
from ..operators.grid import overlapping
from ..sources import detections as S
from .base import det_plan, plan, read

#: Poses derived from detections: two per frame-sharing box, moved by a few pixels.
_POSE = "SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS pose_idx, x1 + k % 9 AS x1, y1 + k % 5 AS y1, x2 + k % 9 AS x2, y2 + k % 5 AS y2 FROM det WHERE class_id = 0 AND k % 3 <> 0"
_IOU = "(greatest(least(d.x2, p.x2) - greatest(d.x1, p.x1), 0) * greatest(least(d.y2, p.y2) - greatest(d.y1, p.y1), 0))"
_IOU = f"CAST({_IOU} AS DOUBLE) / (greatest(0, (d.x2 - d.x1) * (d.y2 - d.y1)) + (p.x2 - p.x1) * (p.y2 - p.y1) - {_IOU} + 0.000001::DOUBLE)"


def poses(det: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("frame").orderBy("event_id")) - 1
    p = det.where("class_id = 0 and k % 3 <> 0").withColumn("pose_idx", at)
    return p.selectExpr("frame", "pose_idx", "x1 + k % 9 as px1", "y1 + k % 5 as py1", "x2 + k % 9 as px2", "y2 + k % 5 as py2")


def spatial_top1(boxes: DataFrame, poses: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """For each box the pose of its frame that overlaps it most, if by more than ``least``; of equals the first."""
    box, pose = ["x1", "y1", "x2", "y2"], ["px1", "py1", "px2", "py2"]
    d = boxes.select("event_id", *keys, *[F.col(c).cast("double").alias(c) for c in box])
    p = poses.select(*keys, "pose_idx", *[F.col(c).cast("double").alias(c) for c in pose])
    j = overlapping(d, p, keys, box, pose, least).withColumn("iou", E.iou(box, pose))
    return O.top_n(j, ["event_id"], [F.desc("iou"), F.col("pose_idx")], 1).where(F.col("iou") > least)


@det_plan("j01_spatial_top1", f"@DET, p AS ({_POSE}), j AS (SELECT d.event_id, p.pose_idx, {_IOU} AS iou FROM det d JOIN p ON d.frame = p.frame WHERE d.class_id = 0 AND d.track_id >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY iou DESC, pose_idx) AS rn FROM j) SELECT event_id, pose_idx FROM r WHERE rn = 1 AND iou > 0.5")
def j01(det: DataFrame) -> DataFrame:
    return spatial_top1(S.tracked(det), poses(det), ["frame"]).select("event_id", F.col("pose_idx").cast("bigint").alias("pose_idx"))


@det_plan("j02_frame_worklist", "@DET, w AS (SELECT DISTINCT frame FROM det WHERE k = 7) SELECT d.event_id, d.frame FROM det d JOIN w ON d.frame = w.frame")
def j02(det: DataFrame) -> DataFrame:
    return det.join(det.where("k = 7").select("frame").distinct(), "frame").select("event_id", "frame")


@det_plan("j03_pose_cache", f"@DET, p AS ({_POSE}), f AS (SELECT frame, frame % 4 <> 1 AS has_pose FROM (SELECT DISTINCT frame FROM det) WHERE frame % 5 <> 2) SELECT CASE WHEN f.frame IS NULL THEN 'infer' WHEN f.has_pose THEN 'use' ELSE 'none' END AS route, count(*) AS n FROM det d LEFT JOIN f ON d.frame = f.frame GROUP BY 1")
def j03(det: DataFrame) -> DataFrame:
    cache = det.select("frame").distinct().where("frame % 5 <> 2").withColumn("has_pose", F.col("frame") % 4 != 1)
    route = F.when(F.col("has_pose").isNull(), "infer").when(F.col("has_pose"), "use").otherwise("none")
    return det.join(cache, "frame", "left").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@det_plan("j04_team_attributes", "@DET, t AS (SELECT track_id, min(team_id) AS team_id, max(conf_c) AS conf_c FROM det WHERE k > 40 AND track_id >= 0 GROUP BY track_id) SELECT u.track_id, t.team_id, coalesce(t.conf_c, 0) AS conf_c FROM (SELECT DISTINCT track_id FROM det WHERE track_id >= 0) u LEFT JOIN t ON u.track_id = t.track_id")
def j04(det: DataFrame) -> DataFrame:
    t = det.where("k > 40 and track_id >= 0").groupBy("track_id").agg(F.min("team_id").alias("team_id"), F.max("conf_c").alias("conf_c"))
    return det.where("track_id >= 0").select("track_id").distinct().join(t, "track_id", "left").select("track_id", "team_id", F.coalesce("conf_c", F.lit(0)).alias("conf_c"))


@det_plan("j05_triangular_pairs", "@DET, t AS (SELECT DISTINCT user_id, track_id FROM det WHERE class_id = 0 AND track_id >= 0) SELECT l.user_id, l.track_id AS a, r.track_id AS b FROM t l JOIN t r ON l.user_id = r.user_id AND l.track_id < r.track_id")
def j05(det: DataFrame) -> DataFrame:
    t = S.tracked(det).select("user_id", "track_id").distinct()
    return t.alias("l").join(t.alias("r"), "user_id").where("l.track_id < r.track_id").select("user_id", F.col("l.track_id").alias("a"), F.col("r.track_id").alias("b"))


_SHARED = "f AS (SELECT DISTINCT run_id, frame // 10 AS frame, track_id FROM det WHERE class_id = 0 AND track_id >= 0), s AS (SELECT l.run_id, l.track_id AS a, r.track_id AS b, count(*) AS shared FROM f l JOIN f r ON l.run_id = r.run_id AND l.frame = r.frame AND l.track_id < r.track_id GROUP BY 1, 2, 3)"


@det_plan("j06_anti_overlap", f"@DET, {_SHARED} SELECT run_id, a, b, shared, shared <= 2 AS admissible FROM s")
def j06(det: DataFrame) -> DataFrame:
    s = N.shared_frames(S.tracked(det).withColumn("frame", F.expr("frame div 10")), ["run_id"])
    return s.withColumn("admissible", F.col("shared") <= N.OVERLAP)


def track_table(det: DataFrame) -> DataFrame:
    """One row for each track: team, number, goalie and confidence, some of them unknown."""
    t = S.tracked(det).groupBy("user_id", "track_id").agg(F.min("team_id").alias("t"), F.count("*").alias("n"), F.max("conf_c").alias("c"), F.min("num").alias("num"))
    return t.selectExpr(
        "user_id", "track_id", "case when n % 5 <> 0 then t end as team", "case when n % 3 <> 0 then num end as number", "c / 10000D as number_conf", "n % 4 = 0 as goalie",
        "transform(sequence(1, 4), i -> cast((track_id * i + n) % 7 as double) / 14D) as vec",
    )


_TRACKS = "t AS (SELECT user_id, track_id, CASE WHEN n % 5 <> 0 THEN t END AS team, CASE WHEN n % 3 <> 0 THEN num END AS number, CAST(c AS DOUBLE) / 10000 AS number_conf, n % 4 = 0 AS goalie, list_transform(range(1, 5), lambda i: CAST((track_id * i + n) % 7 AS DOUBLE) / 14) AS vec FROM (SELECT user_id, track_id, min(team_id) AS t, count(*) AS n, max(conf_c) AS c, min(num) AS num FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY user_id, track_id))"
_PAIRS = "p AS (SELECT l.user_id, l.track_id AS a, r.track_id AS b, l.team AS lt, r.team AS rt, l.number AS ln, r.number AS rn, l.number_conf AS lc, r.number_conf AS rc, l.goalie AS lg, r.goalie AS rg, list_inner_product(l.vec, r.vec) AS sim FROM t l JOIN t r ON l.user_id = r.user_id AND l.track_id < r.track_id)"
_CONFLICT = "coalesce(ln <> rn AND lt = rt AND lc >= 0.4 AND rc >= 0.4, FALSE)"
_WEIGHT = "sim + (CASE WHEN coalesce(ln = rn, FALSE) AND (lt IS NULL OR rt IS NULL OR lt = rt) THEN 10.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN lg AND rg THEN 0.05 ELSE 0.0 END)::DOUBLE + (CASE WHEN lt IS NULL OR rt IS NULL THEN -0.15 WHEN lt <> rt THEN -0.3 ELSE 0.0 END)::DOUBLE"


@det_plan("j07_number_conflict", f"@DET, {_TRACKS}, {_PAIRS} SELECT user_id, a, b FROM p WHERE NOT {_CONFLICT}")
def j07(det: DataFrame) -> DataFrame:
    t = track_table(det)
    p = t.alias("l").join(t.alias("r"), F.expr("l.user_id = r.user_id and l.track_id < r.track_id")).where(~N.conflict())
    return p.select("l.user_id", F.col("l.track_id").alias("a"), F.col("r.track_id").alias("b"))


@det_plan("j17_edge_weight", f"@DET, {_TRACKS}, {_PAIRS} SELECT user_id, a, b, CAST(round(({_WEIGHT}) * 1000000) AS BIGINT) AS w FROM p")
def j17(det: DataFrame) -> DataFrame:
    t = track_table(det)
    p = t.alias("l").join(t.alias("r"), F.expr("l.user_id = r.user_id and l.track_id < r.track_id"))
    w = N.pair_weight(E.dot("l.vec", "r.vec"))
    return p.select("l.user_id", F.col("l.track_id").alias("a"), F.col("r.track_id").alias("b"), F.round(w * 1000000).cast("bigint").alias("w"))


@det_plan("j08_hierarchical_resolve", "@DET, e AS (SELECT user_id AS eid, CASE WHEN user_id % 3 <> 0 THEN user_id % 2 END AS team, CASE WHEN user_id % 4 <> 0 THEN CAST(user_id % 40 AS VARCHAR) END AS number FROM (SELECT DISTINCT user_id FROM det WHERE user_id % 5 <> 0)), t AS (SELECT track_id, user_id, min(team_id) AS team, min(num) AS number FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY track_id, user_id) SELECT t.track_id, coalesce(e.team, t.team, 0) AS team, CASE WHEN e.eid IS NOT NULL THEN e.number ELSE t.number END AS number FROM t LEFT JOIN e ON t.user_id = e.eid")
def j08(det: DataFrame) -> DataFrame:
    e = det.where("user_id % 5 <> 0").select("user_id").distinct()
    e = e.selectExpr("user_id", "true as known", "case when user_id % 3 <> 0 then user_id % 2 end as e_team", "case when user_id % 4 <> 0 then cast(user_id % 40 as string) end as e_number")
    t = S.tracked(det).groupBy("track_id", "user_id").agg(F.min("team_id").alias("team"), F.min("num").alias("number"))
    j = t.join(e, "user_id", "left")
    return j.select("track_id", F.coalesce("e_team", "team", F.lit(0)).alias("team"), F.when(F.col("known"), F.col("e_number")).otherwise(F.col("number")).alias("number"))


_ENGINES = "a AS (SELECT track_id, min(team_id) AS team FROM det WHERE track_id >= 0 GROUP BY track_id), b AS (SELECT track_id, CASE WHEN sum(k) % 5 = 0 THEN min(team_id) ELSE 1 - min(team_id) END AS team FROM det WHERE track_id >= 0 AND k > 20 GROUP BY track_id)"


def engines(det: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two engines' labels of tracks; the second mostly says the opposite."""
    a = det.where("track_id >= 0").groupBy("track_id").agg(F.min("team_id").alias("team"))
    b = det.where("track_id >= 0 and k > 20").groupBy("track_id").agg(F.expr("case when sum(k) % 5 = 0 then min(team_id) else 1 - min(team_id) end").alias("team"))
    return a, b


@det_plan("j09_label_alignment", f"@DET, {_ENGINES} SELECT same, swap, swap > same AS flip FROM (SELECT sum((a.team = b.team)::INT)::BIGINT AS same, sum((a.team <> b.team)::INT)::BIGINT AS swap FROM a JOIN b ON a.track_id = b.track_id)")
def j09(det: DataFrame) -> DataFrame:
    return O.align_flip(*engines(det))


@det_plan("j10_truth_prediction", f"@DET, {_ENGINES} SELECT a.track_id, coalesce(a.team = b.team, FALSE) AS correct FROM a LEFT JOIN b ON a.track_id = b.track_id")
def j10(det: DataFrame) -> DataFrame:
    a, b = engines(det)
    return a.join(b.withColumnRenamed("team", "said"), "track_id", "left").select("track_id", F.coalesce(F.col("team") == F.col("said"), F.lit(False)).alias("correct"))


@plan("j11_catalogue_annotations", "SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS annotated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    marks = read(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return read(spark, sf, "documents").select("doc_id").join(marks, "doc_id", "left").select("doc_id", "quality", F.coalesce("there", F.lit(False)).alias("annotated"))


@plan("j12_edge_semijoin", "SELECT o_orderkey AS source, o_custkey AS target FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose both ends are nodes; others are dropped."""
    e = read(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    left = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("source"))
    right = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target"))
    return e.join(left, "source", "left_semi").join(right, "target", "left_semi")


@plan("j13_existence", "SELECT sum((l.doc_id IS NOT NULL)::INT)::BIGINT AS found, sum((l.doc_id IS NULL)::INT)::BIGINT AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    d, l = read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id")
    found, missing = d.join(l, "doc_id", "left_semi").withColumn("hit", F.lit(1)), d.join(l, "doc_id", "left_anti").withColumn("hit", F.lit(0))
    return found.union(missing).agg(F.count_if(F.col("hit") == 1).alias("found"), F.count_if(F.col("hit") == 0).alias("missing"))


@det_plan("j14_eligible_truth", "@DET, t AS (SELECT run_id, team_id, count(DISTINCT track_id) AS tracks FROM det WHERE track_id >= 0 AND k % 7 = 0 GROUP BY run_id, team_id) SELECT run_id FROM t WHERE tracks >= 2 GROUP BY run_id HAVING count(*) >= 1")
def j14(det: DataFrame) -> DataFrame:
    t = det.where("track_id >= 0 and k % 7 = 0").groupBy("run_id", "team_id").agg(F.countDistinct("track_id").alias("tracks"))
    return t.where("tracks >= 2").groupBy("run_id").agg(F.count("*").alias("teams")).where("teams >= 1").select("run_id")


@det_plan("j15_asof", "@DET, g AS (SELECT track_id, frame, event_id, lead(frame) OVER (PARTITION BY track_id ORDER BY frame, event_id) AS nxt FROM det WHERE class_id = 0 AND track_id >= 0), q AS (SELECT track_id, frame + 2 AS at FROM det WHERE k = 50 AND track_id >= 0) SELECT q.track_id, q.at, max(g.event_id) AS event_id FROM q JOIN g ON q.track_id = g.track_id AND g.frame <= q.at AND (g.nxt IS NULL OR g.nxt > q.at) AND q.at - g.frame < 3 GROUP BY 1, 2")
def j15(det: DataFrame) -> DataFrame:
    """The last detection at or before a frame, if it is less than a stride back; queries and records share one sorted pass."""
    from pyspark.sql import Window as W

    rec = S.tracked(det).select("track_id", "frame", F.col("event_id").alias("rec"), F.lit(0).alias("ask"))
    ask = det.where("k = 50 and track_id >= 0").select("track_id", (F.col("frame") + 2).alias("frame"), F.lit(None).cast("bigint").alias("rec"), F.lit(1).alias("ask"))
    w = W.partitionBy("track_id").orderBy("frame", "ask", "rec")
    last = F.last(F.when(F.col("ask") == 0, F.struct("frame", "rec")), ignorenulls=True).over(w)
    both = rec.union(ask).withColumn("last", last).where("ask = 1 and frame - last.frame < 3")
    return both.groupBy("track_id", F.col("frame").alias("at")).agg(F.max("last.rec").alias("event_id"))


@det_plan("u01_difference", "@DET SELECT DISTINCT track_id FROM det WHERE track_id >= 0 AND class_id = 0 EXCEPT SELECT track_id FROM det WHERE class_name = 'goaltender'")
def u01(det: DataFrame) -> DataFrame:
    return S.tracked(det).select("track_id").distinct().join(det.where("class_name = 'goaltender'").select("track_id"), "track_id", "left_anti")


@det_plan("u02_intersection", "@DET SELECT track_id FROM det WHERE class_id = 0 AND track_id >= 0 INTERSECT SELECT track_id FROM det WHERE k > 90")
def u02(det: DataFrame) -> DataFrame:
    return S.tracked(det).select("track_id").intersect(det.where("k > 90").select("track_id"))


@det_plan("u03_frame_union", "@DET SELECT DISTINCT frame FROM (SELECT frame FROM det WHERE k < 5 UNION SELECT frame FROM det WHERE k > 95)")
def u03(det: DataFrame) -> DataFrame:
    a, b = (frame_words(det.where(c), []) for c in ("k < 5", "k > 95"))
    return frames_of(merge_words(a.union(b), []))


@det_plan("u04_needed_frames", "@DET SELECT DISTINCT frame FROM (SELECT frame, row_number() OVER (PARTITION BY track_id ORDER BY conf_c DESC, frame, event_id) rn FROM det WHERE class_id = 0 AND track_id >= 0) WHERE rn <= 3")
def u04(det: DataFrame) -> DataFrame:
    return O.top_n(S.tracked(det), ["track_id"], [F.desc("conf_c"), F.col("frame"), F.col("event_id")], 3).select("frame").distinct()


@det_plan("u05_keyed_merge", "@DET, o AS (SELECT track_id, min(num) AS v FROM det WHERE k < 60 AND track_id >= 0 GROUP BY track_id), n AS (SELECT track_id, max(num) AS v FROM det WHERE k > 40 AND track_id >= 0 GROUP BY track_id) SELECT coalesce(n.track_id, o.track_id) AS track_id, coalesce(n.v, o.v) AS v, CASE WHEN o.track_id IS NULL THEN 'added' WHEN n.track_id IS NULL THEN 'kept' ELSE 'replaced' END AS what FROM o FULL OUTER JOIN n ON o.track_id = n.track_id")
def u05(det: DataFrame) -> DataFrame:
    """A merge by key in which the new side wins."""
    o = det.where("k < 60 and track_id >= 0").groupBy("track_id").agg(F.min("num").alias("old"))
    n = det.where("k > 40 and track_id >= 0").groupBy("track_id").agg(F.max("num").alias("new"))
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("replaced")
    return o.join(n, "track_id", "full_outer").select("track_id", F.coalesce("new", "old").alias("v"), what.alias("what"))


@det_plan("u06_referee_overlap", "@DET SELECT count(*) AS both_say FROM (SELECT DISTINCT track_id FROM det WHERE user_id % 25 = 0 AND track_id >= 0) WHERE track_id IN (SELECT track_id FROM det WHERE k > 50)")
def u06(det: DataFrame) -> DataFrame:
    t = det.where("user_id % 25 = 0 and track_id >= 0").select("track_id").distinct()
    return t.join(det.where("k > 50").select("track_id"), "track_id", "left_semi").agg(F.count("*").alias("both_say"))


@plan("u07_node_union", "SELECT id, min_by(src, pri) AS src FROM (SELECT n_name AS id, 'nation' AS src, 0 AS pri FROM nation UNION ALL SELECT r_name, 'region', 1 FROM region UNION ALL SELECT DISTINCT c_mktsegment, 'segment', 2 FROM customer) GROUP BY id")
def u07(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of several layers; the first layer that has one wins."""
    layers = [("nation", "n_name", "nation"), ("region", "r_name", "region"), ("customer", "c_mktsegment", "segment")]
    parts = [read(spark, sf, t).select(F.col(c).alias("id"), F.lit(n).alias("src"), F.lit(i).alias("pri")).distinct() for i, (t, c, n) in enumerate(layers)]
    return O.top_n(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["id"], [F.col("pri")], 1).select("id", "src")


@det_plan("u08_complement", "@DET SELECT kp FROM (SELECT unnest(range(0, 56)) AS kp) WHERE kp NOT IN (SELECT k FROM det WHERE conf_c > 40000)")
def u08(det: DataFrame) -> DataFrame:
    every = det.sparkSession.range(56).withColumnRenamed("id", "kp")
    return every.join(det.where("conf_c > 40000").select(F.col("k").alias("kp")), "kp", "left_anti")
