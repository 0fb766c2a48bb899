"""Projections, filters and predicates (P), scans (S) and sinks (K) over the detections view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E
from ..operators import tracks as O
from ..sources import detections as S
from .base import det_plan, plan, read

#: native class -> class and name (fixed values)
CLASSES = [(3, 0, "goaltender"), (4, 0, "player"), (5, 32, "puck")]
WIDTH, HEIGHT = 1000, 550


@det_plan("s01_needed_frames", "@DET, n AS (SELECT DISTINCT frame FROM (SELECT frame, row_number() OVER (PARTITION BY track_id ORDER BY conf_c DESC, frame, event_id) rn FROM det WHERE class_id = 0 AND track_id >= 0) WHERE rn <= 2) SELECT frame, count(*) AS n FROM det WHERE frame IN (SELECT frame FROM n) GROUP BY frame")
def needed(det: DataFrame) -> DataFrame:
    want = O.top_n(S.tracked(det), ["track_id"], [F.desc("conf_c"), F.col("frame"), F.col("event_id")], 2).select("frame").distinct()
    return S.needed_frames(det, want).groupBy("frame").agg(F.count("*").alias("n"))


@det_plan("s02_sample_frames", "@DET, t AS (SELECT run_id, count(*) AS total FROM det GROUP BY run_id) SELECT run_id, total, i, CAST(floor(i * (total - 1) / 8.0) AS BIGINT) AS frame FROM t, (SELECT unnest([0,1,2,3,4,5,6,7,8]) AS i)")
def sampled(det: DataFrame) -> DataFrame:
    return S.sample_frames(det.groupBy("run_id").agg(F.count("*").alias("total")), 9)


@det_plan("s03_scan_options", "@DET SELECT event_id, frame, class_id, conf_c FROM det WHERE class_id IN (0, 32) AND conf_c >= 3000 AND frame % 2 = 0")
def scan(det: DataFrame) -> DataFrame:
    return S.scan(det, [0, 32], F.lit(3000), 2).select("event_id", "frame", "class_id", "conf_c")


_DOCUMENTS = "@DET SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY event_id) - 1 AS box_pos, CAST(class_id AS BIGINT) AS class_id, class_name, track_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(conf_c AS DOUBLE) / 100 AS conf FROM det"


@det_plan("s04_document_files", _DOCUMENTS)
def document_files(det: DataFrame) -> DataFrame:
    """The documents written as text, one a line, and read by the source."""
    from ..operators.store import shared_path

    path = shared_path(det.sparkSession, "documents")
    S.to_documents(det).select("doc").write.text(path)
    return S.read_documents(det.sparkSession, path, whole=False).withColumn("box_pos", F.col("box_pos").cast("bigint"))


@det_plan("s04_documents_scan", _DOCUMENTS)
def documents(det: DataFrame) -> DataFrame:
    return S.from_documents(S.to_documents(det)).withColumn("box_pos", F.col("box_pos").cast("bigint"))


@plan("s05_optional_scan", "@DET SELECT track_id, count(*) AS n, 0 AS team_id FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY track_id")
def optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = S.read_optional(spark, f"{sf_dir}/teams.parquet", T.StructType([T.StructField("track_id", T.LongType()), T.StructField("team", T.IntegerType())]))
    t = S.tracked(S.detections(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("n"))
    return t.join(teams, "track_id", "left").select("track_id", "n", F.coalesce("team", F.lit(0)).alias("team_id"))


@det_plan("s07_crop_paths", "@DET SELECT event_id, track_id, frame, num AS number, conf_c % 100 AS conf FROM det WHERE track_id >= 0")
def crop_paths(det: DataFrame) -> DataFrame:
    path = F.format_string("run/debug_crops/numbers/t%04d_f%05d_num-%s_c%02d.png", "track_id", "frame", "num", F.col("conf_c") % 100)
    p = det.where("track_id >= 0").select("event_id", path.alias("path"))
    part = lambda i: F.regexp_extract("path", r"t(\d+)_f(\d+)_(num|nam)-([^_]+)_c(\d+)\.png$", i)
    return p.select("event_id", part(1).cast("bigint").alias("track_id"), part(2).cast("bigint").alias("frame"), part(4).alias("number"), part(5).cast("bigint").alias("conf"))


@det_plan("s08_track_thumbs", "@DET SELECT run_id, track_id, count(*) AS thumbs FROM (SELECT run_id, track_id, row_number() OVER (PARTITION BY track_id ORDER BY conf_c DESC, frame, event_id) rn FROM det WHERE class_id = 0 AND track_id >= 0) WHERE rn <= 6 GROUP BY run_id, track_id")
def thumbs(det: DataFrame) -> DataFrame:
    t = O.top_n(S.tracked(det), ["track_id"], [F.desc("conf_c"), F.col("frame"), F.col("event_id")], 6)
    files = t.select(F.format_string("%d/t%04d_%d.png", "run_id", "track_id", "rn").alias("path"))
    keys = files.select(F.split("path", "/")[0].cast("bigint").alias("run_id"), F.regexp_extract("path", r"/t(\d+)_", 1).cast("bigint").alias("track_id"))
    return S.tracked(det).select("run_id", "track_id").distinct().join(keys, ["run_id", "track_id"]).groupBy("run_id", "track_id").agg(F.count("*").alias("thumbs"))


#: Trackers' settings (fixed values).
TRACKERS = [("bytetrack_tuned", 0.25, 0.1, 0.25, 180, 0.9, None, None), ("botsort_reid", 0.25, 0.1, 0.25, 180, 0.9, 0.5, 0.7)]


_TRACKERS = "(VALUES ('bytetrack_tuned', 0.25::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 180, 0.9::DOUBLE, NULL::DOUBLE, NULL::DOUBLE), ('botsort_reid', 0.25::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE, 180, 0.9::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE)) AS t(tracker, high, low, fresh, buffer, match, proximity, appearance)"


@det_plan("s09_tracker_configs", f"@DET SELECT t.*, d.run_id, sum((conf_c % 100 >= t.high * 100)::INT)::BIGINT AS first_round, sum((conf_c % 100 >= t.low * 100 AND conf_c % 100 < t.high * 100)::INT)::BIGINT AS second_round, sum((conf_c % 100 < t.low * 100)::INT)::BIGINT AS dropped, sum((conf_c % 100 >= t.fresh * 100)::INT)::BIGINT AS may_begin FROM det d, {_TRACKERS} GROUP BY ALL")
def trackers(det: DataFrame) -> DataFrame:
    """How each tracker's settings would deal the boxes of a run to its rounds of association."""
    t = det.sparkSession.createDataFrame(TRACKERS, "tracker string, high double, low double, fresh double, buffer int, match double, proximity double, appearance double")
    counted = det.groupBy("run_id", (F.col("conf_c") % 100).alias("conf")).agg(F.count("*").alias("n"))
    d = counted.crossJoin(F.broadcast(t))  # two rows of settings
    n = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)).alias
    return d.groupBy(*t.columns, "run_id").agg(
        n("conf >= high * 100")("first_round"), n("conf >= low * 100 and conf < high * 100")("second_round"), n("conf < low * 100")("dropped"), n("conf >= fresh * 100")("may_begin")
    )


@det_plan("s10_command_parse", "@DET SELECT CASE WHEN event_id % 11 = 0 THEN 400 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status, count(*) AS n FROM det GROUP BY 1")
def commands(det: DataFrame) -> DataFrame:
    body = F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit("A").alias("team"), F.lit(1).alias("delta"))))
    path = F.when(F.col("event_id") % 7 == 0, "/nowhere").otherwise("/score")
    from ..streaming.scoreboard import parse_commands

    return parse_commands(det.select("event_id", path.alias("path"), body.alias("body"))).groupBy("status").agg(F.count("*").alias("n"))


@det_plan("s13_source_paths", "@DET, f AS (SELECT run_id, min('v/' || CAST(event_id AS VARCHAR)) AS listed FROM det WHERE k > 95 GROUP BY run_id) SELECT u.run_id, coalesce(CASE WHEN u.run_id % 2 = 0 THEN 'rec/' || CAST(u.run_id AS VARCHAR) END, f.listed) AS path FROM (SELECT DISTINCT run_id FROM det) u LEFT JOIN f ON u.run_id = f.run_id")
def sources(det: DataFrame) -> DataFrame:
    listed = det.where("k > 95").groupBy("run_id").agg(F.min(F.concat(F.lit("v/"), F.col("event_id").cast("string"))).alias("listed"))
    runs = det.select("run_id").distinct().withColumn("recorded", F.expr("case when run_id % 2 = 0 then concat('rec/', run_id) end"))
    return runs.join(listed, "run_id", "left").select("run_id", F.coalesce("recorded", "listed").alias("path"))


@det_plan("k01_json_export", "@DET SELECT track_id, '{\"track_id\":' || track_id || ',\"n\":' || count(*) || '}' AS doc FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY track_id")
def export(det: DataFrame) -> DataFrame:
    t = S.tracked(det).groupBy("track_id").agg(F.count("*").alias("n"))
    return t.select("track_id", F.to_json(F.struct("track_id", "n")).alias("doc"))


@det_plan("k03_debug_frames", "@DET SELECT frame, count(*) AS boxes FROM det WHERE frame % 30 = 0 GROUP BY frame")
def debug_frames(det: DataFrame) -> DataFrame:
    return det.where("frame % 30 = 0").groupBy("frame").agg(F.count("*").alias("boxes"))


@det_plan("k06_bench_report", "@DET SELECT run_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS view FROM det GROUP BY run_id")
def report(det: DataFrame) -> DataFrame:
    p = det.groupBy("run_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)))
    return p.select("run_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


@det_plan("k08_graph_payload", "@DET SELECT event_id, replace('{\"label\":\"</' || num || '\"}', '</', '<\\/') AS payload FROM det")
def escaped(det: DataFrame) -> DataFrame:
    doc = F.concat(F.lit('{"label":"</'), F.col("num"), F.lit('"}'))
    return det.select("event_id", F.replace(doc, F.lit("</"), F.lit("<\\/")).alias("payload"))


@det_plan("k10_stub_marker", "@DET SELECT 'stub' AS status, count(*) AS inputs FROM det")
def marker(det: DataFrame) -> DataFrame:
    return det.agg(F.count("*").alias("inputs")).select(F.lit("stub").alias("status"), "inputs")


@det_plan("k11_copy_paths", "@DET SELECT event_id, 'crops/' || num || '/' || event_id || '.png' AS target FROM det WHERE num IS NOT NULL")
def copies(det: DataFrame) -> DataFrame:
    return paths(det.where("num is not null"))


def paths(det: DataFrame) -> DataFrame:
    return det.select("event_id", F.concat_ws("/", F.lit("crops"), "num", F.concat(F.col("event_id").cast("string"), F.lit(".png"))).alias("target"))


@det_plan("p01_class_remap", "@DET SELECT event_id, CASE k % 7 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 32 END AS class_id, CASE k % 7 WHEN 3 THEN 'goaltender' WHEN 4 THEN 'player' ELSE 'puck' END AS class_name FROM det WHERE k % 7 IN (3, 4, 5)")
def remap(det: DataFrame) -> DataFrame:
    native = det.select("event_id", (F.col("k") % 7).cast("int").alias("native"))
    return O.remap_classes(native, CLASSES).select("event_id", "class_id", "class_name")


@det_plan("p02_tracked_persons", "@DET SELECT event_id, track_id, frame FROM det WHERE class_id = 0 AND track_id >= 0")
def persons(det: DataFrame) -> DataFrame:
    return S.tracked(det).select("event_id", "track_id", "frame")


@det_plan("p03_unnest_boxes", "@DET SELECT frame, count(*) AS boxes, sum(x1)::BIGINT AS x FROM det GROUP BY frame")
def unnest(det: DataFrame) -> DataFrame:
    return S.from_documents(S.to_documents(det)).groupBy("frame").agg(F.count("*").alias("boxes"), F.sum("x1").cast("bigint").alias("x"))


@det_plan("p04_stride", "@DET SELECT event_id, greatest(1, CAST(round_even((20 + k) / greatest((5 + user_id % 30)::DOUBLE, 0.001::DOUBLE), 0) AS BIGINT)) AS stride FROM det")
def strides(det: DataFrame) -> DataFrame:
    return det.select("event_id", E.stride(F.col("k") + 20, (F.col("user_id") % 30 + 5).cast("double")).alias("stride"))


@det_plan("p05_frame_index", "@DET SELECT event_id, (frame // 2) * 2 AS source_frame FROM det")
def index(det: DataFrame) -> DataFrame:
    return det.select("event_id", F.expr("(frame div 2) * 2").alias("source_frame"))


@det_plan("p06_modulo_sample", "@DET SELECT event_id, frame FROM det WHERE frame % 15 = 0")
def modulo(det: DataFrame) -> DataFrame:
    return det.where("frame % 15 = 0").select("event_id", "frame")


@det_plan("p07_confidence_floors", "@DET SELECT sum((conf_c >= 3000)::INT)::BIGINT AS ocr, sum((conf_c >= 5000)::INT)::BIGINT AS team, sum((conf_c >= 4000)::INT)::BIGINT AS conflict, sum((conf_c > 3000)::INT)::BIGINT AS keypoint, sum((conf_c > 5000)::INT)::BIGINT AS ref FROM det")
def floors(det: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return det.agg(n("conf_c >= 3000").alias("ocr"), n("conf_c >= 5000").alias("team"), n("conf_c >= 4000").alias("conflict"), n("conf_c > 3000").alias("keypoint"), n("conf_c > 5000").alias("ref"))


#: Keypoint confidences derived from a detection, 0 to 0.9 in tenths.
KEYPOINTS = "transform(sequence(0, 16), i -> cast((k * (i + 3) + user_id) % 10 as double) / 10)"
KEYPOINTS_SQL = "list_transform(range(0, 17), lambda i: CAST((k * (i + 3) + user_id) % 10 AS DOUBLE) / 10)"
_FACE = "CASE WHEN NOT (c[6] > 0.3 AND c[7] > 0.3) THEN 'unknown' WHEN c[1] > 0.3 AND (c[2] > 0.3 OR c[3] > 0.3) THEN 'front' WHEN (c[4] > 0.3 OR c[5] > 0.3) AND NOT c[1] > 0.3 THEN 'back' ELSE 'side' END"


@det_plan("p08_orientation", f"@DET, p AS (SELECT event_id, {KEYPOINTS_SQL} AS c FROM det) SELECT event_id, {_FACE} AS facing FROM p")
def facing(det: DataFrame) -> DataFrame:
    return det.select("event_id", F.expr(KEYPOINTS).alias("c")).select("event_id", E.orientation("c").alias("facing"))


@det_plan("p09_back_gate", f"@DET, p AS (SELECT event_id, x2 - x1 - 40 AS w, y2 - y1 - 80 AS h, {KEYPOINTS_SQL} AS c FROM det) SELECT event_id, w, h FROM p WHERE {_FACE} = 'back' AND least(w, h) >= 16")
def gate(det: DataFrame) -> DataFrame:
    p = det.select("event_id", F.expr("x2 - x1 - 40").alias("w"), F.expr("y2 - y1 - 80").alias("h"), F.expr(KEYPOINTS).alias("c"))
    return p.where((E.orientation("c") == "back") & (F.least("w", "h") >= 16)).select("event_id", "w", "h")


@det_plan("p10_safe_crop", f"@DET, c AS (SELECT event_id, greatest(0, trunc(x1 - 20.5::DOUBLE)::BIGINT) AS cx1, greatest(0, trunc(y1 - 20.5::DOUBLE)::BIGINT) AS cy1, least({WIDTH}, trunc(x2 - 20.5::DOUBLE)::BIGINT) AS cx2, least({HEIGHT}, trunc(y2 - 20.5::DOUBLE)::BIGINT) AS cy2 FROM det) SELECT * FROM c WHERE cx2 > cx1 + 4 AND cy2 > cy1 + 4")
def crop(det: DataFrame) -> DataFrame:
    box = [F.col(c) - F.lit(20.5) for c in ("x1", "y1", "x2", "y2")]
    return O.safe_crop(det.select("event_id", "x1", "y1", "x2", "y2"), box, WIDTH, HEIGHT).select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("cx1", "cy1", "cx2", "cy2")])


#: Shoulders and hips of a detection, as (left x, left y, right x, right y).
SHO = ("x1 + 5e0", "y1 + 10e0", "x2 - 5e0 - k % 3", "y1 + 12e0")
HIP = ("x1 + 8e0", "y2 - 10e0", "x2 - 8e0", "y2 - 12e0")
_POINTS = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip((*SHO, *HIP), ("lsx", "lsy", "rsx", "rsy", "lhx", "lhy", "rhx", "rhy")))


def _points(det: DataFrame) -> DataFrame:
    names = ("lsx", "lsy", "rsx", "rsy", "lhx", "lhy", "rhx", "rhy")
    return det.select("event_id", (F.col("k") % 2 == 0).alias("hips"), *[F.expr(e).cast("double").alias(n) for e, n in zip((*SHO, *HIP), names)])


@det_plan("p11_pose_torso", f"@DET, p AS (SELECT event_id, k % 2 = 0 AS hips, {_POINTS} FROM det), q AS (SELECT event_id, (lsx + rsx) / 2 AS cx, (lsy + rsy) / 2 AS cy, abs(lsx - rsx) AS sw, hips, (lhy + rhy) / 2 AS hy FROM p) SELECT event_id, cx - sw * 0.7::DOUBLE AS tx1, cy - sw * 0.05::DOUBLE AS ty1, cx + sw * 0.7::DOUBLE AS tx2, CASE WHEN hips THEN hy ELSE cy + 2.0::DOUBLE * sw END AS ty2 FROM q")
def pose_torso(det: DataFrame) -> DataFrame:
    q = _points(det).selectExpr("event_id", "hips", "(lsx + rsx) / 2 as cx", "(lsy + rsy) / 2 as cy", "abs(lsx - rsx) as sw", "(lhy + rhy) / 2 as hy")
    return q.selectExpr("event_id", "cx - sw * 0.7D as tx1", "cy - sw * 0.05D as ty1", "cx + sw * 0.7D as tx2", "case when hips then hy else cy + 2D * sw end as ty2")


_TORSO = "SELECT event_id, {v!r} AS variant, greatest(0, trunc(x1 + {s}::DOUBLE * (x2 - x1))::BIGINT) AS cx1, greatest(0, trunc(y1 + {t}::DOUBLE * (y2 - y1))::BIGINT) AS cy1, least(1000, trunc(x2 - {s}::DOUBLE * (x2 - x1))::BIGINT) AS cx2, least(550, trunc(y1 + {b}::DOUBLE * (y2 - y1))::BIGINT) AS cy2 FROM det"


@det_plan("p12_bbox_torso", "@DET, c AS (" + _TORSO.format(v="team", s=0.25, t=0.15, b=0.45) + " UNION ALL " + _TORSO.format(v="annotate", s=0.0, t=0.1, b=0.4) + ") SELECT * FROM c WHERE cx2 > cx1 + 4 AND cy2 > cy1 + 4")
def bbox_torso(det: DataFrame) -> DataFrame:
    out = []
    for name, share in (("team", (0.15, 0.45, 0.25)), ("annotate", (0.1, 0.4, 0.0))):
        c = O.safe_crop(det, O.torso_boxes("x1", "y1", "x2", "y2", share), WIDTH, HEIGHT)
        out.append(c.select("event_id", F.lit(name).alias("variant"), *[F.col(k).cast("bigint").alias(k) for k in ("cx1", "cy1", "cx2", "cy2")]))
    return out[0].union(out[1])


@det_plan("p13_dorsal_crop", f"@DET, p AS (SELECT event_id, k % 2 = 0 AS hips, {_POINTS} FROM det), q AS (SELECT *, CASE WHEN hips THEN lhx ELSE lsx END AS ax, CASE WHEN hips THEN rhx ELSE rsx END AS bx, CASE WHEN hips THEN lhy ELSE (lsy + rsy) / 2 + 2.2::DOUBLE * abs(lsx - rsx) END AS ay, CASE WHEN hips THEN rhy ELSE (lsy + rsy) / 2 + 2.2::DOUBLE * abs(lsx - rsx) END AS by_ FROM p) SELECT event_id, least(lsx, rsx, ax, bx) - 5 AS dx1, least(lsy, rsy, ay, by_) - 5 AS dy1, greatest(lsx, rsx, ax, bx) + 5 AS dx2, greatest(lsy, rsy, ay, by_) AS dy2 FROM q")
def dorsal(det: DataFrame) -> DataFrame:
    p = _points(det)
    low = F.expr("(lsy + rsy) / 2 + 2.2D * abs(lsx - rsx)")
    xs = F.array("lsx", "rsx", F.expr("if(hips, lhx, lsx)"), F.expr("if(hips, rhx, rsx)"))
    ys = F.array("lsy", "rsy", F.when(F.col("hips"), F.col("lhy")).otherwise(low), F.when(F.col("hips"), F.col("rhy")).otherwise(low))
    return p.select("event_id", (F.array_min(xs) - 5).alias("dx1"), (F.array_min(ys) - 5).alias("dy1"), (F.array_max(xs) + 5).alias("dx2"), F.array_max(ys).alias("dy2"))


@det_plan("p14_letterbox", "@DET, b AS (SELECT event_id, x2 - x1 AS w, y2 - y1 AS h FROM det), g AS (SELECT *, CASE WHEN w < h * 0.6::DOUBLE THEN round_even(h * 0.6::DOUBLE, 0)::BIGINT ELSE w END AS nw, CASE WHEN w > h * 0.6::DOUBLE THEN round_even(w / 0.6::DOUBLE, 0)::BIGINT ELSE h END AS nh FROM b) SELECT event_id, nw, nh, (nw - w) // 2 AS pad_left, (nh - h) // 2 AS pad_top FROM g")
def letterbox(det: DataFrame) -> DataFrame:
    b = det.selectExpr("event_id", "x2 - x1 as w", "y2 - y1 as h")
    g = b.selectExpr("*", "case when w < h * 0.6D then cast(bround(h * 0.6D) as bigint) else w end as nw", "case when w > h * 0.6D then cast(bround(w / 0.6D) as bigint) else h end as nh")
    return g.selectExpr("event_id", "nw", "nh", "(nw - w) div 2 as pad_left", "(nh - h) div 2 as pad_top")


@det_plan("p15_channel_stretch", "@DET, g AS (SELECT track_id, min(k) AS lo, max(k) AS hi FROM det WHERE track_id >= 0 GROUP BY track_id) SELECT d.event_id, CASE WHEN hi - lo > 0.001 THEN (k - lo) * 255::DOUBLE / (hi - lo) ELSE k::DOUBLE END AS v FROM det d JOIN g ON d.track_id = g.track_id")
def stretch(det: DataFrame) -> DataFrame:
    d = det.where("track_id >= 0")
    span = d.groupBy("track_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    wide = F.col("hi") - F.col("lo")
    return d.join(span, "track_id").select("event_id", F.when(wide > 1e-3, (F.col("k") - F.col("lo")) * F.lit(255.0) / wide).otherwise(F.col("k").cast("double")).alias("v"))


@plan("p16_digit_filter", "SELECT doc_id, CASE WHEN length(d) BETWEEN 1 AND 2 THEN d ELSE '' END AS number FROM (SELECT doc_id, regexp_replace(source, '[^0-9]', '', 'g') AS d FROM documents)")
def digit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", E.digits("source").alias("number"))


@plan("p17_safe_filename", "SELECT page_id, substring(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 32) AS name FROM pages")
def filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", E.safe_name("url").alias("name"))


@det_plan("p18_carry_forward", "@DET, e AS (SELECT track_id, frame AS source_frame, frame + i AS frame, event_id FROM det, (SELECT unnest([0,1,2]) AS i) WHERE class_id = 0 AND track_id >= 0) SELECT track_id, frame, source_frame, event_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY source_frame DESC, event_id DESC) AS rn FROM e) WHERE rn = 1")
def carried(det: DataFrame) -> DataFrame:
    return O.carry_forward(S.tracked(det).select("track_id", "frame", "event_id"), 3, ["track_id"]).select("track_id", "frame", "source_frame", "event_id")


@det_plan("p19_identity", "@DET SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'T' || team_id || '#??' ELSE 'T' || team_id || '#' || num END AS identity FROM det")
def identity(det: DataFrame) -> DataFrame:
    team, number = F.expr("case when k % 5 <> 0 then team_id end"), F.expr("case when k % 3 <> 0 then num end")
    return det.select("event_id", F.concat(F.lit("T"), team.cast("string"), F.lit("#"), F.coalesce(number, F.lit("??"))).alias("identity"))


@det_plan("p20_render_label", "@DET SELECT event_id, CASE WHEN k % 4 = 0 THEN 't' || track_id ELSE 'e' || k || ' - t' || track_id END AS line1, CASE WHEN user_id % 25 = 0 THEN 'REF' ELSE (CASE WHEN class_name = 'goaltender' THEN 'G' ELSE 'S' END) || ' T' || team_id || ' #' || (CASE WHEN k % 3 = 0 THEN '??' ELSE num END) END AS line2 FROM det WHERE track_id >= 0")
def label(det: DataFrame) -> DataFrame:
    one = F.concat(F.coalesce(F.expr("case when k % 4 <> 0 then concat('e', k, ' - ') end"), F.lit("")), F.lit("t"), F.col("track_id").cast("string"))
    role = F.when(F.col("class_name") == "goaltender", "G").otherwise("S")
    number = F.coalesce(F.expr("case when k % 3 <> 0 then num end"), F.lit("??"))
    two = F.when(F.col("user_id") % 25 == 0, "REF").otherwise(F.concat(role, F.lit(" T"), F.col("team_id").cast("string"), F.lit(" #"), number))
    return det.where("track_id >= 0").select("event_id", one.alias("line1"), two.alias("line2"))


@det_plan("p21_visual_category", "@DET SELECT event_id, CASE WHEN user_id % 25 = 0 THEN 'ref' ELSE 'team' END AS kind, CASE WHEN user_id % 25 = 0 THEN NULL ELSE team_id END AS team, CASE WHEN user_id % 25 = 0 THEN NULL ELSE class_name = 'goaltender' END AS goalie FROM det")
def category(det: DataFrame) -> DataFrame:
    ref = F.col("user_id") % 25 == 0
    return det.select("event_id", F.when(ref, "ref").otherwise("team").alias("kind"), F.when(~ref, F.col("team_id")).alias("team"), F.when(~ref, F.col("class_name") == "goaltender").alias("goalie"))


@det_plan("p22_puck_circle", "@DET SELECT event_id, round_even((x1 + x2) / 2::DOUBLE, 0)::BIGINT AS cx, round_even((y1 + y2) / 2::DOUBLE, 0)::BIGINT AS cy, greatest(3, round_even(greatest(x2 - x1, y2 - y1) / 2::DOUBLE, 0)::BIGINT) AS r FROM det WHERE class_id = 32")
def circle(det: DataFrame) -> DataFrame:
    return det.where("class_id = 32").selectExpr("event_id", "cast(bround((x1 + x2) / 2D) as bigint) as cx", "cast(bround((y1 + y2) / 2D) as bigint) as cy", "greatest(3L, cast(bround(greatest(x2 - x1, y2 - y1) / 2D) as bigint)) as r")


@det_plan("p23_label_box", "@DET, a AS (SELECT event_id, x1 AS ax, y1 AS ay, 30 + k AS bw, 34 AS bh FROM det), b AS (SELECT *, CASE WHEN ay - 1 - bh < 0 THEN ay + 1 ELSE ay - 1 - bh END AS t FROM a) SELECT event_id, greatest(0, ax) AS lx1, greatest(0, least(550 - bh - 1, t)) AS ly1, least(1000, ax + bw) AS lx2, greatest(0, least(550 - bh - 1, t)) + bh AS ly2 FROM b")
def label_box(det: DataFrame) -> DataFrame:
    b = det.selectExpr("event_id", "x1 as ax", "y1 as ay", "30 + k as bw", "34L as bh").selectExpr("*", "case when ay - 1 - bh < 0 then ay + 1 else ay - 1 - bh end as t")
    return b.selectExpr("event_id", "greatest(0L, ax) as lx1", "greatest(0L, least(550 - bh - 1, t)) as ly1", "least(1000L, ax + bw) as lx2", "greatest(0L, least(550 - bh - 1, t)) + bh as ly2")


@det_plan("p24_colors", "@DET SELECT event_id, trunc(k * 0.55::DOUBLE)::BIGINT AS dark, trunc(255::DOUBLE * (100 - k) / 100)::BIGINT AS ramp FROM det")
def colors(det: DataFrame) -> DataFrame:
    return det.selectExpr("event_id", "cast(k * 0.55D as bigint) as dark", "cast(255D * (100 - k) / 100 as bigint) as ramp")


@det_plan("p25_keypoint_valid", "@DET SELECT event_id FROM det WHERE conf_c >= 3000 AND NOT (x1 = 0 AND y1 = 0)")
def valid(det: DataFrame) -> DataFrame:
    return det.where("conf_c >= 3000 and not (x1 = 0 and y1 = 0)").select("event_id")


@det_plan("p26_label_codes", "@DET SELECT event_id, CASE k % 5 WHEN 0 THEN 'REF' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'X' ELSE '' END AS code, CASE k % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS team, k % 5 = 0 AS is_referee FROM det")
def codes(det: DataFrame) -> DataFrame:
    c = det.select("event_id", F.element_at(F.array(*map(F.lit, ("REF", "A", "B", "X", ""))), (F.col("k") % 5 + 1).cast("int")).alias("code"))
    return c.select("*", F.when(F.col("code").isin("A", "B"), F.col("code")).alias("team"), (F.col("code") == "REF").alias("is_referee"))


@plan("p27_path_layout", "SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages WHERE len(string_split(url, '/')) >= 5 AND split_part(url, '/', 4) IN ('en', 'fr') GROUP BY 1")
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").withColumn("parts", F.split("url", "/"))
    good = p.where((F.size("parts") >= 5) & F.get("parts", F.lit(3)).isin("en", "fr"))
    return good.groupBy(F.col("parts")[2].alias("host")).agg(F.count("*").alias("n"))


@det_plan("p28_truth_keys", "@DET SELECT run_id AS run, track_id AS tid FROM det WHERE k % 10 <> 3")
def truth_keys(det: DataFrame) -> DataFrame:
    key = F.concat_ws("/", F.col("run_id").cast("string"), F.when(F.col("k") % 10 == 3, "none").otherwise(F.col("track_id").cast("string")))
    parts = det.select(F.split(key, "/", 2).alias("p"))
    return parts.select(F.expr("try_cast(p[0] as bigint)").alias("run"), F.expr("try_cast(p[1] as bigint)").alias("tid")).where("tid is not null")


_PX = "@DET, p AS (SELECT event_id, (k * 2)::INT AS b, (user_id % 256)::INT AS g, (conf_c % 256)::INT AS r FROM det), m AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS span FROM p), u AS (SELECT *, CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60.0::DOUBLE * (g - b) / span WHEN v = g THEN 120 + 60.0::DOUBLE * (b - r) / span ELSE 240 + 60.0::DOUBLE * (r - g) / span END AS hue FROM m)"


@det_plan("p29_hsv", f"{_PX} SELECT event_id, b, g, r, (floor(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2 + 0.5::DOUBLE)::INT % 180) AS h, CASE WHEN v = 0 THEN 0 ELSE floor(span * 255.0::DOUBLE / v + 0.5::DOUBLE)::INT END AS s, v FROM u")
def hsv(det: DataFrame) -> DataFrame:
    from ..functions.images import hsv_columns

    px = det.selectExpr("event_id", "cast(k * 2 as int) as b", "cast(user_id % 256 as int) as g", "cast(conf_c % 256 as int) as r")
    return hsv_columns(px)


#: Pixels that a mask must leave to be used (fixed value).
LEAST_PIXELS = 40


@det_plan("p30_pixel_masks", "@DET, p AS (SELECT user_id, k * 2 AS v, event_id % 60 AS s FROM det), c AS (SELECT user_id, sum((v > 30 AND v < 245)::INT)::BIGINT AS plain, sum((v > 40 AND v < 240)::INT)::BIGINT AS loose, sum((v > 40 AND v < 240 AND s > 30)::INT)::BIGINT AS strict FROM p GROUP BY user_id) SELECT user_id, plain, CASE WHEN strict >= 40 THEN strict WHEN loose >= 40 THEN loose END AS annotate FROM c")
def masks(det: DataFrame) -> DataFrame:
    """Pixels of each crop (here a user's rows) that its masks leave; too few by saturation: by value alone; too few by value: none."""
    p = det.selectExpr("user_id", "k * 2 as v", "event_id % 60 as s")
    n = lambda c: F.count_if(F.expr(c))
    c = p.groupBy("user_id").agg(n("v > 30 and v < 245").alias("plain"), n("v > 40 and v < 240").alias("loose"), n("v > 40 and v < 240 and s > 30").alias("strict"))
    annotate = F.when(F.col("strict") >= LEAST_PIXELS, F.col("strict")).when(F.col("loose") >= LEAST_PIXELS, F.col("loose"))
    return c.select("user_id", "plain", annotate.alias("annotate"))


#: Flags of a parameter registry: (flag, kind).
FLAGS = [("video", "pos"), ("--output", "str"), ("--debug-dir", "str"), ("--debug", "flag"), ("--conf", "float"), ("dir", "pos")]
_FLAGS_SQL = "f AS (SELECT event_id, k, ['video', '--output', '--debug-dir', '--debug', '--conf', 'dir'][event_id % 6 + 1] AS flag, ['pos', 'str', 'str', 'flag', 'float', 'pos'][event_id % 6 + 1] AS kind, CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) END AS dflt FROM det)"


def parameters(det: DataFrame) -> DataFrame:
    """A registry of parameters, one for each row: its flag and kind by the row's id, its default, where it has one, by ``k``."""
    at = (F.col("event_id") % len(FLAGS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FLAGS]), at)
    return det.select("event_id", pick(0).alias("flag"), pick(1).alias("kind"), F.when(F.col("k") % 3 != 0, F.col("k").cast("string")).alias("dflt"))


@det_plan("p31_flag_io", f"@DET, {_FLAGS_SQL} SELECT event_id, CASE WHEN NOT starts_with(flag, '--') THEN 'input' WHEN contains(flag, 'output') THEN 'output' WHEN contains(flag, 'debug') AND contains(flag, 'dir') THEN 'output' ELSE 'input' END AS io FROM f")
def flag_io(det: DataFrame) -> DataFrame:
    name = F.lower("flag")
    out = name.startswith("--") & (name.contains("output") | (name.contains("debug") & name.contains("dir")))
    return parameters(det).select("event_id", F.when(out, "output").otherwise("input").alias("io"))


@det_plan("p32_default_text", f"@DET, {_FLAGS_SQL} SELECT event_id, CASE WHEN kind = 'flag' THEN 'False' WHEN kind = 'pos' THEN coalesce('=' || dflt, '(required)') ELSE coalesce(dflt, '(none)') END AS shown FROM f")
def default_text(det: DataFrame) -> DataFrame:
    positional = F.coalesce(F.concat(F.lit("="), F.col("dflt")), F.lit("(required)"))
    shown = F.when(F.col("kind") == "flag", "False").when(F.col("kind") == "pos", positional).otherwise(F.coalesce("dflt", F.lit("(none)")))
    return parameters(det).select("event_id", shown.alias("shown"))


@plan("p33_overtime", "SELECT o_orderkey, starts_with(upper(CASE WHEN o_orderkey % 3 = 0 THEN 'prol 1' ELSE o_orderpriority END), 'PROL') AS overtime FROM orders")
def overtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prolonged(read(spark, sf_dir, "orders"))


def prolonged(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", F.upper(F.when(F.col("o_orderkey") % 3 == 0, "prol 1").otherwise(F.col("o_orderpriority"))).startswith("PROL").alias("overtime"))
