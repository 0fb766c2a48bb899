"""Beyond the operators of the survey's core: roll-ups, grouping sets, approximate counts, event time, star-schema joins, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import images as I
from ..sources import detections as S
from .base import det_plan, plan, read
from .joins import _POSE, poses


@plan("x01_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price_c, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_c"), F.count("*").alias("n"))


@plan("x02_shipping_priority", "SELECT o_orderkey, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS revenue_c FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY revenue_c DESC, o_orderkey LIMIT 10")
def x02(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    j = read(spark, sf, "orders").join(c, "o_custkey", "left_semi").join(read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    rev = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint"))
    return j.groupBy("o_orderkey").agg(rev.alias("revenue_c")).orderBy(F.desc("revenue_c"), "o_orderkey").limit(10)


@plan("x03_local_supplier_volume", "SELECT n_name, count(*) AS n FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")
def x03(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: read(spark, sf, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("o_custkey = c_custkey"))
    j = j.join(t["supplier"], F.expr("l_suppkey = s_suppkey and c_nationkey = s_nationkey")).join(t["nation"], F.expr("s_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"))


@plan("x04_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@plan("x05_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x05(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@plan("x06_grouping_sets", "SELECT event_type, user_id % 4 AS g, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4))")
def x06(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("g"))
    return e.groupingSets([[F.col("event_type")], [F.col("g")]], "event_type", "g").agg(F.count(F.lit(1)).alias("n"))


@plan("x07_approximate", None)
def x07(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey").alias("customers"), F.percentile_approx("o_totalprice", 0.5).alias("median"))


@plan("x08_tumbling", "SELECT (epoch_us(ts) // 3600000000) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_type", F.expr(f"({S.seconds('ts')} + 1704067200) div 3600").alias("hour"))
    return e.groupBy("hour", "event_type").agg(F.count("*").alias("n"))


@plan("x09_sliding", "SELECT h * 1800 AS since, count(*) AS n FROM (SELECT ((epoch_us(ts) // 1000000) // 1800) - i AS h FROM events, (SELECT unnest([0, 1]) AS i)) GROUP BY 1")
def x09(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that begin every half hour."""
    e = read(spark, sf, "events").select(F.expr(f"({S.seconds('ts')} + 1704067200) div 1800").alias("h"))
    return e.select(F.explode(F.array(F.col("h"), F.col("h") - 1)).alias("h")).groupBy((F.col("h") * 1800).alias("since")).agg(F.count("*").alias("n"))


@plan("x10_sessions", "WITH s AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 86400000000 THEN 0 ELSE 1 END AS fresh FROM s), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM f) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM g GROUP BY 1, 2")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    s = e.groupBy("user_id", F.session_window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("w.start")).cast("bigint").alias("session"), "n")


@det_plan("x11_ice_time", "@DET SELECT run_id, team_id, count(DISTINCT frame) AS frames, count(DISTINCT track_id) AS tracks FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY 1, 2")
def x11(det: DataFrame) -> DataFrame:
    return S.tracked(det).groupBy("run_id", "team_id").agg(F.countDistinct("frame").alias("frames"), F.countDistinct("track_id").alias("tracks"))


@det_plan("f01_color_engine", None)
def f01(det: DataFrame) -> DataFrame:
    """Colour engine: two centroids of a run's samples, each sample's nearest, and the track's majority."""
    px = det.where("track_id >= 0").selectExpr("run_id", "track_id", "cast(k as double) as b", "cast(user_id % 256 as double) as g")
    c = I.grouped_two_means(px, "run_id", ["b", "g"])
    j = px.join(c, "run_id").withColumn("team", F.expr("if(pow(b - b_1, 2) + pow(g - g_1, 2) < pow(b - b_0, 2) + pow(g - g_0, 2), 1, 0)"))
    return j.groupBy("run_id", "track_id").agg((2 * F.sum("team") > F.count("*")).cast("int").alias("team"), F.count("*").alias("samples"))


@det_plan("f06_number_reader", None)
def f06(det: DataFrame) -> DataFrame:
    """The reading interface with its stub model, in Arrow batches."""
    return I.read_numbers(det.select("event_id", F.col("num").cast("binary").alias("image")), "image")


@det_plan("f09_grid_colors", "@DET SELECT event_id, least(3, (x2 - x1) // 6) * least(2, (y2 - y1) // 6) AS cells FROM det")
def f09(det: DataFrame) -> DataFrame:
    """Cells of a 3 by 2 grid that are large enough."""
    return det.selectExpr("event_id", "least(3L, (x2 - x1) div 6) * least(2L, (y2 - y1) div 6) as cells")


def crops(det: DataFrame) -> DataFrame:
    """The torso images that detections would have: of their box's size, painted in a colour of their team and number."""
    d = det.where("track_id >= 0").selectExpr("event_id", "track_id", "conf_c", "k", "cast(40 + 150 * team_id as int) as cb", "cast(k * 2 as int) as cg", "cast(60 + user_id % 100 as int) as cr")
    return I.painted(d, "event_id", "8 + k % 30", "5 + k % 16", ["cb", "cg", "cr"])


@det_plan("f09_dominant_colors", None)
def f09_colors(det: DataFrame) -> DataFrame:
    """The grid's mean of dominant colours of every crop."""
    return I.crop_colors(crops(det))


@det_plan("f04_contrastive_engine", None)
def f04(det: DataFrame) -> DataFrame:
    """Contrastive engine: vectors of each track's fifteen surest crops by the small network, then medoids, two clusters and votes."""
    from ..operators.tracks import top_n

    top = top_n(det.where("track_id >= 0"), ["track_id"], [F.desc("conf_c"), F.col("event_id")], 15).drop("rn")
    return contrastive_teams(crops(top), bounded=True)


def contrastive_teams(rows: DataFrame, weights: dict | None = None, size: tuple[int, int] = (16, 32), bounded: bool = False) -> DataFrame:
    """Teams of tracks from crops ``(track_id, event_id, h, w, data)``; size and weights are the checkpoint's; ``bounded`` if a track has few crops."""
    import numpy as np

    w = weights or I.stub_weights()

    def backend(images: list[np.ndarray]) -> np.ndarray:
        """Images of equal size are scaled together; the network gets 64 at once."""
        x = I.letterboxed_all(images, *size)
        return np.concatenate([I.contrastive_vectors(x[at : at + 64], w) for at in range(0, len(x), 64)])

    v = I.embed_crops(rows.select("track_id", "event_id", "h", "w", "data"), backend, 2048)
    out = embedding_teams(v.selectExpr("track_id as label", "event_id as vec_id", "v"), bounded)
    return out.withColumnsRenamed({"label": "track_id", "vec_id": "event_id"})


#: Clips of both teams: a user's parity is the team, so that clips are of neighbouring users.
_CLIP = "SELECT user_id // 2 % 16 AS clip, team_id AS team, event_id AS crop FROM det WHERE track_id >= 0"
_CLIPS = f"crops AS ({_CLIP}), sizes AS (SELECT clip, sum((team = 0)::INT)::BIGINT AS a, sum((team = 1)::INT)::BIGINT AS b FROM crops GROUP BY clip), w AS (SELECT *, least(a, b) * (a + b) AS weight FROM sizes)"


def _chance(*parts: str) -> str:
    """The sampler's numbers in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12) AS BIGINT)"


def crops_of_clips(det: DataFrame) -> DataFrame:
    return det.where("track_id >= 0").select((F.expr("user_id div 2") % 16).alias("clip"), F.col("team_id").alias("team"), F.col("event_id").alias("crop"))


@det_plan("f10_triplet_weights", f"@DET, {_CLIPS} SELECT clip, weight FROM w")
def f10(det: DataFrame) -> DataFrame:
    """A clip's weight in the sampler of triplets."""
    c = crops_of_clips(det).groupBy("clip").agg(F.count_if(F.col("team") == 0).alias("a"), F.count_if(F.col("team") == 1).alias("b"))
    return c.select("clip", (F.least("a", "b") * (F.col("a") + F.col("b"))).alias("weight"))


@det_plan("f10_triplets", f"@DET, {_CLIPS}, o AS (SELECT *, sum(weight) OVER (ORDER BY clip) - weight AS since, sum(weight) OVER () AS total FROM w), d AS (SELECT DISTINCT event_id AS draw FROM det), h AS (SELECT draw, {_chance('0', chr(39) + 'c' + chr(39), 'draw')} AS c, {_chance('0', chr(39) + 't' + chr(39), 'draw')} % 2 AS team, {_chance('0', chr(39) + 'p' + chr(39), 'draw')} AS p, {_chance('0', chr(39) + 'q' + chr(39), 'draw')} AS q, {_chance('0', chr(39) + 'r' + chr(39), 'draw')} AS r, {_chance('0', chr(39) + 'g' + chr(39), 'draw')} % 2 = 0 AS grey FROM d), x AS (SELECT h.*, o.clip, CASE team WHEN 0 THEN a ELSE b END AS own, CASE team WHEN 0 THEN b ELSE a END AS other FROM h JOIN o ON o.weight > 0 AND h.c % o.total >= o.since AND h.c % o.total < o.since + o.weight), y AS (SELECT *, p % own AS i, q % greatest(own - 1, 1) AS j0, r % other AS k FROM x WHERE own >= 2), z AS (SELECT *, CASE WHEN j0 >= i THEN j0 + 1 ELSE j0 END AS j FROM y), s AS (SELECT *, row_number() OVER (PARTITION BY clip, team ORDER BY crop) - 1 AS place FROM crops) SELECT z.draw, z.clip, z.team, sa.crop AS anchor, sp.crop AS positive, sn.crop AS negative, z.grey FROM z JOIN s sa ON sa.clip = z.clip AND sa.team = z.team AND sa.place = z.i JOIN s sp ON sp.clip = z.clip AND sp.team = z.team AND sp.place = z.j JOIN s sn ON sn.clip = z.clip AND sn.team = 1 - z.team AND sn.place = z.k")
def f10_triplets(det: DataFrame) -> DataFrame:
    """As many triplets as there are detections, drawn from the clips by weight."""
    from ..operators.sampling import triplets

    return triplets(crops_of_clips(det), det.select(F.col("event_id").alias("draw")).distinct(), "0")


@det_plan("f10_weighted_crops", f"@DET, t AS (SELECT event_id, run_id, -ln(({_chance(chr(39) + '7' + chr(39), 'event_id')} + 1)::DOUBLE / 281474976710657::DOUBLE) / conf_c::DOUBLE AS wait FROM det WHERE conf_c > 0) SELECT run_id, event_id, place FROM (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY wait, event_id) AS place FROM t) WHERE place <= 50")
def f10_weighted_crops(det: DataFrame) -> DataFrame:
    """Fifty crops of each run, drawn without replacement by confidence."""
    from ..operators.sampling import weighted_sample

    s = weighted_sample(det.select("run_id", "event_id", "conf_c"), "conf_c", "event_id", 50, "7", ["run_id"])
    return s.select("run_id", "event_id", F.col("place").cast("bigint").alias("place"))


@det_plan("s06_pose_cache", f"@DET, p AS ({_POSE}) SELECT frame, count(*) AS poses, sum(x1)::BIGINT AS x FROM p GROUP BY frame")
def s06(det: DataFrame) -> DataFrame:
    """The pose table, written and read again, by frame."""
    from ..operators.store import materialise

    return materialise(poses(det)).groupBy("frame").agg(F.count("*").alias("poses"), F.sum("px1").cast("bigint").alias("x"))


@det_plan("k02_render_plan", "@DET SELECT frame * 2 + i AS out_frame, count(*) AS boxes FROM det, (SELECT unnest([0, 1]) AS i) WHERE track_id >= 0 GROUP BY 1")
def k02(det: DataFrame) -> DataFrame:
    """What a writer would draw on each output frame at twice the rate."""
    out = det.where("track_id >= 0").select(F.explode(F.array(F.col("frame") * 2, F.col("frame") * 2 + 1)).alias("out_frame"))
    return out.groupBy("out_frame").agg(F.count("*").alias("boxes"))


@det_plan("k04_upsert", "@DET, o AS (SELECT track_id, min(num) AS label FROM det WHERE k < 60 AND track_id >= 0 GROUP BY track_id), n AS (SELECT track_id, max(num) AS label FROM det WHERE k > 40 AND track_id >= 0 GROUP BY track_id) SELECT * FROM n UNION ALL SELECT * FROM o WHERE track_id NOT IN (SELECT track_id FROM n)")
def k04(det: DataFrame) -> DataFrame:
    """Labels upserted into a table of buckets and read from its latest version."""
    from ..operators.store import shared_path
    from ..sources.buckets import read_table, upsert_table

    spark, path = det.sparkSession, shared_path(det.sparkSession, "labels")
    upsert_table(spark, path, det.where("k < 60 and track_id >= 0").groupBy("track_id").agg(F.min("num").alias("label")), ["track_id"], 16)
    upsert_table(spark, path, det.where("k > 40 and track_id >= 0").groupBy("track_id").agg(F.max("num").alias("label")), ["track_id"])
    return read_table(spark, path)


@det_plan("k05_fan_out", "@DET, c AS (SELECT event_id AS client, run_id AS match_id, sec AS since, CASE WHEN k % 2 = 0 THEN sec + 86400 END AS until FROM det WHERE event_type = 'signup' AND k > 90), r AS (SELECT run_id AS match_id, event_id AS seq, sec AS sc FROM det WHERE event_type = 'click') SELECT client, count(*) AS messages, min(seq) AS first_seq FROM c JOIN r ON c.match_id = r.match_id AND r.sc >= c.since AND (c.until IS NULL OR r.sc < c.until) GROUP BY client")
def k05(det: DataFrame) -> DataFrame:
    """Messages that each subscriber of a match gets."""
    from ..sources.sinks import fan_out

    c = det.where("event_type = 'signup' and k > 90").selectExpr("event_id as client", "run_id as match_id", "sec as since", "case when k % 2 = 0 then sec + 86400 end as until")
    r = det.where("event_type = 'click'").selectExpr("run_id as match_id", "event_id as seq", "sec as at")
    return fan_out(r, c).groupBy("client").agg(F.count("*").alias("messages"), F.min("seq").alias("first_seq"))


@plan("f02_embedding_engine", None)
def f02(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding engine; a label is a track."""
    return embedding_teams(read(spark, sf, "embeddings").selectExpr("label", "vec_id", "cast(embedding as array<double>) as v"))


def embedding_teams(e: DataFrame, bounded: bool = False) -> DataFrame:
    """The medoid of each label's unit vectors, two clusters of the medoids on all components, and votes.

    The assigned team gets as many votes as the label has vectors, the
    other none. Rows without label or vector are left out. ``bounded`` if
    no label has many vectors.
    """
    from ..operators.store import materialise
    from ..operators.tracks import bounded_medoids, medoids

    e = e.where("label is not null and v is not null").select("label", "vec_id", E.unit("v").alias("v"))
    m = materialise((bounded_medoids if bounded else medoids)(e, ["label"], "vec_id").join(e.groupBy("label").agg(F.count("*").alias("n")), "label"))
    out = I.nearest_of_two(m, "v", I.two_centroids(m, "v", "label")).drop("v")
    votes = [F.when(F.col("team") == t, F.col("n")).otherwise(0).cast("bigint").alias(f"votes_{t}") for t in (0, 1)]
    return out.select("label", "vec_id", "team", *votes)


_UNIT = "greatest(0, list_inner_product(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: ((i * 16 + j) % 7 - 3) / 8.0::DOUBLE)))"
_LOGIT = f"list_inner_product(list_transform(range(0, 16), lambda j: {_UNIT}), list_transform(range(0, 16), lambda j: (j % 5 - 2) / 4.0::DOUBLE))"


@plan("f05_referee_head", f"SELECT vec_id, round(1 / (1 + exp(-{_LOGIT})), 9) AS score FROM embeddings")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    """A 64-16-1 head over embeddings; its weights follow a rule, in place of a checkpoint."""
    import numpy as np

    first = ((np.arange(64)[:, None] * 16 + np.arange(16)) % 7 - 3) / 8
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return I.mlp_head(e, "embedding", first, (np.arange(16) % 5 - 2) / 4).select("vec_id", E.rounded("score", 9).alias("score"))


@det_plan("f07_pose_inference", None)
def f07(det: DataFrame) -> DataFrame:
    """Poses of the frames that the cache lacks, through the stub model."""
    return I.infer_poses(det.where("frame % 5 = 2").select("frame").distinct(), I.stub_poses)


@det_plan("g09_association", None)
def g09(det: DataFrame) -> DataFrame:
    """Tracks of each run's persons, in chunks of 1000 frames that are stitched where they overlap."""
    from ..operators.tracking import track_boxes

    boxes = det.where("class_id = 0").selectExpr("run_id", "event_id", "frame", "x1", "y1", "x2", "y2", "conf_c % 100 / 100D as score")
    return track_boxes(boxes, "run_id")


@plan("f03_projection_engine", None)
def f03(spark: SparkSession, sf: str) -> DataFrame:
    """Projection engine: embeddings of crops on three axes; a label is a track."""
    from .graphs import g10

    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    return projection_teams(g10(spark, sf).select("vec_id", F.col("p").alias("v")).join(labels, "vec_id"))


@plan("f03_spectral_engine", None)
def f03_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Projection engine on the coordinates that keep neighbours together: two clusters of each clip, by restarts, and the tracks' votes."""
    from ..operators.kmeans import grouped_kmeans
    from ..operators.store import materialise
    from .graphs import clip_vectors, g10_spectral

    x = materialise(g10_spectral(spark, sf).select("clip", "vec_id", *[(F.col("x")[i] * 1000).alias(f"x{i}") for i in range(3)]))
    c = grouped_kmeans(x, "clip", "vec_id", ["x0", "x1", "x2"], 2, starts=10)
    far = E.squared_distance([F.col(f"x{i}") for i in range(3)], [F.col("centre")[i] for i in range(3)])
    own = x.join(c, "clip").groupBy("clip", "vec_id").agg(F.min_by("cluster", F.struct(far, "cluster")).alias("team"))
    own = own.join(clip_vectors(spark, sf).select("vec_id", "label"), "vec_id")
    votes = own.groupBy("label").agg(*[F.count_if(F.col("team") == t).alias(f"votes_{t}") for t in (0, 1)])
    return votes.select("label", F.when(F.col("votes_1") > F.col("votes_0"), 1).otherwise(0).alias("team"), "votes_0", "votes_1")


def projection_teams(p: DataFrame) -> DataFrame:
    """Two clusters of all crops' vectors ``(label, vec_id, v)``, and each label's team by the votes of its crops; equal votes give team 0."""
    from ..operators.store import materialise

    p = materialise(p.where("label is not null and v is not null"))
    got = I.nearest_of_two(p, "v", I.two_centroids(p, "v", "vec_id")).groupBy("label")
    votes = got.agg(*[F.count_if(F.col("team") == t).alias(f"votes_{t}") for t in (0, 1)])
    return votes.select("label", F.when(F.col("votes_1") > F.col("votes_0"), 1).otherwise(0).alias("team"), "votes_0", "votes_1")


@plan("f12_batched_embeddings", None)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """An embedding extractor's interface: vectors of the pages' bytes, sixty-four at once; a stub counts bytes."""
    import numpy as np
    import pandas as pd

    def embed(parts):
        for pdf in parts:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                v = [np.bincount(np.frombuffer(x, np.uint8) % 8, minlength=8).astype(float).tolist() for x in part["image"]]
                yield pd.DataFrame({"page_id": part["page_id"], "vec": v})

    pages = read(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("image"))
    return pages.mapInPandas(embed, "page_id bigint, vec array<double>")


@plan("k09_model_checkpoint", None)
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier head is fitted, saved to the shared folder, loaded again and scored."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    from ..operators.store import shared_path

    e = read(spark, sf, "embeddings").select(array_to_vector("embedding").alias("features"), (F.col("label") == 0).cast("double").alias("label"))
    path = shared_path(spark, "model")
    LogisticRegression(maxIter=20).fit(e).save(path)
    return LogisticRegressionModel.load(path).transform(e).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("correct"))
