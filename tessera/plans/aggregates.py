"""Aggregations (A), windows (W) and orderings (O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import tracks as O
from ..operators.bitmaps import coverage, frame_words
from ..operators.scan import running_sum
from ..operators.selection import place_by_hash
from ..sources import detections as S
from .base import det_plan, plan, read
from .joins import _ENGINES, engines

_T = "class_id = 0 AND track_id >= 0"


@det_plan("flagship", f"@DET, v AS (SELECT track_id, num, count(*) AS n, min(frame * 10000000 + event_id) AS seen FROM det WHERE {_T} GROUP BY track_id, num), b AS (SELECT track_id, num, n, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, seen) AS rn FROM v), s AS (SELECT d.track_id, min(d.team_id) AS team_id, min(d.frame) AS fs, max(d.frame) AS fe FROM det d WHERE {_T} GROUP BY d.track_id), j AS (SELECT s.*, b.num AS number FROM s JOIN b ON s.track_id = b.track_id WHERE b.rn = 1 AND b.n >= 2), l AS (SELECT *, CASE WHEN lag(fe) OVER (PARTITION BY team_id, number ORDER BY fs, fe, track_id) < fs THEN 0 ELSE 1 END AS fresh FROM j), i AS (SELECT *, sum(fresh) OVER (PARTITION BY team_id, number ORDER BY fs, fe, track_id) AS island FROM l) SELECT team_id, number, list_sort(list(track_id)) AS ids, min(fs) AS frame_start, arg_max(fe, fs * 1000000000000 + fe * 1000000 + track_id) AS frame_end, count(*) AS n_tracks FROM i GROUP BY team_id, number, island HAVING count(*) >= 2")
def flagship(det: DataFrame) -> DataFrame:
    """Player groups: tracks merged by team and the number voted for, wherever their spans follow each other."""
    t = S.tracked(det)
    team = t.groupBy("track_id").agg(F.min("team_id").alias("team_id"), F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))
    spans = team.join(O.number_votes(t).where("number is not null").select("track_id", "number"), "track_id")
    return O.number_islands(spans).drop("island")


@det_plan("a01_track_spans", f"@DET SELECT track_id, count(*) AS n, min(frame) AS frame_start, max(frame) AS frame_end FROM det WHERE {_T} GROUP BY track_id")
def a01(det: DataFrame) -> DataFrame:
    return O.track_spans(S.tracked(det))


@det_plan("a02_goalie_majority", f"@DET SELECT track_id, sum((class_name = 'goaltender')::INT)::BIGINT AS n_goalie, count(*) AS n, avg((class_name = 'goaltender')::INT) > 0.5 AS is_goaltender FROM det WHERE {_T} GROUP BY track_id")
def a02(det: DataFrame) -> DataFrame:
    return O.goalies(S.tracked(det)).withColumn("n_goalie", F.col("n_goalie").cast("bigint"))


@det_plan("a03_orientation_histogram", "@DET SELECT track_id, string_agg(f || ':' || n, ',' ORDER BY f) AS counts FROM (SELECT track_id, event_type AS f, count(*) AS n FROM det WHERE track_id >= 0 GROUP BY 1, 2) GROUP BY track_id")
def a03(det: DataFrame) -> DataFrame:
    h = det.where("track_id >= 0").groupBy("track_id", "event_type").agg(F.count("*").alias("n"))
    m = h.groupBy("track_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("track_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@det_plan("a04_number_vote", f"@DET, v AS (SELECT track_id, num, count(*) AS votes, sum(conf_c)::BIGINT AS conf_sum, min(frame * 10000000 + event_id) AS seen FROM det WHERE {_T} GROUP BY track_id, num) SELECT track_id, CASE WHEN votes >= 2 THEN num END AS number, votes, conf_sum FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, seen) AS rn FROM v) WHERE rn = 1")
def a04(det: DataFrame) -> DataFrame:
    return O.number_votes(S.tracked(det))


_COUNTS = "c AS (SELECT track_id, sum((k % 2 = 0)::INT)::BIGINT AS c0, sum((k % 2 = 1)::INT)::BIGINT AS c1 FROM det WHERE track_id >= 0 GROUP BY track_id)"


def crop_counts(det: DataFrame) -> DataFrame:
    return det.where("track_id >= 0").groupBy("track_id").agg(F.count_if(F.expr("k % 2 = 0")).alias("c0"), F.count_if(F.expr("k % 2 = 1")).alias("c1"))


@det_plan("a05_team_majority", f"@DET, {_COUNTS} SELECT *, CASE WHEN c1 > c0 THEN 1 ELSE 0 END AS team FROM c")
def a05(det: DataFrame) -> DataFrame:
    return crop_counts(det).withColumn("team", O.majority(F.col("c0"), F.col("c1")))


@det_plan("a06_vote_confidence", f"@DET, {_COUNTS} SELECT track_id, greatest(c0, c1) AS won, c0 + c1 AS total, CASE WHEN c0 + c1 = 0 THEN 0::DOUBLE ELSE greatest(c0, c1) / (c0 + c1)::DOUBLE END AS confidence FROM c")
def a06(det: DataFrame) -> DataFrame:
    c = crop_counts(det).select("track_id", F.greatest("c0", "c1").alias("won"), (F.col("c0") + F.col("c1")).alias("total"))
    return c.withColumn("confidence", F.when(F.col("total") == 0, 0.0).otherwise(F.col("won") / F.col("total")))


_VOTES = "v AS (SELECT track_id, event_id % 3 AS pos, max(conf_c) AS conf_c, arg_max(k % 2, conf_c * 100000000 + event_id) AS team FROM det WHERE track_id >= 0 GROUP BY 1, 2)"


@det_plan("a07_engine_summary", f"@DET, {_VOTES}, b AS (SELECT track_id, team AS best, conf_c AS best_conf FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY conf_c DESC, pos) rn FROM v) WHERE rn = 1) SELECT v.track_id, b.best AS team, b.best_conf AS conf_c, sum((v.team = b.best)::INT)::BIGINT AS agree, count(*) AS engines FROM v JOIN b ON v.track_id = b.track_id GROUP BY 1, 2, 3")
def a07(det: DataFrame) -> DataFrame:
    v = det.where("track_id >= 0").groupBy("track_id", (F.col("event_id") % 3).alias("engine_pos")).agg(
        F.max(F.struct("conf_c", "event_id", (F.col("k") % 2).alias("team"))).alias("m"))
    return O.engine_summary(v.select("track_id", "engine_pos", "m.conf_c", "m.team"))


_ENTITY = "m AS (SELECT user_id AS entity, track_id, count(*) AS frames, max(conf_c) AS conf_c, min(k % 2) AS team, min(num) AS number, avg((class_name = 'goaltender')::INT) > 0.5 AS goalie FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY 1, 2)"


def members(det: DataFrame) -> DataFrame:
    m = S.tracked(det).groupBy(F.col("user_id").alias("entity"), "track_id").agg(
        F.count("*").alias("frames"), F.max("conf_c").alias("conf_c"), F.min(F.col("k") % 2).alias("team"), F.min("num").alias("number"),
        (2 * F.count_if(F.expr("class_name = 'goaltender'")) > F.count("*")).alias("goalie"))
    return m.withColumn("w", F.col("frames") * F.col("conf_c"))


def _weighted(value: str) -> str:
    return f"@DET, {_ENTITY}, s AS (SELECT entity, {value}, sum(frames * conf_c)::BIGINT AS won FROM m GROUP BY 1, 2), r AS (SELECT *, (sum(won) OVER (PARTITION BY entity))::BIGINT AS total, row_number() OVER (PARTITION BY entity ORDER BY won DESC, {value}) AS rn FROM s) SELECT entity, {value}, won, total FROM r WHERE rn = 1"


@det_plan("a08_entity_team", _weighted("team"))
def a08(det: DataFrame) -> DataFrame:
    return O.weighted_vote(members(det), ["entity"], "team", "w")


@det_plan("a09_entity_goalie", f"@DET, {_ENTITY} SELECT entity, sum(CASE WHEN goalie THEN frames ELSE 0 END)::BIGINT AS goalie_frames, sum(frames)::BIGINT AS frames, 2 * sum(CASE WHEN goalie THEN frames ELSE 0 END) > sum(frames) AS is_goaltender FROM m GROUP BY entity")
def a09(det: DataFrame) -> DataFrame:
    g = members(det).groupBy("entity").agg(F.sum(F.when(F.col("goalie"), F.col("frames")).otherwise(0)).alias("goalie_frames"), F.sum("frames").alias("frames"))
    return g.withColumn("is_goaltender", 2 * F.col("goalie_frames") > F.col("frames"))


@det_plan("a10_entity_number", _weighted("number"))
def a10(det: DataFrame) -> DataFrame:
    return O.weighted_vote(members(det), ["entity"], "number", "w")


@det_plan("a11_entity_coverage", f"@DET SELECT user_id AS entity, count(DISTINCT frame) AS covered, min(frame) AS first_frame, max(frame) AS last_frame, round_even(100 * count(DISTINCT frame) / greatest((SELECT max(frame) FROM det), 1)::DOUBLE, 2) AS pct FROM det WHERE {_T} GROUP BY user_id")
def a11(det: DataFrame) -> DataFrame:
    total = det.agg(F.max("frame").alias("total"))
    c = coverage(frame_words(S.tracked(det).withColumnRenamed("user_id", "entity"), ["entity"]), ["entity"])
    c = c.join(F.broadcast(total))  # one row: an aggregate without keys
    return c.select("entity", "covered", "first_frame", "last_frame", F.bround(100 * F.col("covered") / F.greatest(F.col("total"), F.lit(1)), 2).alias("pct"))


@det_plan("a12_score_rounding", "@DET SELECT event_id, round_even(k / 16::DOUBLE, 3) AS score FROM det")
def a12(det: DataFrame) -> DataFrame:
    return det.select("event_id", F.bround(F.col("k") / 16, 3).alias("score"))


@det_plan("a13_headline_counts", f"@DET, {_COUNTS} SELECT sum((c1 > c0)::INT)::BIGINT AS team1, sum((c1 <= c0)::INT)::BIGINT AS team0, sum((100 * greatest(c0, c1) < 67 * (c0 + c1))::INT)::BIGINT AS low, sum((c0 + c1 = 1)::INT)::BIGINT AS single FROM c")
def a13(det: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return crop_counts(det).agg(n("c1 > c0").alias("team1"), n("c1 <= c0").alias("team0"), n("100 * greatest(c0, c1) < 67 * (c0 + c1)").alias("low"), n("c0 + c1 = 1").alias("single"))


@det_plan("a14_engine_agreement", f"@DET, {_VOTES} SELECT l.pos AS a, r.pos AS b, count(*) AS both, sum((l.team = r.team)::INT)::BIGINT AS agree FROM v l JOIN v r ON l.track_id = r.track_id AND l.pos < r.pos GROUP BY 1, 2")
def a14(det: DataFrame) -> DataFrame:
    v = det.where("track_id >= 0").groupBy("track_id", (F.col("event_id") % 3).alias("pos")).agg(F.max(F.struct("conf_c", "event_id", (F.col("k") % 2).alias("team"))).alias("m")).select("track_id", "pos", "m.team")
    j = v.alias("l").join(v.alias("r"), "track_id").where("l.pos < r.pos")
    return j.groupBy(F.col("l.pos").alias("a"), F.col("r.pos").alias("b")).agg(F.count("*").alias("both"), F.count_if(F.expr("l.team = r.team")).alias("agree"))


@det_plan("a15_cluster_margin", "@DET, c AS (SELECT team_id, avg(x1) AS cx, avg(y1) AS cy FROM det GROUP BY team_id), i AS (SELECT d.team_id, avg(sqrt((d.x1 - c.cx) * (d.x1 - c.cx) + (d.y1 - c.cy) * (d.y1 - c.cy))) AS s FROM det d JOIN c ON d.team_id = c.team_id GROUP BY d.team_id) SELECT round(sqrt((max(cx) - min(cx)) * (max(cx) - min(cx)) + (max(cy) - min(cy)) * (max(cy) - min(cy))) / ((SELECT avg(s) FROM i) + 0.000001), 6) AS margin FROM c")
def a15(det: DataFrame) -> DataFrame:
    """Distance of two centroids over the mean of the clusters' mean distances."""
    c = det.groupBy("team_id").agg(F.avg("x1").alias("cx"), F.avg("y1").alias("cy"))
    d = det.join(F.broadcast(c), "team_id")  # two rows: one for each team
    dist = F.sqrt(E.squared_distance([F.col("x1"), F.col("y1")], [F.col("cx"), F.col("cy")]))
    i = d.groupBy("team_id").agg(F.avg(dist).alias("s"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    apart = F.sqrt(F.pow(F.max("cx") - F.min("cx"), 2) + F.pow(F.max("cy") - F.min("cy"), 2))
    return i.agg(E.rounded(apart / (F.avg("s") + F.lit(1e-6)), 6).alias("margin"))


@det_plan("a16_median_color", "@DET SELECT track_id, trunc(quantile_cont(k, 0.5))::BIGINT AS b, trunc(quantile_cont(user_id % 256, 0.5))::BIGINT AS g, trunc(quantile_cont(conf_c % 256, 0.5))::BIGINT AS r FROM det WHERE track_id >= 0 GROUP BY track_id")
def a16(det: DataFrame) -> DataFrame:
    m = lambda c: F.percentile(F.expr(c), F.lit(0.5)).cast("bigint")
    return det.where("track_id >= 0").groupBy("track_id").agg(m("k").alias("b"), m("user_id % 256").alias("g"), m("conf_c % 256").alias("r"))


@det_plan("a17_mean_color", "@DET SELECT track_id, trunc(avg(k))::BIGINT AS b FROM det WHERE track_id >= 0 GROUP BY track_id")
def a17(det: DataFrame) -> DataFrame:
    return det.where("track_id >= 0").groupBy("track_id").agg(F.avg("k").cast("bigint").alias("b"))


@det_plan("a18_dominant_color", None)
def a18(det: DataFrame) -> DataFrame:
    """The colour of each user's pixels: the centre of the largest of three clusters, or the mean of fewer than 30 pixels."""
    p = det.where("track_id >= 0").selectExpr("user_id", "event_id", "cast(k as double) as b", "cast(user_id * event_id % 256 as double) as g")
    return dominant(p, "user_id", "event_id", ["b", "g"])


def dominant(p: DataFrame, key: str, ident: str, columns: list[str], k: int = 3, least: int = 30) -> DataFrame:
    """``key, <columns>, n``: the largest cluster's centre, cut to whole numbers, and its size; of equals the first centre."""
    from ..operators.kmeans import grouped_kmeans

    sizes = p.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("centre"))
    many = p.join(sizes.where(F.col("n") >= least).select(key).hint("merge"), key, "left_semi")
    c = grouped_kmeans(many, key, ident, columns, k, starts=3, rounds=20)
    top = c.groupBy(key).agg(F.min_by(F.struct("centre", "n"), F.struct(-F.col("n"), "cluster")).alias("c")).select(key, "c.centre", "c.n")
    all_ = top.unionByName(sizes.where(F.col("n") < least).select(key, "centre", "n"))
    return all_.select(key, *[F.col("centre")[i].cast("int").alias(c) for i, c in enumerate(columns)], "n")


_TOTAL = "t AS (SELECT label, list(x ORDER BY i) AS t FROM (SELECT label, i, sum(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"


@plan("a19_medoid", f"WITH {_TOTAL} SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_inner_product(e.embedding::DOUBLE[], t.t), 9) DESC, e.vec_id) AS rn FROM embeddings e JOIN t ON e.label = t.label) WHERE rn = 1")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return medoids(read(spark, sf, "embeddings"))


def medoids(e: DataFrame) -> DataFrame:
    """The vector nearest all others of its label: its product with the summed vector, in one pass."""
    e = e.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return O.medoids(e, ["label"], "vec_id").select("label", "vec_id")


@plan("a20_l2_normalise", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0.000000001), 12)) AS v FROM embeddings")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.transform(E.unit("v"), lambda x: E.rounded(x, 12)).alias("v"))


_HEAD = "list_inner_product(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END))"


@plan("a21_referee_score", f"SELECT label, round(avg(1 / (1 + exp(-{_HEAD}))), 9) AS ref_score, avg(1 / (1 + exp(-{_HEAD}))) > 0.5 AS is_referee FROM embeddings GROUP BY label")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    """A referee head's mean score by label; above one half it is a referee."""
    from ..functions.images import linear_head

    e = linear_head(read(spark, sf, "embeddings"), "embedding", [(-1.0) ** i / 8 for i in range(64)], 0.0)
    return e.groupBy("label").agg(F.avg("score").alias("s")).select("label", E.rounded("s", 9).alias("ref_score"), (F.col("s") > 0.5).alias("is_referee"))


@det_plan("a22_team_swatch", f"@DET, g AS (SELECT track_id, 2 * sum((class_name = 'goaltender')::INT) > count(*) AS goalie FROM det WHERE {_T} GROUP BY track_id), s AS (SELECT d.team_id, trunc(avg(d.k))::BIGINT AS b, trunc(avg(d.user_id % 256))::BIGINT AS g, trunc(avg(d.conf_c % 256))::BIGINT AS r FROM det d JOIN g ON d.track_id = g.track_id WHERE d.class_id = 0 AND NOT g.goalie GROUP BY d.team_id) SELECT t AS team_id, coalesce(s.b, 128) AS b, coalesce(s.g, 128) AS g, coalesce(s.r, 128) AS r FROM (SELECT unnest([0, 1, 2]) AS t) LEFT JOIN s ON s.team_id = t")
def a22(det: DataFrame) -> DataFrame:
    """Each team's mean colour over the tracks that clusters are fitted on, those of skaters; a team without any is grey."""
    t = S.tracked(det)
    fit = t.join(O.goalies(t).where("not is_goaltender").select("track_id"), "track_id", "left_semi")
    mean = lambda c: F.avg(F.expr(c)).cast("bigint")
    s = fit.groupBy("team_id").agg(mean("k").alias("b"), mean("user_id % 256").alias("g"), mean("conf_c % 256").alias("r"))
    every = det.sparkSession.range(3).select(F.col("id").cast("int").alias("team_id"))
    return every.join(s, "team_id", "left").select("team_id", *[F.coalesce(c, F.lit(128)).alias(c) for c in "bgr"])


_BENCH = f"@DET, {_ENGINES}, j AS (SELECT a.track_id // 100 AS clip, a.team, b.team AS said FROM a LEFT JOIN b ON a.track_id = b.track_id), c AS (SELECT clip, count(*) AS n, sum(coalesce(team = said, FALSE)::INT)::BIGINT AS same, sum(coalesce(team <> said, FALSE)::INT)::BIGINT AS swap FROM j GROUP BY clip)"


def clips(det: DataFrame) -> DataFrame:
    a, b = engines(det)
    j = a.join(b.withColumnRenamed("team", "said"), "track_id", "left").withColumn("clip", F.expr("track_id div 100"))
    return j.groupBy("clip").agg(F.count("*").alias("n"), F.count_if(F.expr("team = said")).alias("same"), F.count_if(F.expr("team <> said")).alias("swap"))


@det_plan("a23_bench_accuracy", _BENCH + " SELECT sum(greatest(same, swap))::BIGINT AS correct, sum(n)::BIGINT AS tracks FROM c")
def a23(det: DataFrame) -> DataFrame:
    """Tracks right under the better of both team orders, clip by clip."""
    return clips(det).agg(F.sum(F.greatest("same", "swap")).alias("correct"), F.sum("n").alias("tracks"))


@det_plan("a24_referee_recall", "@DET, t AS (SELECT track_id, min(run_id) AS run_id, min(user_id) % 25 = 0 AS truth, max(k) > 90 AS said FROM det WHERE track_id >= 0 GROUP BY track_id), c AS (SELECT run_id, sum((truth AND said)::INT) AS hit, sum(truth::INT) AS t, sum(said::INT) AS s FROM t GROUP BY run_id) SELECT round(avg(hit / nullif(t, 0)), 9) AS recall, round(avg(hit / nullif(s, 0)), 9) AS precision_ FROM c")
def a24(det: DataFrame) -> DataFrame:
    t = det.where("track_id >= 0").groupBy("track_id").agg(F.min("run_id").alias("run_id"), (F.min("user_id") % 25 == 0).alias("truth"), (F.max("k") > 90).alias("said"))
    c = t.groupBy("run_id").agg(F.count_if(F.expr("truth and said")).alias("hit"), F.count_if("truth").alias("t"), F.count_if("said").alias("s"))
    rate = lambda d: E.rounded(F.avg(F.try_divide("hit", d)), 9)
    return c.agg(rate("t").alias("recall"), rate("s").alias("precision_"))


@plan("a25_confusion_matrix", "SELECT sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS fp, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS fn, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS tn, greatest(sum((toxic = 1)::INT), 1)::BIGINT AS den FROM labels")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return read(spark, sf, "labels").agg(n("quality = 1 and toxic = 1").alias("tp"), n("quality = 0 and toxic = 1").alias("fp"), n("quality = 1 and toxic = 0").alias("fn"), n("quality = 0 and toxic = 0").alias("tn"), F.greatest(n("toxic = 1"), F.lit(1)).alias("den"))


@det_plan("a26_exact_match", "@DET SELECT sum((num = CAST(k AS VARCHAR))::INT)::BIGINT AS hits, count(*) AS n, sum((k % 3 <> 0 AND num = CAST(k AS VARCHAR))::INT)::BIGINT AS positive_hits, sum((k % 3 = 0 AND num = CAST(k AS VARCHAR))::INT)::BIGINT AS negative_hits FROM det")
def a26(det: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return det.agg(n("num = cast(k as string)").alias("hits"), F.count("*").alias("n"), n("k % 3 <> 0 and num = cast(k as string)").alias("positive_hits"), n("k % 3 = 0 and num = cast(k as string)").alias("negative_hits"))


_LIP = "list_inner_product(v, {}) "


@plan("a27_triplet_rate", f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings), p AS (SELECT * FROM (SELECT label, v, lead(v) OVER (PARTITION BY label ORDER BY h, vec_id) AS p FROM e) WHERE p IS NOT NULL), n AS (SELECT label - 1 AS label, v AS n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS rn FROM e) WHERE rn = 1) SELECT p.label, count(*) AS pairs, coalesce(sum(({_LIP.format('p')} > {_LIP.format('n')})::INT), 0)::BIGINT AS satisfied FROM p LEFT JOIN n ON p.label = n.label GROUP BY p.label")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    """Share of triplets whose positive is nearer than the negative; triplets without a negative count as missed."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mixed = F.md5(F.col("vec_id").cast("string"))
    placed = running_sum(e.where("label is not null").withColumn("h", mixed).withColumn("one", F.lit(1)), ["label"], ["h", "vec_id"], "one", "place")
    after = placed.select("label", (F.col("place") - 1).alias("place"), F.col("v").alias("p"))
    pos = placed.join(after, ["label", "place"]).select("label", "v", "p")
    neg = e.select((F.col("label") - 1).alias("label"), "vec_id", F.col("v").alias("n"))
    neg = O.top_n(neg, ["label"], [mixed, F.col("vec_id")], 1).select("label", "n")
    t = pos.join(neg, "label", "left").withColumn("ok", E.dot("v", "p") > E.dot("v", "n"))
    return t.groupBy("label").agg(F.count("*").alias("pairs"), F.count_if("ok").alias("satisfied"))


@det_plan("a28_keypoint_rates", "@DET, k AS (SELECT k % 60 AS kp, conf_c FROM det WHERE k % 60 <= 55 AND conf_c >= 3000) SELECT i AS kp, count(k.kp) AS seen, coalesce(sum(conf_c), 0)::BIGINT AS conf_sum FROM (SELECT unnest(range(0, 56)) AS i) LEFT JOIN k ON k.kp = i GROUP BY i")
def a28(det: DataFrame) -> DataFrame:
    k = det.where("k % 60 <= 55 and conf_c >= 3000").groupBy((F.col("k") % 60).alias("kp")).agg(F.count("*").alias("seen"), F.sum("conf_c").alias("conf_sum"))
    every = det.sparkSession.range(56).withColumnRenamed("id", "kp")
    return every.join(k, "kp", "left").select("kp", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("conf_sum", F.lit(0)).alias("conf_sum"))


@plan("a29_dataset_counts", "SELECT count(*) AS total, count(DISTINCT source) AS sources, sum((lang = 'en')::INT)::BIGINT AS english, count(DISTINCT text) AS texts FROM documents")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").agg(F.count("*").alias("total"), F.countDistinct("source").alias("sources"), F.count_if(F.expr("lang = 'en'")).alias("english"), F.countDistinct("text").alias("texts"))


@det_plan("a30_annotation_counts", "@DET SELECT sum((k % 5 = 1)::INT)::BIGINT AS a, sum((k % 5 = 2)::INT)::BIGINT AS b, sum((k % 5 = 0)::INT)::BIGINT AS ref, sum((k % 5 > 2)::INT)::BIGINT AS other FROM det")
def a30(det: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return det.agg(n("k % 5 = 1").alias("a"), n("k % 5 = 2").alias("b"), n("k % 5 = 0").alias("ref"), n("k % 5 > 2").alias("other"))


@det_plan("a31_team_entity_counts", f"@DET, {_ENTITY} SELECT CASE WHEN entity % 7 <> 0 THEN team END AS team, count(*) AS n, sum(goalie::INT)::BIGINT AS goalies FROM m GROUP BY 1")
def a31(det: DataFrame) -> DataFrame:
    return members(det).groupBy(F.expr("case when entity % 7 <> 0 then team end").alias("team")).agg(F.count("*").alias("n"), F.count_if("goalie").alias("goalies"))


@det_plan("a32_puck_coverage", "@DET, f AS (SELECT frame, sum((class_id = 32)::INT) AS pucks FROM det GROUP BY frame) SELECT count(*) AS frames, sum((pucks > 0)::INT)::BIGINT AS with_puck, sum((pucks > 1)::INT)::BIGINT AS multi FROM f")
def a32(det: DataFrame) -> DataFrame:
    f = det.groupBy("frame").agg(F.count_if(F.expr("class_id = 32")).alias("pucks"))
    return f.agg(F.count("*").alias("frames"), F.count_if(F.expr("pucks > 0")).alias("with_puck"), F.count_if(F.expr("pucks > 1")).alias("multi"))


@det_plan("a33_kmeans_teams", None)
def a33(det: DataFrame) -> DataFrame:
    """Two centroids of each run, by the best of ten starts.

    They are fitted on skaters, on all tracked rows where there are fewer
    than two; a run with fewer than two rows gets the default centre twice.
    """
    from ..operators.kmeans import grouped_kmeans

    t = S.tracked(det).select("run_id", "event_id", "x1", "y1", (F.col("class_name") != "goaltender").alias("skater"))
    n = t.groupBy("run_id").agg(F.count_if("skater").alias("skaters"), F.count("*").alias("n"))
    fit = t.join(n, "run_id").where("n >= 2 and (skater or skaters < 2)")
    c = grouped_kmeans(fit, "run_id", "event_id", ["x1", "y1"], 2, starts=10)
    few = n.where("n < 2").select("run_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cluster"), F.lit(128.0).alias("x"), F.lit(128.0).alias("y"))
    return c.select("run_id", "cluster", F.col("centre")[0].alias("x"), F.col("centre")[1].alias("y")).unionByName(few)


@det_plan("a34_nearest_centroid", "@DET SELECT event_id, CASE WHEN (x1 - 700) * (x1 - 700) + (y1 - 300) * (y1 - 300) < (x1 - 300) * (x1 - 300) + (y1 - 200) * (y1 - 200) THEN 1 ELSE 0 END AS team FROM det")
def a34(det: DataFrame) -> DataFrame:
    here = [F.col("x1"), F.col("y1")]
    d0, d1 = (E.squared_distance(here, [F.lit(a), F.lit(b)]) for a, b in ((300, 200), (700, 300)))
    return det.select("event_id", F.when(d1 < d0, 1).otherwise(0).alias("team"))


def _top(n: int) -> str:
    return f"@DET SELECT event_id, track_id, rn FROM (SELECT event_id, track_id, row_number() OVER (PARTITION BY track_id ORDER BY conf_c DESC, frame, event_id) AS rn FROM det WHERE {_T}) WHERE rn <= {n}"


for _n in (8, 15):
    det_plan(f"w01_top_{_n}_samples", _top(_n))(
        lambda det, n=_n: O.top_n(S.tracked(det), ["track_id"], [F.desc("conf_c"), F.col("frame"), F.col("event_id")], n).select("event_id", "track_id", F.col("rn").cast("bigint").alias("rn"))
    )


@det_plan("w02_top_puck", "@DET SELECT event_id, class_id FROM (SELECT event_id, class_id, row_number() OVER (PARTITION BY frame, class_id ORDER BY conf_c DESC, event_id) AS rn FROM det) WHERE class_id <> 32 OR rn = 1")
def w02(det: DataFrame) -> DataFrame:
    return O.top_puck(det).select("event_id", "class_id")


@det_plan("w03_number_islands", f"@DET, s AS (SELECT track_id, team_id, k % 10 AS number, min(frame) AS fs, max(frame) AS fe FROM det WHERE {_T} GROUP BY 1, 2, 3), l AS (SELECT *, CASE WHEN lag(fe) OVER (PARTITION BY team_id, number ORDER BY fs, fe, track_id) < fs THEN 0 ELSE 1 END AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER (PARTITION BY team_id, number ORDER BY fs, fe, track_id) AS island FROM l) SELECT team_id, number, list_sort(list(track_id)) AS ids, min(fs) AS frame_start, arg_max(fe, fs * 1000000000000 + fe * 1000000 + track_id) AS frame_end, count(*) AS n_tracks FROM i GROUP BY team_id, number, island HAVING count(*) >= 2")
def w03(det: DataFrame) -> DataFrame:
    spans = S.tracked(det).groupBy("track_id", "team_id", (F.col("k") % 10).alias("number")).agg(F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))
    return O.number_islands(spans).drop("island")


@det_plan("w04_entity_rank", f"@DET, c AS (SELECT user_id, count(DISTINCT frame) AS covered, min(track_id) AS t FROM det WHERE {_T} GROUP BY user_id) SELECT user_id, covered, row_number() OVER (ORDER BY covered DESC, t) - 1 AS entity_id FROM c")
def w04(det: DataFrame) -> DataFrame:
    """Entities by coverage; counts of equal coverage first, so that no task holds all entities.

    The rank is the number of entities with more coverage plus the place
    among equals; only the table of coverages, as long as there are
    different ones, passes one task.
    """
    c = S.tracked(det).groupBy("user_id").agg(F.countDistinct("frame").alias("covered"), F.min("track_id").alias("t"))
    sizes = c.groupBy("covered").agg(F.count("*").alias("n"))
    before = sizes.select("covered", (F.sum("n").over(W.orderBy(F.desc("covered"))) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("covered").orderBy("t"))
    return c.withColumn("place", place).join(before, "covered").select("user_id", "covered", (F.col("before") + F.col("place") - 1).alias("entity_id"))


@det_plan("w05_preview_rows", f"@DET, t AS (SELECT team_id, track_id, max(conf_c) AS c FROM det WHERE {_T} GROUP BY 1, 2) SELECT team_id, track_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY c DESC, track_id) AS rn FROM t) WHERE rn <= 10")
def w05(det: DataFrame) -> DataFrame:
    t = S.tracked(det).groupBy("team_id", "track_id").agg(F.max("conf_c").alias("c"))
    return O.top_n(t, ["team_id"], [F.desc("c"), F.col("track_id")], 10).select("team_id", "track_id", F.col("rn").cast("bigint").alias("rn"))


@det_plan("w06_trailing_trace", f"@DET SELECT event_id, len(l) AS n, list_sum(l)::BIGINT AS x FROM (SELECT event_id, list(x1) OVER (PARTITION BY track_id ORDER BY frame, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM det WHERE {_T})")
def w06(det: DataFrame) -> DataFrame:
    w = W.partitionBy("track_id").orderBy("frame", "event_id").rowsBetween(-29, 0)
    t = S.tracked(det).select("event_id", F.collect_list("x1").over(w).alias("l"))
    return t.select("event_id", F.size("l").cast("bigint").alias("n"), F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("x"))


@det_plan("w07_first_value", f"@DET SELECT track_id, arg_min(class_name, frame * 10000000 + event_id) AS class_name FROM det WHERE {_T} GROUP BY track_id")
def w07(det: DataFrame) -> DataFrame:
    return S.tracked(det).groupBy("track_id").agg(F.min_by("class_name", F.struct("frame", "event_id")).alias("class_name"))


@det_plan("w08_sample_ordinal", f"@DET SELECT event_id, row_number() OVER (PARTITION BY track_id ORDER BY frame, event_id) - 1 AS ordinal FROM det WHERE {_T}")
def w08(det: DataFrame) -> DataFrame:
    return S.tracked(det).select("event_id", (F.row_number().over(W.partitionBy("track_id").orderBy("frame", "event_id")) - 1).cast("bigint").alias("ordinal"))


_SPLIT = "r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents), q AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE greatest(1, round_even(n * 0.1::DOUBLE, 0)::BIGINT) END AS val FROM r), z AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE greatest(1, n - round_even(n * 0.8::DOUBLE, 0)::BIGINT - val) END AS test FROM q), y AS (SELECT doc_id, source, CASE WHEN rn <= val THEN 'val' WHEN rn <= val + test THEN 'test' ELSE 'train' END AS split FROM z)"


def stratified(df: DataFrame, key: str, label: str, seed: str = "42") -> DataFrame:
    """Split every label 80/10/10 in the order of a hash; labels of fewer than ten rows are for training."""
    val = F.expr("if(n < 10, 0, greatest(1, cast(bround(n * 0.1D) as bigint)))")
    test = F.expr("if(n < 10, 0, greatest(1, n - cast(bround(n * 0.8D) as bigint) - greatest(1, cast(bround(n * 0.1D) as bigint))))")
    d = place_by_hash(df, [label], key, [val, val + test], seed)
    return d.withColumn("split", F.element_at(F.array(F.lit("val"), F.lit("test"), F.lit("train")), F.col("place") + 1)).drop("place")


@plan("w09_stratified_split", f"WITH {_SPLIT} SELECT * FROM y")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    return stratified(read(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source")


@plan("k07_split_manifest", f"WITH {_SPLIT} SELECT split, count(*) AS n, 42 AS seed FROM y GROUP BY split")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    return w09(spark, sf).groupBy("split").agg(F.count("*").alias("n")).withColumn("seed", F.lit(42))


@plan("k07_split_files", f"WITH {_SPLIT} SELECT split, count(*) AS n, count(DISTINCT source) AS sources FROM y GROUP BY split")
def k07_files(spark: SparkSession, sf: str) -> DataFrame:
    """The split written as a folder for each part, and read by its folders."""
    from ..operators.store import shared_path
    from ..sources.sinks import write_split

    path = shared_path(spark, "split")
    write_split(w09(spark, sf), path)
    back = spark.read.schema("doc_id bigint, source string, split string").parquet(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@plan("w10_negative_subsample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels WHERE toxic = 0) WHERE rn <= (SELECT round_even(count(*) * 1.0::DOUBLE, 0)::BIGINT FROM labels WHERE toxic = 1)")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """As many negatives as positives, the first in the order of a hash: places within ranges of it, and no global sort."""
    from ..operators.graph import ranked

    l = read(spark, sf, "labels")
    key = F.concat_ws("|", F.md5(F.col("doc_id").cast("string")), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    n = l.agg(F.bround(F.count_if(F.expr("toxic = 1")) * F.lit(1.0)).cast("bigint").alias("wanted"))
    first = ranked(l.where("toxic = 0").select("doc_id", key.alias("key")), "key").crossJoin(F.broadcast(n))  # one row
    return first.where("i < wanted").select("doc_id")


@plan("w11_group_holdout", "WITH g AS (SELECT source, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(source), source) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT source, lang FROM documents)) SELECT d.doc_id, g.rn <= greatest(1, trunc(g.n * 0.2::DOUBLE)::BIGINT) AS held FROM documents d JOIN g ON d.source = g.source AND d.lang = g.lang")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "source", "lang")
    g = place_by_hash(d.select("source", "lang").distinct(), ["lang"], "source", [F.expr("greatest(1, cast(n * 0.2D as bigint))")])
    return d.join(g, ["source", "lang"]).select("doc_id", (F.col("place") == 0).alias("held"))


@plan("w12_crop_holdout", "SELECT doc_id, rn <= greatest(1, floor(n * 0.15::DOUBLE)::BIGINT) AS held FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "source", "lang")
    d = place_by_hash(d, ["source", "lang"], "doc_id", [F.expr("greatest(1, cast(floor(n * 0.15D) as bigint))")])
    return d.select("doc_id", (F.col("place") == 0).alias("held"))


@det_plan("o01_edge_order", "@DET SELECT user_id, max(conf_c) AS w, row_number() OVER (ORDER BY max(conf_c) DESC, user_id) AS place FROM det GROUP BY user_id ORDER BY 2 DESC, 1")
def o01(det: DataFrame) -> DataFrame:
    """All edges by weight; the place is the number of heavier ones plus the place among equals, so that no task holds all.

    Only the table of weights, as long as there are different ones, passes one task.
    """
    e = det.groupBy("user_id").agg(F.max("conf_c").alias("w"))
    sizes = e.groupBy("w").agg(F.count("*").alias("n"))
    before = sizes.select("w", (F.sum("n").over(W.orderBy(F.desc("w"))) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("w").orderBy("user_id"))
    e = e.withColumn("place", place).join(before, "w").select("user_id", "w", (F.col("before") + F.col("place")).alias("place"))
    return e.orderBy(F.desc("w"), "user_id")


@det_plan("o03_largest_groups", "@DET SELECT track_id, count(*) AS n FROM det WHERE track_id >= 0 GROUP BY track_id ORDER BY n DESC, track_id LIMIT 10")
def o03(det: DataFrame) -> DataFrame:
    return det.where("track_id >= 0").groupBy("track_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "track_id").limit(10)


@det_plan("o02_entities_by_coverage", "@DET SELECT user_id, count(DISTINCT frame) AS covered FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY user_id ORDER BY covered DESC, user_id")
def o02(det: DataFrame) -> DataFrame:
    return S.tracked(det).groupBy("user_id").agg(F.countDistinct("frame").alias("covered")).orderBy(F.desc("covered"), "user_id")


@det_plan("o04_best_detection", "@DET SELECT event_id, conf_c FROM det ORDER BY conf_c DESC, event_id LIMIT 1")
def o04(det: DataFrame) -> DataFrame:
    return det.orderBy(F.desc("conf_c"), "event_id").limit(1).select("event_id", "conf_c")


@det_plan("o05_first_samples", "@DET SELECT event_id FROM det ORDER BY event_id LIMIT 30")
def o05(det: DataFrame) -> DataFrame:
    return det.orderBy("event_id").limit(30).select("event_id")


@det_plan("o06_seeded_sample", "@DET SELECT event_id FROM det ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id LIMIT 200")
def o06(det: DataFrame) -> DataFrame:
    return det.orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("42"))), "event_id").limit(200).select("event_id")
