"""Iterative and graph operators (G), and the entity merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import entities as N
from ..operators import graph as G
from ..operators import tracks as O
from ..operators.components import connected_components
from ..sources import detections as S
from .base import det_plan, plan, read
from .joins import track_table

_GRAPH = "e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation WHERE n_nationkey % 6 <> 5 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_suppkey % 7 <> 0 UNION SELECT 's' || s_suppkey, 's' || (s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 = 1)"


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: regions as phases, nations as stages, suppliers as the rest; some hang loose."""
    t = lambda p, c: F.concat(F.lit(p), F.expr(c).cast("string"))
    n, s, r = (read(spark, sf, x) for x in ("nation", "supplier", "region"))
    edges = n.where("n_nationkey % 6 <> 5").select(t("n", "n_nationkey").alias("source"), t("r", "n_regionkey").alias("target"))
    edges = edges.union(s.where("s_suppkey % 7 <> 0").select(t("s", "s_suppkey"), t("n", "s_nationkey")))
    edges = edges.union(s.where("s_suppkey % 3 = 1").select(t("s", "s_suppkey"), t("s", "s_suppkey + 1")))
    nodes = r.select(t("r", "r_regionkey").alias("id")).union(n.select(t("n", "n_nationkey"))).union(s.select(t("s", "s_suppkey")))
    return nodes, edges


def phases(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_regionkey").cast("int").alias("rank"))


def run_edges(det: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admissible edges and coarse frames; a user's tracks are one run."""
    coarse = S.tracked(det).withColumn("frame", F.expr("frame div 10"))
    return N.edges(track_table(det), N.shared_frames(coarse, ["user_id"]), ["user_id"]), coarse


@det_plan("g01_greedy_merge", None)
def g01(det: DataFrame) -> DataFrame:
    edges, frames = run_edges(det)
    return N.greedy_merge(edges, frames, ["user_id"])


@det_plan("g02_components", "@DET SELECT track_id AS node, min(track_id) OVER (PARTITION BY user_id) AS component FROM (SELECT DISTINCT user_id, track_id, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, track_id FROM det WHERE class_id = 0 AND track_id >= 0)) WHERE n > 1")
def g02(det: DataFrame) -> DataFrame:
    """Tracks chained to the next of their user."""
    t = S.tracked(det).select("user_id", "track_id").distinct()
    chain = t.withColumn("dst", F.lead("track_id").over(W.partitionBy("user_id").orderBy("track_id"))).where("dst is not null")
    return connected_components(chain.select(F.col("track_id").alias("src"), "dst"))


@det_plan("g03_invariant_audit", "SELECT 1 AS violations WHERE FALSE")
def g03(det: DataFrame) -> DataFrame:
    """No two tracks of an entity share more frames than allowed; empty by construction."""
    edges, frames = run_edges(det)
    return N.violations(N.greedy_merge(edges, frames, ["user_id"]), frames, ["user_id"]).select(F.lit(1).alias("violations"))


@det_plan("g04_unmatched", "@DET, t AS (SELECT track_id, user_id, min(team_id) AS team, count(*) AS n FROM det WHERE class_id = 0 AND track_id >= 0 GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM t) SELECT track_id FROM c WHERE size = 1 OR n % 5 = 0 AND size = 1")
def g04(det: DataFrame) -> DataFrame:
    """Tracks alone in their entity."""
    t = S.tracked(det).groupBy("track_id", "user_id").agg(F.count("*").alias("n"))
    return t.withColumn("size", F.count("*").over(W.partitionBy("user_id"))).where("size = 1").select("track_id")


#: SQL knows no search that stops by itself; no node of these graphs is this far away.
_FAR = 12
_PAIRS = f"{_GRAPH}, u AS (SELECT source, target FROM e UNION SELECT target, source FROM e)"
_SHARED = "@DET, f AS (SELECT DISTINCT run_id, frame // 10 AS frame, track_id FROM det WHERE class_id = 0 AND track_id >= 0), p AS (SELECT l.run_id, l.track_id AS a, r.track_id AS b, count(*) AS shared FROM f l JOIN f r ON l.run_id = r.run_id AND l.frame = r.frame AND l.track_id < r.track_id GROUP BY 1, 2, 3)"


def run_frames(det: DataFrame) -> DataFrame:
    return S.tracked(det).withColumn("frame", F.expr("frame div 10"))


@det_plan("g03_audit_of_runs", f"{_SHARED} SELECT run_id, a, b, shared FROM p")
def g03_runs(det: DataFrame) -> DataFrame:
    """The audit over a grouping that does not hold: all tracks of a run as one entity, and no frame allowed."""
    coarse = run_frames(det)
    members = coarse.select("run_id", "track_id", F.col("run_id").alias("root")).distinct()
    return N.violations(members, coarse, ["run_id"], most=0).select("run_id", "a", "b", "shared")


@det_plan("g04_lonely_tracks", f"{_SHARED} SELECT DISTINCT track_id FROM f WHERE track_id NOT IN (SELECT a FROM p UNION ALL SELECT b FROM p)")
def g04_lonely(det: DataFrame) -> DataFrame:
    """Tracks that share a stretch of frames with no other of their run: told by the frames that have one track, without any pair."""
    coarse = run_frames(det).select("run_id", "frame", "track_id")
    seen = coarse.groupBy("run_id", "frame").agg((F.min("track_id") < F.max("track_id")).alias("met"))
    return coarse.join(seen, ["run_id", "frame"], "left").groupBy("track_id").agg(F.bool_or(F.coalesce("met", F.lit(False))).alias("met")).where("not met").select("track_id")


_BFS = f"WITH RECURSIVE {_PAIRS}, b AS (SELECT 'r' || r_regionkey AS id, 0 AS hop, r_regionkey::INT AS rank FROM region UNION SELECT u.target, b.hop + 1, b.rank FROM b JOIN u ON b.id = u.source WHERE b.hop < {_FAR})"


@plan("g05_nearest_phase", f"{_BFS} SELECT id, hop, min(rank) AS rank FROM b WHERE (id, hop) IN (SELECT (id, min(hop)) FROM b GROUP BY id) GROUP BY id, hop")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    return G.nearest(graph(spark, sf)[1], phases(spark, sf))


@plan("g06_stage_attribution", f"WITH RECURSIVE {_PAIRS}, o AS (SELECT 'n' || n_nationkey AS id, 'n' || n_nationkey AS own FROM nation UNION ALL SELECT 'r' || r_regionkey, 'nobody' FROM region), v AS (SELECT u.source, u.target, o.own FROM u LEFT JOIN o ON o.id = u.target), b AS (SELECT 'n' || n_nationkey AS id, 0 AS hop, n_nationkey::INT AS rank, 'n' || n_nationkey AS seed FROM nation UNION SELECT v.target, b.hop + 1, b.rank, b.seed FROM b JOIN v ON b.id = v.source WHERE b.hop < {_FAR} AND (v.own IS NULL OR v.own = b.seed)) SELECT id, hop, rank, seed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hop, rank, seed) AS rn FROM b) WHERE rn = 1")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by their nearest stage; phases and other stages may not be entered."""
    n = read(spark, sf, "nation")
    stage = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("int").alias("rank"))
    owned = stage.select("id", F.col("id").alias("owner")).union(phases(spark, sf).select("id", F.lit("nobody")))
    return G.nearest_within(graph(spark, sf)[1], stage, owned)


@plan("g07_orphans", f"{_BFS}, l AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT 'r' || r_regionkey AS id FROM region UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 's' || s_suppkey FROM supplier) WHERE id NOT IN (SELECT id FROM b)), c AS (SELECT *, greatest(1, ceil(sqrt(n)))::BIGINT AS cols FROM l) SELECT id, ((i % cols) - cols / 2.0::DOUBLE) * 36.0::DOUBLE AS x, ((i // cols) - cols / 2.0::DOUBLE) * 36.0::DOUBLE AS y FROM c")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that no phase reaches, laid out in a grid."""
    nodes, edges = graph(spark, sf)
    lost = G.ranked(nodes.distinct().join(G.nearest(edges, phases(spark, sf)), "id", "left_anti"), "id")
    x, y = G.grid(F.col("i"), F.col("n"))
    return lost.select("id", x.alias("x"), y.alias("y"))


@plan("j16_direct_stages", f"WITH {_GRAPH} SELECT source AS id, string_agg(target, ',' ORDER BY target) AS stages FROM (SELECT DISTINCT source, target FROM e WHERE source LIKE 's%' AND target LIKE 'n%') GROUP BY source")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    e = graph(spark, sf)[1].where("source like 's%' and target like 'n%'")
    return e.groupBy(F.col("source").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("target")), ",").alias("stages"))


@plan("s11_graph_document", f"WITH {_GRAPH} SELECT source, target FROM e")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """The graph as one JSON document, read back and unnested."""
    e = graph(spark, sf)[1]
    doc = e.groupBy("target").agg(F.to_json(F.struct(F.collect_list(F.struct("source", "target")).alias("edges"))).alias("doc"))
    back = doc.select(F.explode(F.from_json("doc", "edges array<struct<source:string,target:string>>")["edges"]).alias("e"))
    return back.select("e.source", "e.target")


_LABELS = f"WITH {_GRAPH}, x AS (SELECT DISTINCT source, target FROM e WHERE target NOT LIKE 'r%' AND source <> target), u AS (SELECT source, target FROM x UNION SELECT target, source FROM x), l0 AS (SELECT DISTINCT source AS id, source AS label FROM u)" + "".join(
    f", l{i} AS (SELECT id, label FROM (SELECT u.source AS id, l.label, row_number() OVER (PARTITION BY u.source ORDER BY count(*) DESC, l.label) AS rn FROM u JOIN l{i - 1} l ON l.id = u.target GROUP BY u.source, l.label) WHERE rn = 1)" for i in range(1, 6)
)


@plan("g08_label_communities", f"{_LABELS} SELECT id, label FROM l5")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph without its phases, by label propagation."""
    return G.label_propagation(graph(spark, sf)[1].where("target not like 'r%'"))


@plan("g08_modularity", None)
def g08_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph without its phases, by modularity, level by level."""
    from ..operators.communities import louvain

    return louvain(graph(spark, sf)[1].where("target not like 'r%'"))


@plan("g13_graph_components", f"WITH RECURSIVE {_GRAPH}, x AS (SELECT source, target FROM e WHERE target NOT LIKE 'r%'), u AS (SELECT source, target FROM x UNION SELECT target, source FROM x), c AS (SELECT source AS node, source AS reached FROM u UNION SELECT c.node, u.target FROM c JOIN u ON u.source = c.reached) SELECT node, min(reached) AS component FROM c GROUP BY node")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the graph without its phases."""
    e = graph(spark, sf)[1].where("target not like 'r%'")
    return connected_components(e.select(F.col("source").alias("src"), F.col("target").alias("dst")))


@plan("g10_projection", None)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings on their three main axes."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = read(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    return PCA(k=3, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", vector_to_array("p").alias("p"))


def clip_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as crops: a label is a track, five tracks are a clip."""
    return read(spark, sf, "embeddings").select(F.expr("label div 5").alias("clip"), "label", "vec_id", "embedding")


@plan("g10_neighbour_graph", None)
def g10_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The fuzzy graph of each crop's 15 nearest neighbours in its clip, by cosine."""
    from ..operators.neighbours import fuzzy, nearest

    g = fuzzy(nearest(clip_vectors(spark, sf), "clip", "vec_id", "embedding"))
    return g.select(F.col("grp").alias("clip"), "src", "dst", F.round("w", 6).alias("w"))


@plan("g10_spectral", None)
def g10_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Crops on three axes that keep neighbours together, the leading eigenvectors of that graph."""
    from ..operators.neighbours import fuzzy, nearest, spectral

    x = spectral(fuzzy(nearest(clip_vectors(spark, sf), "clip", "vec_id", "embedding")), 3, 20)
    return x.select(F.col("grp").alias("clip"), F.col("id").alias("vec_id"), "x")


@plan("g11_layouts", "SELECT n_name, round(110 * (0.5::DOUBLE + CAST('0x' || substring(sha1(n_name), 17, 8) AS BIGINT) / 4294967295.0::DOUBLE * 0.5::DOUBLE) * (CAST('0x' || substring(sha1(n_name), 9, 8) AS BIGINT) / 4294967295.0::DOUBLE * 2 - 1), 6) AS dy FROM nation")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_name", E.rounded(G.galaxy(F.col("n_name"))["dy"], 6).alias("dy"))


@plan("g11_spiral", "SELECT n_nationkey, round(20 * (1 + 0.15::DOUBLE * n_nationkey) * sin(radians(least((15 + 29 * n_nationkey) % 120, 120 - (15 + 29 * n_nationkey) % 120))), 6) AS dz FROM nation")
def g11s(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", E.rounded(G.spiral(F.col("n_nationkey"), 20.0)["dz"], 6).alias("dz"))


@plan("g12_zigzag_pins", "SELECT n_nationkey AS id, n_regionkey * 200 AS x, (CASE WHEN n_regionkey % 2 = 0 THEN -1 ELSE 1 END) * (60 + 40 * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))) AS y FROM nation")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    way = F.when(F.col("n_regionkey") % 2 == 0, -1).otherwise(1)
    i = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") * 200).alias("x"), (way * (60 + 40 * i)).cast("bigint").alias("y"))


_F08 = f"""WITH det AS ({S.DET_SQL}), e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT user_id, track_id, event_id, row_number() OVER (PARTITION BY user_id, track_id ORDER BY conf_c DESC, event_id) AS rn, event_id % (SELECT count(*) FROM embeddings) AS slot FROM det WHERE class_id = 0 AND track_id >= 0),
t AS (SELECT user_id, track_id, event_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 0.000000001::DOUBLE)) AS v FROM d JOIN e ON d.slot = e.slot WHERE rn <= 15),
s AS (SELECT a.user_id, a.track_id, a.event_id, any_value(a.v) AS v, round(sum(list_inner_product(a.v, b.v)), 9) AS s FROM t a JOIN t b ON a.track_id = b.track_id AND a.user_id = b.user_id GROUP BY 1, 2, 3),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, track_id ORDER BY s DESC, event_id) AS rn FROM s) WHERE rn = 1)
SELECT l.user_id, l.track_id AS a, r.track_id AS b, round(list_inner_product(l.v, r.v), 9) AS sim FROM m l JOIN m r ON l.user_id = r.user_id AND l.track_id < r.track_id"""


@plan("f08_edge_similarity", _F08)
def f08(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each user's pairs of tracks.

    Detections have no images here; the vector of one is that whose place
    is ``event_id`` modulo the count of vectors.
    """
    e = G.ranked(read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id")
    det = S.tracked(S.detections(spark, sf)).select("user_id", "track_id", "event_id", "conf_c")
    n = read(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    # the samples are chosen before they get their vectors
    det = sampled(det).crossJoin(F.broadcast(n)).withColumn("slot", F.expr("pmod(event_id, n)"))  # one row
    both = det.drop("n").join(e.select(F.col("i").alias("slot"), "v").hint("merge"), "slot")
    return sample_similarity(both).select("user_id", "a", "b", E.rounded("sim", 9).alias("sim"))


TRACK = ["user_id", "track_id"]


def sampled(rows: DataFrame, samples: int = 15) -> DataFrame:
    """The surest detections of each track."""
    return O.top_n(rows, TRACK, [F.desc("conf_c"), F.col("event_id")], samples).drop("rn")


def track_similarity(rows: DataFrame, samples: int = 15) -> DataFrame:
    """The product of the medoids of each user's pairs of tracks.

    A track's medoid is that of the unit vectors of its ``samples`` surest
    detections. ``rows(user_id, track_id, event_id, conf_c, v)``.
    """
    return sample_similarity(sampled(rows, samples))


def sample_similarity(top: DataFrame) -> DataFrame:
    """As ``track_similarity``, of rows that are the samples."""
    g = top.select(*TRACK, "event_id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    m = O.bounded_medoids(g.withColumn("v", E.unit("v")), TRACK, "event_id")
    p = m.alias("l").join(m.alias("r").hint("merge"), F.expr("l.user_id = r.user_id and l.track_id < r.track_id"))
    return p.select("l.user_id", F.col("l.track_id").alias("a"), F.col("r.track_id").alias("b"), E.dot("l.v", "r.v").alias("sim"))
