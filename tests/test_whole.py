"""Queries that must read whole tables, against counts and brute force over all rows."""

import numpy as np
import pytest

from tessera.plans import PLANS
from tessera.plans.aggregates import o01
from tessera.plans.extensions import embedding_teams
from tessera.plans.graphs import track_similarity
from tessera.sources.detections import detections
from tests.conftest import SF


def test_medoid_is_of_all_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id", "embedding").orderBy("vec_id").collect()
    want = {}
    for label in {r["label"] for r in rows}:
        own = [r for r in rows if r["label"] == label]
        v = np.array([r["embedding"] for r in own], float)
        want[label] = own[int(np.round((v @ v.T).sum(1), 9).argmax())]["vec_id"]
    assert max(want.values()) >= 300  # the ids that the sample leaves out
    assert {r["label"]: r["vec_id"] for r in PLANS["a19_medoid"](spark, SF).collect()} == want


def test_overtime_is_told_of_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = PLANS["p33_overtime"](spark, SF)
    assert got.count() == orders.count()
    assert got.where("overtime").count() == orders.where("o_orderkey % 3 = 0 or upper(o_orderpriority) like 'PROL%'").count()


def test_every_edge_has_a_place(spark):
    best = detections(spark, SF).groupBy("user_id").agg({"conf_c": "max"}).collect()
    want = [(u, w, i + 1) for i, (u, w) in enumerate(sorted(map(tuple, best), key=lambda x: (-x[1], x[0])))]
    assert [(r["user_id"], r["w"], r["place"]) for r in PLANS["o01_edge_order"](spark, SF).collect()] == want


def test_order_of_more_than_fifty_edges(spark):
    rows = [(u, 100 * (u % 7)) for u in range(120)]
    got = o01(spark.createDataFrame(rows, "user_id bigint, conf_c bigint")).collect()
    assert [tuple(r) for r in got] == [(u, w, i + 1) for i, (u, w) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))]


@pytest.mark.parametrize("name", ["f06_number_reader", "k08_graph_payload", "k11_copy_paths"])
def test_every_detection_is_read(spark, name):
    det = detections(spark, SF)
    want = det.where("num is not null").count() if name == "k11_copy_paths" else det.count()
    assert PLANS[name](spark, SF).select("event_id").distinct().count() == want


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def medoid(v):
    return int(np.round((v @ v.T).sum(1), 9).argmax())


def test_teams_come_from_all_components(spark):
    r, rows = np.random.default_rng(1), []
    for label in range(8):  # the first two components are alike
        for _ in range(2 + label):
            rows.append((label, len(rows), [1.0, 1.0, *((5.0 if label % 2 else -5.0) + r.standard_normal(6)).tolist()]))
    got = sorted(map(tuple, embedding_teams(spark.createDataFrame(rows, "label int, vec_id bigint, v array<double>")).collect()))
    for label, vec_id, team, *votes in got:
        own = [x for x in rows if x[0] == label]
        assert vec_id == own[medoid(unit(np.array([x[2] for x in own])))][1]
        assert team == (label + got[0][2]) % 2 and votes[team] == len(own) and votes[1 - team] == 0
    assert [x[0] for x in got] == list(range(8))


def test_similarity_is_that_of_medoids_of_the_surest_samples(spark):
    r = np.random.default_rng(2)
    rows = [(u, 10 * u + t, 1000 * u + 100 * t + i, int(r.integers(0, 9)), r.standard_normal(5).tolist()) for u in (0, 1) for t in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id bigint, track_id bigint, event_id bigint, conf_c bigint, v array<double>")
    got = {(x["a"], x["b"]): x["sim"] for x in track_similarity(df).collect()}
    best = {}
    for t in {x[1] for x in rows}:
        top = sorted(sorted((x for x in rows if x[1] == t), key=lambda x: (-x[3], x[2]))[:15], key=lambda x: x[2])
        v = unit(np.array([x[4] for x in top]))
        best[t] = v[medoid(v)]
    want = {(a, b): best[a] @ best[b] for a in best for b in best if a < b and a // 10 == b // 10}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_track_has_a_vector(spark):
    t = detections(spark, SF).where("class_id = 0 and track_id >= 0").select("user_id", "track_id").distinct().groupBy("user_id").count()
    assert PLANS["f08_edge_similarity"](spark, SF).count() == sum(n * (n - 1) // 2 for _, n in t.collect())
