import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as E
from tessera.operators import bitmaps as M
from tessera.operators.grid import overlapping
from tessera.operators.sampling import chance, choose, intervals, triplets, weighted_sample
from tessera.operators.scan import running_sum


def test_bitmaps_are_sets(spark):
    r = random.Random(1)
    rows = [(r.randrange(6), r.choice([r.randrange(200), 63, 64, 127, -1, 0, 10**9])) for _ in range(700)] + [(1, None), (7, None)]
    of = {}
    for t, f in rows:
        if f is not None:
            of.setdefault(t, set()).add(f)
    df = spark.createDataFrame(rows, "track int, frame bigint")
    w = M.frame_words(df, ["track"])
    assert {(x["track"], x["frame"]) for x in M.frames_of(w).collect()} == {(t, f) for t in of for f in of[t]}
    got = {x["track"]: (x["covered"], x["first_frame"], x["last_frame"]) for x in M.coverage(w, ["track"]).collect()}
    assert got == {t: (len(s), min(s), max(s)) for t, s in of.items()}
    got = {(x["a"], x["b"]): x["shared"] for x in M.shared(w, [], "track").collect()}
    assert got == {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and of[a] & of[b]}
    both = M.merge_words(w.withColumn("team", F.col("track") % 2), ["team"])
    assert {x["team"]: x["covered"] for x in M.coverage(both, ["team"]).collect()} == {t: len(set().union(*(of[k] for k in of if k % 2 == t))) for t in (0, 1)}


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / (max(0, (a[2] - a[0]) * (a[3] - a[1])) + max(0, (b[2] - b[0]) * (b[3] - b[1])) - i + 1e-6)


def test_grid_finds_every_pair_once(spark):
    r = random.Random(3)

    def box():
        w, h = 2 ** r.uniform(-2, 8), 2 ** r.uniform(-2, 8)
        x, y = r.uniform(-300, 300), r.uniform(-50, 50)
        return [x, y, x + w, y + h]

    left = [box() for _ in range(400)] + [[0.0, 0.0, 4.0, 8.0], [0, 0, 0, 5], [5, 5, 1, 9]]
    moved = [[v + r.uniform(-0.2, 0.2) * (b[2] - b[0]) for v in b] for b in left[:400]]
    right = moved + [[0.0, 0.0, 4.0, 8.0], [1.0, 0.0, 5.0, 8.0], [0, 0, 0, 5]]
    l = spark.createDataFrame([(i % 2, i, *map(float, b)) for i, b in enumerate(left)], "frame int, i int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(j % 2, j, *map(float, b)) for j, b in enumerate(right)], "frame int, j int, px1 double, py1 double, px2 double, py2 double")
    pairs = overlapping(l, p, ["frame"], ["x1", "y1", "x2", "y2"], ["px1", "py1", "px2", "py2"])
    met = [(x["i"], x["j"]) for x in pairs.collect()]
    assert len(met) == len(set(met)) < 1500
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if i % 2 == j % 2 and iou(a, b) > 0.5}
    got = {(x["i"], x["j"]) for x in pairs.where(E.iou(["x1", "y1", "x2", "y2"], ["px1", "py1", "px2", "py2"]) > 0.5).collect()}
    assert got == want and len(want) > 150
    with pytest.raises(ValueError):
        overlapping(l, p, ["frame"], [], [], 0.3)


def test_weighted_sample_prefers_weight(spark):
    df = spark.createDataFrame([(i, 9.0 if i % 2 else 1.0) for i in range(4000)] + [(5000, 0.0), (5001, None)], "k int, w double")
    s = weighted_sample(df, "w", "k", 400, "a").collect()
    assert len(s) == 400 == len({x["k"] for x in s}) and sorted(x["place"] for x in s) == list(range(1, 401)) and not {5000, 5001} & {x["k"] for x in s}
    assert 0.85 < sum(x["k"] % 2 for x in s) / 400 < 0.95
    assert {x["k"] for x in weighted_sample(df.repartition(7), "w", "k", 400, "a").collect()} == {x["k"] for x in s}
    assert {x["k"] for x in weighted_sample(df, "w", "k", 400, "b").collect()} != {x["k"] for x in s}
    g = weighted_sample(df.withColumn("g", F.col("k") % 3), "w", "k", 5, "a", ["g"]).collect()
    assert Counter(x["g"] for x in g) == {0: 5, 1: 5, 2: 5}


def test_draws_meet_the_option_that_holds_them(spark):
    weights = [5, 0, 1, 1000, 3, 7]
    o = intervals(spark.createDataFrame(list(enumerate(weights)), "clip int, weight int"), "weight", ["clip"])
    total = sum(weights)
    d = spark.range(total).withColumnRenamed("id", "at")
    got = {x["at"]: x["clip"] for x in choose(d, "at", o, total, 10).collect()}
    assert [got[i] for i in range(total)] == [c for c, w in enumerate(weights) for _ in range(w)]


def test_triplets_hold_their_terms(spark):
    r = random.Random(2)
    rows = [(c, r.randrange(2), c * 1000 + i) for c in range(5) for i in range(3 + 20 * c)] + [(7, 0, 7000), (7, 1, 7001), (8, 0, 8000)]
    team = {(c, x): t for c, t, x in rows}
    crops = spark.createDataFrame(rows, "clip int, team int, crop int")
    got = triplets(crops, spark.range(4000).withColumnRenamed("id", "draw"), "s").collect()
    sizes = Counter((c, t) for c, t, _ in rows)
    weight = {c: min(sizes[c, 0], sizes[c, 1]) * (sizes[c, 0] + sizes[c, 1]) for c in {c for c, _, _ in rows}}
    for x in got:
        assert x["anchor"] != x["positive"] and team[x["clip"], x["anchor"]] == team[x["clip"], x["positive"]] == x["team"] == 1 - team[x["clip"], x["negative"]]
    n = Counter(x["clip"] for x in got)
    assert 8 not in n and 7 not in n and len(got) > 3900 and 0.45 < sum(x["grey"] for x in got) / len(got) < 0.55
    for c in range(5):
        assert abs(n[c] / len(got) - weight[c] / sum(weight.values())) < 0.03
    assert triplets(crops.where("clip = 8"), spark.range(9).withColumnRenamed("id", "draw"), "s").count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 3, i, i) for i in range(500)], "g int, i int, v int")
    got = {x["i"]: x["s"] for x in running_sum(df, ["g"], ["i"], "v", "s", 7).collect()}
    assert got == {i: sum(range(i % 3, i + 1, 3)) for i in range(500)}
    got = {x["i"]: x["s"] for x in running_sum(df, [], ["i"], "v", "s", 7).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(500)}


def test_chance_is_the_md5_of_its_parts(spark):
    import hashlib

    x = spark.range(1).select(chance(F.lit("a"), "id").alias("c")).first()["c"]
    assert x == int(hashlib.md5(b"a:0").hexdigest()[:12], 16) and math.log2(x) < 48
