"""What holds whatever the size: no broadcasts of what grows, bounded groups, rounding as SQL has it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as E


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_goes_by_the_scaled_number(spark):
    x = [-0.0681559884495, 0.0681559884495, 0.5, -2.5, 1e-13, 0.0]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 12)", [v]).fetchone()[0] for v in x]
    got = [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(E.rounded("x", 12).alias("y")).collect()]
    assert got == want


def test_boxes_meet_without_a_broadcast(spark):
    from tessera.operators.grid import overlapping

    a, b = ["x1", "y1", "x2", "y2"], ["px1", "py1", "px2", "py2"]
    rows = [(1, 0.0, 0.0, 40.0, 80.0)]
    l, r = (spark.createDataFrame(rows, f"frame int, {', '.join(f'{c} double' for c in x)}") for x in (a, b))
    j = overlapping(l, r, ["frame"], a, b)
    assert "SortMergeJoin" in planned(j) and "Broadcast" not in planned(j) and j.count() == 1


def test_shared_frames_of_long_sets_without_pairs_in_a_shuffle(spark):
    import random

    from tessera.operators import bitmaps as M

    r = random.Random(3)
    sets = {(k, m): {r.randrange(b, b + w) for _ in range(n)} for k in range(3) for m, (b, w, n) in enumerate([(0, 90, 30), (0, 5000, 400), (40, 3000, 300), (500, 60, 20), (4000, 50, 10), (-700, 1500, 90), (9000, 5, 3)])}
    rows = [(k, m, f) for (k, m), fs in sets.items() for f in fs]
    df = M.shared(M.frame_words(spark.createDataFrame(rows, "k int, m int, frame bigint"), ["k", "m"]), ["k"], "m")
    want = {(k, a, b): len(sets[k, a] & sets[k, b]) for k in range(3) for a in range(7) for b in range(a + 1, 7) if sets[k, a] & sets[k, b]}
    assert {(x["k"], x["a"], x["b"]): x["shared"] for x in df.collect()} == want
    plan = planned(df)
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def rows_shuffled(spark):
    """Rows that this session's stages have written to shuffles so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(60_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def meetings(sets):
    return sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b])


def shared_of(spark, sets):
    from tessera.operators import bitmaps as M

    words = M.frame_words(spark.createDataFrame([(1, m, f) for m, fs in sets.items() for f in fs], "k int, m int, frame bigint"), ["k", "m"])
    return sorted((x["a"], x["b"], x["shared"]) for x in M.shared(words, ["k"], "m").collect())


def test_members_of_many_blocks_are_shuffled_once_for_each_frame(spark, monkeypatch):
    from tessera.operators import bitmaps as M

    monkeypatch.setattr(M, "BLOCK", 16)
    sets = {m: {m % 50, 50 + m * 7 % 60} for m in range(300)}
    before = rows_shuffled(spark)
    assert shared_of(spark, sets) == meetings(sets)
    # all of them in each of 19 blocks would be 5,700 rows
    assert rows_shuffled(spark) - before < 4000


def test_audit_of_one_entity_shuffles_its_tracks_and_not_blocks_of_them(spark, monkeypatch):
    from tessera.operators import bitmaps as M
    from tessera.operators import entities as N

    monkeypatch.setattr(M, "BLOCK", 16)
    sets = {m: {m % 50, 50 + m * 7 % 60} for m in range(300)}
    det = spark.createDataFrame([(1, m, f) for m, fs in sets.items() for f in fs], "run_id int, track_id bigint, frame bigint")
    members = spark.createDataFrame([(1, m, m % 2) for m in sets], "run_id int, track_id bigint, root int")
    before = rows_shuffled(spark)
    got = N.violations(members, det, ["run_id"], most=0).collect()
    assert sorted((x["a"], x["b"], x["shared"]) for x in got) == sorted(x for i in range(2) for x in meetings({m: s for m, s in sets.items() if m % 2 == i}))
    # with each half in all of its 10 blocks they are 4,432 rows
    assert rows_shuffled(spark) - before < 4000


@pytest.mark.parametrize("block, slice_", [(8192, 512), (4, 3)])
def test_equal_long_and_negative_sets_meet_once(spark, monkeypatch, block, slice_):
    import random

    from tessera.operators import bitmaps as M

    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SLICE", slice_, raising=False)
    r = random.Random(5)
    kinds = [{63}, {0, 63, 64}, set(range(60, 70)), set(range(0, 2000, 90)), {-1, -64, -65, 500}, {-1, 63, 511, 512}, {3, 700}]
    kinds += [{r.randrange(-100, 700) for _ in range(r.choice([2, 9, 40]))} for _ in range(8)]
    sets = dict(enumerate(kinds * 3))
    assert shared_of(spark, sets) == meetings(sets)


def test_lonely_tracks_are_told_without_pairs(spark, sf):
    from tessera.plans import PLANS

    assert "Inner" not in planned(PLANS["g04_lonely_tracks"](spark, sf))


@pytest.mark.parametrize("name", ["st07_direction_adjust", "st10_penalty_expiry", "st16_malformed_commands"])
def test_matches_are_folded_batch_by_batch(spark, sf, name):
    from tessera.plans import PLANS

    df = PLANS[name](spark, sf)
    assert "FlatMapGroups" not in planned(df)
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, df.collect()))
    try:
        spark.conf.set(key, "7")
        assert sorted(map(tuple, PLANS[name](spark, sf).collect())) == want
    finally:
        spark.conf.set(key, size)


def test_penalties_meet_no_spans(spark, sf):
    from tessera.plans import PLANS

    assert "until" not in planned(PLANS["st09_penalty_countdown"](spark, sf))


def test_catching_up_joins_no_revisions(spark):
    from tessera.streaming.timers import catch_up

    now = spark.createDataFrame([(1, 9), (2, 3)], "match_id bigint, rev bigint")
    of = [(1, r, "x", 200) for r in (1, 2, 4, 7, 7, 9, 11)] + [(2, 3, "expired", None), (2, 2, "x", 404)]
    happened = spark.createDataFrame(of, "match_id bigint, rev bigint, path string, status int")
    clients = spark.createDataFrame([(5, 1, 3), (6, 1, 9), (7, 1, 20), (8, 2, 0), (9, 2, 3)], "user_id bigint, match_id bigint, seen bigint")
    df = catch_up(clients, now, happened)
    assert {r["user_id"]: r["missed"] for r in df.collect()} == {5: 3, 6: 0, 7: 0, 8: 1, 9: 0}
    assert "(of#" not in planned(df) or "seen" not in "".join(x for x in planned(df).split("\n") if "Join" in x)


def test_medoids_of_bounded_groups_equal_the_others(spark):
    from tessera.operators import tracks as O

    rows = spark.range(300).selectExpr("id % 37 as g", "id as e", "array(sin(id), cos(id * 3), (id % 5) / 4D) as v")
    df = O.bounded_medoids(rows, ["g"], "e")
    assert sorted((r["g"], r["e"]) for r in df.collect()) == sorted((r["g"], r["e"]) for r in O.medoids(rows, ["g"], "e").collect())
    assert "Generate" not in planned(df)


def crops(n, seed=0):
    import numpy as np

    r = np.random.default_rng(seed)
    return [r.integers(0, 256, (int(r.integers(1, 40)), int(r.integers(1, 22)), 3)).astype(np.uint8) // int(r.integers(1, 9)) for _ in range(n)]


def test_images_at_once_equal_single_ones():
    import numpy as np

    from tessera.functions import images as I

    x = crops(300)
    assert I.grid_colors(x) == [I.grid_color(i) for i in x]
    assert np.array_equal(I.letterboxed_all(x, 16, 32), np.stack([I.letterboxed(i, 16, 32) for i in x]))


def test_convolution_equals_its_sum_of_shifts():
    import numpy as np

    from tessera.functions import images as I

    r = np.random.default_rng(1)
    x, kernel = r.random((5, 6, 7, 3)).astype(np.float32), r.standard_normal((3, 3, 3, 4)).astype(np.float32)
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    want = sum(padded[:, i : i + 6, j : j + 7] @ kernel[i, j] for i in range(3) for j in range(3))
    assert np.allclose(I.convolution(x, kernel), np.maximum(want, 0), atol=1e-5)


def test_many_tracks_and_few_boxes_are_assigned_quickly():
    import time

    import numpy as np

    from tessera.operators.tracking import assign

    r = np.random.default_rng(0)
    cost = np.where(r.random((1000, 70)) < 0.05, r.random((1000, 70)), 1.0)
    began = time.time()
    got = assign(cost, 0.9)
    assert time.time() - began < 2  # 18 seconds from the side of the tracks
    assert len(got) == 70 and len({j for _, j in got}) == 70 and all(cost[i, j] <= 0.9 for i, j in got)


def test_blocks_grow_late_and_the_best_are_exact(spark):
    import numpy as np

    from tessera.operators import neighbours as N

    got = [r["b"] for r in spark.createDataFrame([(1,), (2001,), (100_000,), (300_000,)], "n bigint").select(N.blocks(F.col("n")).alias("b")).collect()]
    assert got == [1, 2, 16, 19]
    r = np.random.default_rng(0)
    sim = np.round(r.random((40, 300)), 2)
    sim[:, :3] = -np.inf
    row, column = N.best_of(sim, np.arange(300), 15)
    want = np.argsort(-sim, axis=1, kind="stable")[:, :15]
    assert np.array_equal(column.reshape(40, 15), want) and np.array_equal(row, np.repeat(np.arange(40), 15))


def test_components_share_a_call(spark, sf):
    from tessera.plans import PLANS

    assert "pmod" in planned(PLANS["g01_greedy_merge"](spark, sf))


def test_learnt_texts_have_the_models_own_vectors():
    import numpy as np

    from tessera.llm import quality as Q

    r = np.random.default_rng(0)
    x = r.integers(0, 4, (60, 128)).astype(np.float32)
    m = Q.learn(x, r.integers(0, 2, 60).astype(float), 16, 9)
    assert m.refs.dtype == np.float32 and np.allclose(m.refs, m.vectors(x), atol=1e-5)
