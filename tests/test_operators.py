"""Edge cases and brute-force models of operators that SQL cannot express."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import exprs as E
from tessera.functions.images import two_means
from tessera.operators import entities as N
from tessera.operators import graph as G
from tessera.operators import tracks as O
from tessera.plans.joins import spatial_top1
from tessera.sources import detections as S
from tessera.streaming import scoreboard as B

import numpy as np


def test_stride_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(60.0, 30.0), (25.0, 10.0), (30.0, 30.0), (24.0, 30.0)], "fps double, want double")
    assert [r[0] for r in rows.select(E.stride("fps", "want")).collect()] == [2, 2, 1, 1]


def test_spatial_join_is_strict_and_many_to_one(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (2, 0, 0, 0, 10, 9), (3, 1, 0, 0, 10, 10)], "event_id int, frame int, x1 int, y1 int, x2 int, y2 int")
    poses = spark.createDataFrame([(0, 0, 0, 0, 10, 10), (0, 1, 0, 0, 10, 10), (1, 0, 0, 0, 5, 10)], "frame int, pose_idx int, px1 int, py1 int, px2 int, py2 int")
    got = sorted((r["event_id"], r["pose_idx"]) for r in spatial_top1(boxes, poses, ["frame"]).collect())
    assert got == [(1, 0), (2, 0)]


def test_islands_compare_with_the_span_before(spark):
    rows = [(1, 0, "9", 0, 10), (2, 0, "9", 2, 3), (3, 0, "9", 5, 6), (4, None, "9", 0, 1), (5, None, "9", 2, 3), (6, 1, "9", 0, 4), (7, 1, "9", 4, 5)]
    df = spark.createDataFrame(rows, "track_id int, team_id int, number string, frame_start int, frame_end int")
    got = sorted((str(r["team_id"]), r["ids"]) for r in O.number_islands(df).collect())
    assert got == [("0", [2, 3]), ("None", [4, 5])]


def test_number_vote_needs_two_and_prefers_the_first_seen(spark):
    rows = [(1, "9", 0), (2, "8", 1), (2, "9", 2), (2, "9", 3), (2, "8", 4), (3, "09", 0), (3, "9", 1), (3, "09", 2)]
    df = spark.createDataFrame([(t, n, 50, f, i) for i, (t, n, f) in enumerate(rows)], "track_id int, num string, conf_c int, frame int, event_id int")
    assert {r["track_id"]: r["number"] for r in O.number_votes(df).collect()} == {1: None, 2: "8", 3: "09"}


def test_align_flip_keeps_ties(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "track_id int, team int")
    b = spark.createDataFrame([(1, 0), (2, 0)], "track_id int, team int")
    assert O.align_flip(a, b).first()["flip"] is False


def model_merge(edges, frames, most=2):
    up, own = {t: t for t in frames}, {t: set(f) for t, f in frames.items()}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for w, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if w < 0.65:
            break
        x, y = sorted((root(a), root(b)))
        if x != y and len(own[x] & own[y]) <= most:
            up[y] = x
            own[x] |= own[y]
    touched = {t for w, a, b in edges if w >= 0.65 for t in (a, b)}
    return sorted((t, root(t)) for t in touched)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_merge_equals_the_global_pass(spark, seed):
    r = random.Random(seed)
    frames = {t: {r.randrange(40) for _ in range(r.randint(1, 6))} for t in range(40)}
    edges = [(round(r.random() * 1.2, 2), a, b) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.08]
    e = spark.createDataFrame([(7, a, b, w) for w, a, b in edges], "run int, a bigint, b bigint, w double")
    f = spark.createDataFrame([(7, t, x) for t, xs in frames.items() for x in xs], "run int, track_id bigint, frame int")
    got = sorted((x["track_id"], x["root"]) for x in N.greedy_merge(e, f, ["run"]).collect())
    assert got == model_merge(edges, frames)


def test_pairwise_conflict_may_be_bridged(spark):
    rows = [(1, 1, 0, "7", 0.9, False, [1.0]), (1, 2, 0, None, 0.0, False, [1.0]), (1, 3, 0, "9", 0.9, False, [1.0])]
    t = spark.createDataFrame(rows, "run int, track_id bigint, team int, number string, number_conf double, goalie boolean, vec array<double>")
    shared = spark.createDataFrame([], "run int, a bigint, b bigint, shared bigint")
    e = N.edges(t, shared, ["run"])
    assert sorted((x["a"], x["b"]) for x in e.collect()) == [(1, 2), (2, 3)]
    frames = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)], "run int, track_id bigint, frame int")
    assert {x["root"] for x in N.greedy_merge(e, frames, ["run"]).collect()} == {1}


def model_bfs(edges, seeds):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    best = {}
    for s, rank in seeds:
        seen, front, hop = {s}, [s], 0
        while front:
            for n in front:
                best[n] = min(best.get(n, (10**9, 0)), (hop, rank))
            front = sorted({m for n in front for m in adj.get(n, ())} - seen)
            seen |= set(front)
            hop += 1
    return sorted((n, h, r) for n, (h, r) in best.items())


def test_nearest_seed(spark):
    r = random.Random(9)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(22)]
    seeds = [("n1", 0), ("n2", 1), ("n3", 2)]
    e, s = spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(seeds, "id string, rank int")
    got = sorted((x["id"], x["hop"], x["rank"]) for x in G.nearest(e, s).collect())
    assert got == model_bfs(edges, seeds)


def test_barriers_are_the_owners_alone(spark):
    e = spark.createDataFrame([("a", "a_py"), ("a_py", "f"), ("b", "b_py"), ("b_py", "f"), ("a", "b")], "source string, target string")
    s = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    owned = spark.createDataFrame([("a", "a"), ("b", "b"), ("a_py", "a"), ("b_py", "b")], "id string, owner string")
    got = {x["id"]: x["seed"] for x in G.nearest_within(e, s, owned).collect()}
    assert got == {"a": "a", "b": "b", "a_py": "a", "b_py": "b", "f": "a"}


def test_documents_round_trip(spark, sf):
    det = S.detections(spark, sf)
    assert S.from_documents(S.to_documents(det)).count() == det.count()


def play(*steps):
    b, out = B.Board(), []
    for at, path, data in steps:
        out.append(b.apply(path, data, float(at)))
    return b, out


def test_score_never_falls_below_zero():
    b, _ = play((0, "/score", {"team": "A", "delta": -1}), (1, "/score", {"team": "A", "delta": 1}))
    assert b.teams["A"].score == 1 and b.rev == 2


def test_penalty_rules():
    add = {"team": "B", "duration": 90}
    b, status = play(*[(i, "/penalty/add", add) for i in range(4)])
    assert status == [200, 200, 200, 404] and b.rev == 3 and {p["duration"] for p in b.teams["B"].penalties} == {120}


def test_penalties_run_with_the_clock_and_expire():
    b, _ = play((0, "/penalty/add", {"team": "A", "duration": 120}), (100, "/clock/start", {}), (219, "/visible", {}))
    assert len(b.teams["A"].penalties) == 1
    b.apply("/visible", {}, 220.0)
    assert not b.teams["A"].penalties and b.clock(220.0) == 1380.0


def test_clock_directions_resets_and_idle_pause():
    b, status = play((0, "/clock/pause", {}), (1, "/clock/start", {}), (2, "/clock/start", {}), (11, "/clock/pause", {}), (12, "/clock/pause", {}))
    assert status == [200] * 5 and b.left == 1490.0
    b.apply("/clock/direction", {"value": "up"}, 13.0)
    b.apply("/clock/start", {}, 20.0)
    assert b.clock(25.0) == 1495.0 and b.apply("/clock/direction", {"value": "sideways"}, 25.0) == 404
    b.apply("/period", {"label": "prol 1"}, 26.0)
    assert b.label == "PROL 1" and b.left == 300.0 and not b.running and not b.up
    b.apply("/period/duration", {"value": 600}, 27.0)
    assert b.left == 300.0
    b.apply("/period/ot_duration", {"value": 200}, 28.0)
    assert b.left == 200.0
    b.apply("/clock/reset", {"seconds": 33.0}, 29.0)
    assert b.clock(40.0) == 33.0


def test_swap_moves_score_and_penalties():
    b, _ = play((0, "/score", {"team": "A", "delta": 2}), (0, "/penalty/add", {"team": "A"}), (0, "/swap", {}))
    assert b.teams["B"].score == 2 and len(b.teams["B"].penalties) == 1 and b.teams["A"].score == 0


def test_stream_equals_batch(spark, tmp_path):
    from tessera.plans import PLANS
    from tessera.plans.live import _ALL, _BODY, commands
    from tests.conftest import SF

    log = commands(S.detections(spark, SF), _ALL, _BODY).where("seq < 200")
    log.repartition(1).sortWithinPartitions("at", "seq").write.parquet(str(tmp_path / "in"))
    stream = B.stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(B.fold(log))
    assert PLANS


def test_board_survives_a_round_trip():
    b, _ = play((0, "/score", {"team": "A", "delta": 2}), (5, "/penalty/add", {"team": "B", "duration": 300}), (6, "/clock/start", {}))
    again = B.Board.load(b.dump())
    assert again == b and json.loads(b.dump())["rev"] == 3


def test_two_means_separates_clusters():
    v = np.concatenate([np.full((20, 3), 10.0), np.full((30, 3), 200.0)])
    assert sorted(two_means(v)[:, 0].tolist()) == [10.0, 200.0]
    assert two_means(np.zeros((1, 3))).shape == (2, 3)


def test_optional_scan(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert S.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    spark.range(3).select(F.col("id").cast("int").alias("a")).write.parquet(str(tmp_path / "some"))
    assert S.read_optional(spark, str(tmp_path / "some"), schema).count() == 3


def run_stream(df, path, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_windows_close_behind_the_watermark(spark, tmp_path, sf):
    from tessera.streaming import windows as V

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    s = V.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), delay="0 seconds")
    run_stream(V.tumbling(s, "1 day", ["event_type"]), tmp_path)
    got = {(str(x["start"]), x["event_type"], x["n"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = V.tumbling(events.withColumn("at", F.col("ts").cast("timestamp")), "1 day", ["event_type"])
    every = {(str(x["start"]), x["event_type"], x["n"]) for x in batch.collect()}
    last = max(s for s, _, _ in every)
    assert got == {x for x in every if x[0] != last}


def test_malformed_commands_change_nothing(spark):
    good, rows = json.dumps({"team": "A", "delta": 2}), []
    bodies = ["{", "[]", "7", json.dumps({"team": "A", "delta": "x"}), json.dumps({"team": "A", "delta": None}), json.dumps({"delta": 1}), None, good]
    rows = [(1, i, i, "/score", b) for i, b in enumerate(bodies)]
    got = B.fold(spark.createDataFrame(rows, "match_id bigint, seq bigint, at bigint, path string, body string")).orderBy("seq").collect()
    assert [x["status"] for x in got] == [400, 400, 400, 400, 400, 404, 404, 200] and [x["rev"] for x in got] == [0] * 7 + [1]
    assert got[-1]["score_a"] == 2


def test_values_are_read_as_the_protocol_reads_them():
    b, status = play((0, "/penalty/add", {"team": "A", "duration": "300"}), (0, "/visible", {"value": "false"}), (0, "/clock/reset", {"seconds": 7}), (0, "/period", {"label": "p2", "resetClock": 0}))
    assert status == [200] * 4 and b.teams["A"].penalties[0]["duration"] == 300 and b.visible and b.left == 7.0 and b.label == "P2"
    b.apply("/visible", {"value": 0}, 1.0)
    assert not b.visible and b.apply("/score/set", {"team": "B", "value": "nine"}, 1.0) == 400 and b.apply("/score/set", {"team": "B"}, 1.0) == 404


def test_search_goes_on_until_nothing_is_new(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)], "source string, target string")
    s = spark.createDataFrame([("n000", 0)], "id string, rank int")
    assert {x["id"]: x["hop"] for x in G.nearest(e, s).collect()} == {f"n{i:03d}": i for i in range(71)}
    with pytest.raises(RuntimeError):
        G.nearest(e, s, most=5)


def test_places_within_ranges(spark):
    r = random.Random(3)
    ids = r.sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {x["id"]: (x["i"], x["n"]) for x in G.ranked(df, "id", 7).collect()}
    assert got == {x: (i, 500) for i, x in enumerate(sorted(ids))} and G.ranked(df.limit(0), "id").count() == 0


def test_grouped_means_equal_the_local_ones(spark):
    from tessera.functions.images import grouped_two_means

    r = np.random.default_rng(0)
    rows = [(g, float(x), float(y)) for g in range(5) for x, y in r.integers(0, 50, (1 + 20 * g, 2)) + 60 * r.integers(0, 2, (1 + 20 * g, 1))]
    got = {x["g"]: [[x["x_0"], x["y_0"]], [x["x_1"], x["y_1"]]] for x in grouped_two_means(spark.createDataFrame(rows, "g int, x double, y double"), "g", ["x", "y"]).collect()}
    for g in range(5):
        own = sorted((x, y) for gg, x, y in rows if gg == g)
        assert np.allclose(got[g], two_means(np.array(own)))


def test_writers_get_whole_runs_in_order(spark, tmp_path):
    from contextlib import contextmanager

    from tessera.sources.sinks import write_runs, write_runs_stream

    base = str(tmp_path)

    @contextmanager
    def writer(run):
        with open(f"{base}/{run['run']}.txt", "w") as f:
            yield lambda row: f.write(f"{row['frame']}\n")

    r = random.Random(1)
    rows = [(run, f) for run in range(6) for f in range(30)]
    r.shuffle(rows)
    plan = spark.createDataFrame(rows, "run int, frame int").repartition(5)
    for write in (lambda p: write_runs(p, ["run"], ["frame"], writer), lambda p: write_runs_stream(["run"], ["frame"], writer)(p, 0)):
        write(plan)
        assert all((tmp_path / f"{run}.txt").read_text().split() == [str(f) for f in range(30)] for run in range(6))
