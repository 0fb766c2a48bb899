import itertools
import random

import numpy as np
import pytest

from tessera.operators.tracking import Settings, assign, follow, track_boxes


def test_assignment_is_the_best_of_all():
    r = np.random.default_rng(4)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (4, 4), (0, 3), (6, 6)]:
        for _ in range(15):
            cost = r.random((n, m)).round(2)
            most = r.choice([0.3, 0.6, 1.0])
            got = assign(cost, most)
            assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) and all(cost[i, j] <= most for i, j in got)
            best = 0.0
            for k in range(min(n, m) + 1):
                for rows in itertools.combinations(range(n), k):
                    for cols in itertools.permutations(range(m), k):
                        best = min(best, sum(min(cost[i, j] - most, 0) for i, j in zip(rows, cols)))
            assert sum(cost[i, j] - most for i, j in got) == pytest.approx(best, abs=1e-9)


def planted(frames=300, objects=5, seed=2):
    """Objects on lines of their own, some of which cross; each is unsure for a while and unseen for a while."""
    r = random.Random(seed)
    rows, n = [], 0
    for f in range(frames):
        for o in range(objects):
            if 100 + 10 * o <= f < 110 + 10 * o:
                continue
            x = 50 + 3 * f if o % 2 else 950 - 3 * f
            y = 100 + 60 * o + (f * 0.2 if o < 3 else 0)
            score = 0.15 if 40 + 5 * o <= f < 50 + 5 * o else 0.8
            rows.append((1, f, n, x + r.uniform(-1, 1), y + r.uniform(-1, 1), x + 60.0, y + 120.0, score, o))
            n += 1
        rows.append((1, f, n, 10.0 * (f % 7), 700.0, 10.0 * (f % 7) + 20, 740.0, 0.05, -1))
        n += 1
    return rows


SHAPE = "run int, frame bigint, event_id bigint, x1 double, y1 double, x2 double, y2 double, score double, truth int"


@pytest.mark.parametrize("chunk,overlap", [(10_000, 200), (60, 30)])
def test_planted_objects_keep_their_track(spark, chunk, overlap):
    rows = planted() + [(2, f, 100_000 + f, 5.0, 5.0, 50.0, 90.0, 0.9, 9) for f in range(130)]
    got = {x["event_id"]: x["track"] for x in track_boxes(spark.createDataFrame(rows, SHAPE), "run", chunk, overlap).collect()}
    assert len(got) == len(rows)
    of = {}
    for r in rows:
        of.setdefault(r[8], set()).add(got[r[2]])
    assert of.pop(-1) == {None}
    assert all(len(s) == 1 for s in of.values()) and len(set().union(*of.values())) == len(of)


def test_nothing_and_lonely_boxes(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert track_boxes(empty, "run").count() == 0
    rows = [(1, 5, 1, 0.0, 0.0, 9.0, 9.0, 0.9, 0), (1, 400, 2, 0.0, 0.0, 9.0, 9.0, 0.9, 0), (1, None, 3, 0.0, 0.0, 9.0, 9.0, 0.9, 0), (1, 401, 4, 0.0, 0.0, 0.0, 0.0, 0.9, 0)]
    got = {x["event_id"]: x["track"] for x in track_boxes(spark.createDataFrame(rows, SHAPE), "run").collect()}
    assert set(got) == {1, 2, 4} and got[1] != got[2]


def test_tentative_tracks_need_a_second_box():
    """A box that is seen once after the first frame begins a track that is dropped when the next frame does not show it."""
    frames = np.array([0, 1, 2, 2, 3])
    boxes = np.array([[0, 0, 10, 10]] * 3 + [[100, 100, 110, 110]] + [[0, 0, 10, 10]], float)
    t = follow(frames, boxes, np.array([0.9] * 5), Settings())
    assert t.tolist() == [0, 0, 0, 1, 0]
    frames = np.array([0, 1, 2, 3, 3])
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [100, 100, 110, 110], [100, 100, 110, 110], [0, 0, 10, 10]], float)
    assert follow(frames, boxes, np.array([0.9] * 5), Settings()).tolist() == [0, 0, 1, 1, 0]
