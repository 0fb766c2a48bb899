import json
import random

import pytest

from tessera.streaming import scoreboard as B
from tessera.streaming.timers import _PROVIDER, replay, timers

LOG = "match_id bigint, seq bigint, at bigint, path string, body string"


def commands(seed, n=120, matches=3):
    r = random.Random(seed)
    rows, at = [], 1000
    for seq in range(n):
        at += r.choice([0, 1, 20, 200])
        path = r.choice(["/clock/start", "/clock/start", "/clock/pause", "/penalty/add", "/penalty/add", "/penalty/remove", "/swap", "/score", "/nowhere"])
        body = json.dumps({"team": r.choice("AB"), "delta": 1, "duration": r.choice([120, 300]), "id": str(r.randint(1, 9))})
        rows.append((r.randrange(matches), seq, at, path, body))
    return rows


def ticks(rows, until):
    """Every match second by second, as a ticker sees it: penalties count down by the clock and go when they are over."""
    out = []
    for m in {r[0] for r in rows}:
        teams, running, rev, made = {"A": [], "B": []}, False, 0, 0
        own = [r for r in rows if r[0] == m]
        for second in range(own[0][2], until + 1):
            for _, seq, at, path, body in (r for r in own if r[2] == second):
                d, ok = json.loads(body), True
                if path == "/clock/start":
                    running = True
                elif path == "/clock/pause":
                    running = False
                elif path == "/penalty/add":
                    if ok := len(teams[d["team"]]) < 3:
                        made += 1
                        teams[d["team"]].append({"id": str(made), "left": d["duration"]})
                elif path == "/penalty/remove":
                    teams[d["team"]] = [p for p in teams[d["team"]] if p["id"] != d["id"]]
                elif path == "/swap":
                    teams = {"A": teams["B"], "B": teams["A"]}
                elif path == "/nowhere":
                    ok = False
                rev += ok
                out.append((m, float(second), seq, path, 200 if ok else 404, rev, None, None))
            # a penalty of whole seconds is over 0.05 seconds before its last one ends
            if running:
                gone = []
                for t in "AB":
                    for p in teams[t]:
                        p["left"] -= 1
                    gone += [(t, p["id"]) for p in teams[t] if p["left"] == 0]
                    teams[t] = [p for p in teams[t] if p["left"] > 0]
                rev += bool(gone)
                out += [(m, second + 0.95, None, "expired", None, rev, t, i) for t, i in gone]
    return out


def plain(rows):
    return sorted(((x[0], round(x[1], 2), *x[2:]) for x in map(tuple, rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_a_ticker(spark, seed):
    rows = commands(seed)
    got = B.happenings(spark.createDataFrame(rows, LOG), until=60_000.0).collect()
    expected = ticks(rows, 60_000)
    assert plain(got) == plain(expected) and sum(x[3] == "expired" for x in expected) > 5


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    """Three files, their commands out of order within the delay; the last penalty ends with no command of its match after it."""
    rows = commands(5) + [(0, 900, 20_000, "/clock/start", "{}"), (0, 901, 20_000, "/penalty/add", '{"team": "A", "duration": 120}'), (-1, 902, 90_000, "/visible", "{}")]
    whole = B.happenings(spark.createDataFrame(rows, LOG)).where("match_id >= 0")
    r = random.Random(1)
    source = tmp_path / "in"
    for part in (rows[:50], rows[50:90], rows[90:]):
        r.shuffle(part)
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
    before = spark.conf.get(_PROVIDER, None)
    got = replay(spark, str(source), whole.sparkSession.createDataFrame([], LOG).schema, str(tmp_path / "out"), str(tmp_path / "state"), "2 hours")
    assert spark.conf.get(_PROVIDER, None) == before
    got = got.where("match_id >= 0").collect()
    assert plain(got) == plain(whole.collect())
    assert any(x["path"] == "expired" and abs(x["at"] - 20_119.95) < 0.01 for x in got)


def test_timers_put_the_setting_back(spark):
    before = spark.conf.get(_PROVIDER, None)
    with pytest.raises(ValueError), timers(spark):
        assert "RocksDB" in spark.conf.get(_PROVIDER)
        raise ValueError
    assert spark.conf.get(_PROVIDER, None) == before
