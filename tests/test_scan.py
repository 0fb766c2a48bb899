import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.scan import floored_scan, ranges
from tessera.operators.selection import mixed, place_by_hash


def steps(seed, n, keys):
    r = random.Random(seed)
    return [(r.choice(keys), i, r.choice([-3, -1, -1, 1, 1, 2, None]), r.choice([None] * 12 + [-4, 0, 5])) for i in range(n)]


def plain(rows, absolute):
    state, out = {}, {}
    for k, i, d, a in sorted(rows, key=lambda r: r[1]):
        state[k] = max(0, a) if absolute and a is not None else max(0, state.get(k, 0) + (d or 0))
        out[i] = state[k]
    return out


@pytest.mark.parametrize("keys", [["m"], ["a", "b", None]])
@pytest.mark.parametrize("absolute", [None, "absolute"])
def test_scan_equals_a_plain_fold(spark, keys, absolute):
    rows = steps(len(keys), 3000, keys)
    df = spark.createDataFrame(rows, "match string, at int, delta int, absolute int").repartition(5)
    got = floored_scan(df, ["match"], ["at"], absolute=absolute, parts=16)
    assert {r["at"]: r["score"] for r in got.collect()} == plain(rows, absolute)
    assert got.columns == ["match", "at", "delta", "absolute", "score"]


def test_a_match_that_holds_all_rows_is_scanned_in_ranges(spark):
    df = spark.range(20_000).select(F.lit(1).alias("match"), F.col("id").alias("at"), F.lit(1).alias("delta"))
    sizes = [r["count"] for r in ranges(df, ["match"], ["at"], 16).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2500
    assert floored_scan(df, ["match"], ["at"], parts=16).where("score <> at + 1").count() == 0


def test_scan_of_nothing(spark):
    assert floored_scan(spark.createDataFrame([], "match int, at int, delta int"), ["match"], ["at"]).count() == 0


def ranks(rows, seed):
    import hashlib

    out, groups = {}, {}
    for g, k in rows:
        groups.setdefault(g, []).append(k)
    for g, ks in groups.items():
        for i, k in enumerate(sorted(ks, key=lambda k: (hashlib.md5(f"{k}{seed}".encode()).hexdigest(), k))):
            out[g, k] = (i, len(ks))
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_cuts_are_exact(spark, monkeypatch, digits):
    """With one digit the border buckets hold many rows, and their second histogram and ranks decide."""
    from tessera.operators import selection

    monkeypatch.setattr(selection, "DIGITS", digits)
    r = random.Random(digits)
    rows = [(r.choice(["a"] * 20 + ["b", None, "c"]), k) for k in range(4000)] + [("one", 9001), ("two", 9002), ("two", 9003)]
    cuts = [F.floor(F.col("n") * 0.1), F.floor(F.col("n") * 0.1) + 1, F.col("n") - 1, F.lit(0)]
    got = place_by_hash(spark.createDataFrame(rows, "g string, k int"), ["g"], "k", cuts, "7")
    rank = ranks(rows, "7")
    found = {(x["g"], x["k"]): x["place"] for x in got.collect()}
    assert len(found) == len(rows) == got.count()
    for at, (i, n) in rank.items():
        assert found[at] == sum(i >= c for c in (n // 10, n // 10 + 1, n - 1, 0)), at


def test_repeated_and_null_keys(spark):
    rows = [("g", 5)] * 7 + [("g", None)] * 3 + [("h", 1)]
    got = place_by_hash(spark.createDataFrame(rows, "g string, k int"), ["g"], "k", [F.lit(4)]).collect()
    assert sorted((x["g"], x["k"] or 0, x["place"]) for x in got) == [("g", 0, 0)] * 3 + [("g", 5, 0)] + [("g", 5, 1)] * 6 + [("h", 1, 0)]
    assert place_by_hash(spark.createDataFrame([], "g string, k int"), ["g"], "k", [F.lit(4)]).count() == 0
    assert mixed("k") is not None


def test_a_hot_group_is_not_ranked_whole(spark):
    """Of one group's rows only those of the border bucket are ordered by a window."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    got = place_by_hash(df, ["g"], "k", [F.floor(F.col("n") * 0.1)])
    assert got.where("place = 0").count() == 20_000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("row_number()") >= 1
