import json

import pytest

from tessera.sources import buckets as K
from tessera.sources.sinks import upsert_stream, write_split


def rows(spark, path, **how):
    return sorted(map(tuple, K.read_table(spark, path, **how).collect()))


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        K.read_table(spark, path)
    df = lambda x: spark.createDataFrame(x, "k int, v string")
    assert K.upsert_table(spark, path, df([(i, "a") for i in range(200)]), ["k"], 8) == 0
    first = K.manifest(spark, path)
    assert K.upsert_table(spark, path, df([(3, "b"), (500, "c")]), ["k"]) == 1
    second = K.manifest(spark, path)
    want = {i: "a" for i in range(200)} | {3: "b", 500: "c"}
    assert rows(spark, path) == sorted(want.items())
    changed = {b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)}
    assert second["of"] == 8 and 1 <= len(changed) <= 2 and len(second["buckets"]) == 8
    assert rows(spark, path, version=0) == [(i, "a") for i in range(200)]
    with pytest.raises(ValueError):
        K.upsert_table(spark, path, spark.createDataFrame([(3, "b")], "k bigint, v string"), ["k"])
    assert K.upsert_table(spark, path, df([]), ["k"]) == 2 and rows(spark, path) == sorted(want.items())


def test_readers_see_whole_versions_while_a_writer_works(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = lambda x: spark.createDataFrame(x, "k int, v string")
    K.upsert_table(spark, path, df([(1, "a"), (2, "a")]), ["k"], 2)
    seen = []
    real = K.Files.publish
    monkeypatch.setattr(K.Files, "publish", lambda self, *a: (seen.append(rows(spark, path)), real(self, *a))[1])
    K.upsert_table(spark, path, df([(2, "b")]), ["k"])
    assert seen == [[(1, "a"), (2, "a")]] and rows(spark, path) == [(1, "a"), (2, "b")]


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = lambda x: spark.createDataFrame(x, "k int, v string")
    K.upsert_table(spark, path, df([(1, "a")]), ["k"], 2)
    real, done = K.Files.publish, []

    def late(self, name, text):
        if not done:
            done.append(1)
            K.upsert_table(spark, path, df([(1, "other")]), ["k"])
        real(self, name, text)

    monkeypatch.setattr(K.Files, "publish", late)
    with pytest.raises(K.Lost):
        K.upsert_table(spark, path, df([(1, "mine")]), ["k"])
    assert rows(spark, path) == [(1, "other")] and not [n for n in K.Files(spark, path).names("") if n.startswith("_staged")]


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in "abcd":
        K.upsert_table(spark, path, spark.createDataFrame([(i, v) for i in range(20)], "k int, v string"), ["k"], 4)
    assert K.vacuum(spark, path, 1) == 12 and rows(spark, path) == [(i, "d") for i in range(20)]
    assert K.Files(spark, path).names("manifests") == ["000000000003.json"] and json.loads(K.Files(spark, path).read("manifests/000000000003.json"))["version"] == 3


def test_stream_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    put = upsert_stream(path, ["k"], 4)
    df = lambda x: spark.createDataFrame(x, "k int, v string")
    put(df([(1, "a"), (None, "n")]), 0)
    put(df([(1, "b"), (None, "m")]), 1)
    assert sorted(map(str, K.read_table(spark, path).collect())) == ["Row(k=1, v='b')", "Row(k=None, v='m')", "Row(k=None, v='n')"]


def test_splits_are_folders(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "if(id % 5 = 0, 'val', 'train') as split")
    write_split(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/split=val")).count() == 10
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == sorted(map(tuple, df.collect()))
