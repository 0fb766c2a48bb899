from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import cut, join_skewed


def test_heavy_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = [(7, i) for i in range(300)] + [(i % 50 + 100, i) for i in range(400)] + [(999, 1), (None, 2)]
    left = spark.createDataFrame(rows, "k int, x int")
    n = Counter(k for k, _ in rows if k is not None and k != 999)
    right = cut(spark.createDataFrame([(k, f"v{k}", c) for k, c in n.items()], "k int, v string, n int"), "right")
    out = join_skewed(left, right, ["k"])
    assert sorted(map(tuple, out.collect())) == sorted((k, x, f"v{k}") for k, x in rows if k in n)
    assert join_skewed(left, right.where(F.lit(False)), ["k"]).count() == 0
