import math

import numpy as np
import pytest

import tessera.llm.vectors as V
from tessera.llm.registry import QUERIES
from tessera.llm.vectors import build, medoid, near_vectors, search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, bound):
    ok, out = [], []
    for i, (_, e, l) in enumerate(rows):
        good = e is not None and l is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
        ok.append(good and rows[i][0] is not None)
    unit = [np.asarray(e, float) / np.linalg.norm(np.asarray(e, float)) if ok[i] else None for i, (_, e, _) in enumerate(rows)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= bound:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[root(i)] = min(best.get(root(i), r[0]), r[0])
    for i, r in enumerate(rows):
        c = best[root(i)] if r[0] is not None else None
        out.append((r[0], links[i], c, c is not None and c == r[0]))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        base = r.standard_normal((60, 16))
        for b in base:
            for _ in range(int(r.integers(1, 6))):
                rows.append((n, [float(np.float32(x)) for x in b + r.standard_normal(16) * 0.09], label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(5)]
    n += 5
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] * 16, [1.0] * 8, [1.0] * 8]
    rows += [(n + i, e, 0) for i, e in enumerate(odd)]
    rows += [(n + 20, rows[0][1], None), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as grp", "1 as id", "2 as vec", "3 as copies")
    got = sorted((tuple(x) for x in near_vectors(df).collect()), key=str)
    assert got == brute(rows, 0.98)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def cloud(r, n, dims, centre=None, noise=0.05):
    v = r.standard_normal((n, dims)) if centre is None else centre + noise * r.standard_normal((n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_graph_search_recall():
    r = np.random.default_rng(0)
    v = np.concatenate([cloud(r, 500, 32), cloud(r, 400, 32, r.standard_normal((1, 32)))])
    f = v.astype(np.float32)
    adj = build(f)
    seen, todo = {medoid(f)}, [medoid(f)]
    while todo:
        new = set(adj.of(np.array([todo.pop()]))[1].tolist()) - seen
        seen |= new
        todo += new
    assert len(seen) == len(v)
    row, node = search(f, f, adj, medoid(f), 32, 0.98, 0.03)
    assert len(set(zip(row.tolist(), node.tolist()))) == len(row)
    assert (np.einsum("ij,ij->i", v[row], v[node]) > 0.9799).all()
    assert len(row) >= 0.99 * int((v @ v.T >= 0.98).sum())


def test_graph_is_searched_and_not_all_compared():
    """The walks see a part of the vectors only."""
    r = np.random.default_rng(1)
    f = cloud(r, 3000, 8).astype(np.float32)
    _, seen, _, _ = V.walk(f[:64], f, build(f), medoid(f), 16, 0.99)
    assert seen.sum(1).mean() < 0.5 * len(f)


def test_shards_overlaps_and_salts(spark, monkeypatch):
    """Many vectors of a label: centroids, shards with salts, lists united, a large group of near copies."""
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "AUDIT", 64)
    r = np.random.default_rng(5)
    vecs = [*cloud(r, 300, 16), *cloud(r, 500, 16, r.standard_normal((1, 16)), 0.04)]
    for b in cloud(r, 120, 16):
        vecs += [*cloud(r, int(r.integers(2, 5)), 16, b[None], 0.02)]
    order = r.permutation(len(vecs))
    rows = [(i, [float(np.float32(x)) for x in vecs[k]], 0) for i, k in enumerate(order)] + [(5000 + i, [float(np.float32(x)) for x in vecs[0]], 0) for i in range(3)]
    report = {}
    got = sorted(tuple(x) for x in near_vectors(spark.createDataFrame(rows, SCHEMA), report=report).collect())
    expected = sorted(brute(rows, 0.98))
    assert report["recall"][-1] >= 0.99
    assert all(g[1] <= e[1] for g, e in zip(got, expected))
    assert sum(g[1] for g in got) >= 0.99 * sum(e[1] for e in expected) > 100_000
    assert sum(g[2] == e[2] for g, e in zip(got, expected)) >= 0.99 * len(rows)


def test_a_cluster_of_any_size_is_dealt_to_slices(spark):
    """One cluster of 20,000 vectors in 40 salts: no slice holds more than one graph and about as many askers; each asks each graph once."""
    from pyspark.sql import functions as F

    placed = spark.range(-64, 20_000).select("id", F.lit("g").alias("grp"), F.lit(0).alias("cluster"), F.lit(40).alias("salts"), (F.col("id") < 0).alias("asks"))
    placed = placed.withColumn("salt", F.when(F.col("asks"), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).cast("int"))
    every = V.visits(placed).cache()
    sizes = every.groupBy("at", "slice").agg(F.count("*").alias("n"), F.count_if("member").alias("members")).collect()
    assert max(x["n"] for x in sizes) < 1300 and max(x["members"] for x in sizes) < 600 and len(sizes) == 820
    asked = every.where("asking").groupBy("id", "at").count()
    assert asked.where("count <> 1").isEmpty()
    told = {x["id"]: x["n"] for x in every.where("asking").groupBy("id", "salt").agg(F.count("*").alias("n"), F.max("salt").alias("s")).select("id", "n").collect()}
    assert told[-1] == 40 and sum(n for i, n in told.items() if i >= 0) == sum(40 - x["salt"] for x in placed.where("id >= 0").select("salt").collect())
    every.unpersist()


def test_more_salts_than_vectors(spark, monkeypatch):
    """Some salts of a cluster stay empty and are visited all the same."""
    monkeypatch.setattr(V, "SHARD", 1)
    r = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(x for b in cloud(r, 6, 8) for x in cloud(r, 3, 8, b[None], 0.02))]
    assert sorted(tuple(x) for x in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(brute(rows, 0.98))


def test_ids_that_name_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (0, [1.0, 0.01], 0), (1, [1.0, 0.0], 1), (-7, [1.0, 0.0], 1)]
    assert sorted((tuple(x) for x in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows, 0.98)


def test_query_recall(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {x["vec_id"]: x for x in QUERIES["op8_embedding_near_dedup"](spark, sf).collect()}
    expected = {x[0]: x for x in brute(rows, 0.98)}
    assert set(got) == set(expected)
    assert all(got[i]["n_links"] <= expected[i][1] for i in got)
    assert sum(x["n_links"] for x in got.values()) >= 0.99 * sum(x[1] for x in expected.values())  # these tables have no links; see the tests of shards


def test_a_search_that_finds_too_little_is_widened_and_then_fails(spark, monkeypatch):
    r = np.random.default_rng(4)
    vecs = [x for b in cloud(r, 20, 16) for x in cloud(r, 4, 16, b[None], 0.02)]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vecs)], SCHEMA)
    whole, tried = V.find_links, []

    def worse(vec, where, bound, overlap, beam, slack):
        tried.append((overlap, beam))
        return whole(vec, where, bound, overlap, beam, slack).where("id % 2 = 0" if len(tried) < 3 else "true")

    monkeypatch.setattr(V, "find_links", worse)
    assert sum(x["n_links"] for x in near_vectors(df).collect()) > 100 and tried == [(2, 32), (3, 64), (4, 128)]
    tried.clear()
    monkeypatch.setattr(V, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        near_vectors(df)
