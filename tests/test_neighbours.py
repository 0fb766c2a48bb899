import numpy as np
import pytest

from tessera.operators import neighbours as N


def knn(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return s, order


def plain_graph(v, k):
    """Memberships and their union, point by point."""
    s, order = knn(v, k)
    n = len(v)
    p = np.zeros((n, n))
    for i in range(n):
        d = [max(0.0, 1 - s[i, j]) for j in order[i]]
        rho = min((x for x in d if x > 0), default=0.0)
        low, high, width = 0.0, np.inf, 1.0
        for _ in range(64):
            total = sum(np.exp(-max(x - rho, 0) / width) for x in d)
            if total < np.log2(len(d)):
                low = width
            else:
                high = width
            width = (low + high) / 2 if np.isfinite(high) else width * 2
        width = max(width, 1e-3 * sum(d) / len(d))
        for j, x in zip(order[i], d):
            p[i, j] = np.exp(-max(x - rho, 0) / width)
    return p + p.T - p * p.T


def planted(seed=1, groups=2):
    r = np.random.default_rng(seed)
    rows, vs = [], {}
    for g in range(groups):
        v = np.concatenate([c + 0.4 * r.standard_normal((25, 8)) for c in 2 * r.standard_normal((4, 8))])
        vs[g] = v
        rows += [(g, 1000 * g + i, x.tolist()) for i, x in enumerate(v)]
    return rows, vs


@pytest.mark.parametrize("block", [2000, 30])
def test_graph_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows, vs = planted()
    df = spark.createDataFrame([*rows, (0, None, [1.0] * 8), (None, 5, [1.0] * 8), (1, 7, None)], "g int, i bigint, v array<double>")
    near = N.nearest(df, "g", "i", "v", 15)
    got = {(x["grp"], x["id"]): [y["other"] for y in x["near"]] for x in near.collect()}
    for g, v in vs.items():
        _, order = knn(v, 15)
        assert all(got[g, 1000 * g + i] == [1000 * g + j for j in order[i]] for i in range(len(v)))
    w = {(x["grp"], x["src"], x["dst"]): x["w"] for x in N.fuzzy(near).collect()}
    for g, v in vs.items():
        p = plain_graph(v, 15)
        assert sum(k[0] == g for k in w) == int((p > 0).sum())
        assert all(abs(w[g, 1000 * g + i, 1000 * g + j] - p[i, j]) < 1e-6 for i, j in zip(*np.nonzero(p)))


def test_coordinates_are_leading_eigenvectors(spark):
    rows, vs = planted(3)
    df = spark.createDataFrame(rows, "g int, i bigint, v array<double>")
    got = {}
    for x in N.spectral(N.fuzzy(N.nearest(df, "g", "i", "v", 15)), 3, 40).collect():
        got.setdefault(x["grp"], {})[x["id"] - 1000 * x["grp"]] = x["x"]
    for g, v in vs.items():
        p = plain_graph(v, 15)
        d = np.sqrt(p.sum(1))
        m = p / d[:, None] / d[None, :]
        top = np.sort(np.linalg.eigvalsh(m))[::-1][:4]
        x = np.array([got[g][i] for i in range(len(v))])
        assert np.allclose(x.T @ x, np.eye(3), atol=1e-6) and np.abs(x.T @ d).max() < 1e-5
        assert np.trace(x.T @ m @ x) > top[1:].sum() - 0.02


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 3, [1.0, 1.0])], "g int, i bigint, v array<double>")
    near = {x["id"]: len(x["near"]) for x in N.nearest(df, "g", "i", "v", 15).collect()}
    assert near == {1: 1, 2: 1, 3: 0}
    assert N.fuzzy(N.nearest(df.limit(0), "g", "i", "v", 15)).count() == 0
