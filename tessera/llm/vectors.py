"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards. Each shard
builds a graph by insertion: a batch of vectors is searched for greedily
in the graph of those before, and what the walks met is pruned so that a
greedy walk can come near any vector (the robust pruning of Vamana
graphs, without a hierarchy). The lists of a vector's shards are united.
Every vector is searched for from the medoid of each of its shards, and
the search expands while it finds vectors in range. Links are verified in
double precision; each is counted in one shard only, so that a group of
near copies costs rows in proportion to its vectors and not to its pairs.
Planted and sampled queries, compared with all vectors, audit the recall,
and the search is widened until it suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop

#: Vectors that one graph is meant for, and centroids altogether, which bounds what goes to the executors.
SHARD, CENTROIDS = 5000, 32_768
#: Vectors that centroids are learnt from, and vectors of an audit, of each of its two kinds.
SAMPLE, AUDIT = 40_000, 256
#: True links of sampled vectors that an audit needs to judge by them, besides the planted ones.
ENOUGH = 100
#: Audits, each of a wider search than the one before; the last beam is wider than any shard.
ROUNDS = 10
#: Vectors that are searched for at once.
BLOCK = 256
#: Pairs of vectors that are multiplied at once.
PAIRS = 100_000
#: Tasks that a group's vectors are dealt over where its name is looked up.
SALTS = 32
#: What single precision may be wrong by; what is within it is compared in double precision.
NEAR = 1e-5


def matrix(rows) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def dots(v: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of each row of ``q`` with the vectors that its row of ``at`` names."""
    return np.matmul(v[np.minimum(at, len(v) - 1)], q[:, :, None])[:, :, 0]


def once(at: np.ndarray, none: int) -> np.ndarray:
    """Each row sorted, repeats replaced by ``none``, the highest value, and cut to the longest row."""
    at = np.sort(at, 1)
    at[:, 1:][at[:, 1:] == at[:, :-1]] = none
    at.sort(1)
    return at[:, : max(1, int((at < none).sum(1).max(initial=0)))]


def robust_prune(cand: np.ndarray, near: np.ndarray, v: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (``len(v)``: none), nearest first, those that no kept one is much nearer to.

    ``near`` holds their distances to the row's vector.
    """
    n, r = len(v), np.arange(len(cand))
    alive = cand < n
    vec = v[np.minimum(cand, n - 1)]
    out = np.full((len(cand), degree), n)
    for k in range(degree):
        at = np.where(alive, near, np.inf).argmin(1)
        some = alive[r, at]
        if not some.any():
            break
        out[some, k] = cand[r, at][some]
        between = np.matmul(vec, vec[r, at][:, :, None])[:, :, 0]
        alive &= alpha * np.sqrt(np.maximum(2 - 2 * between, 0)) > near
        alive[r, at] = False
    return out


class Lists:
    """Adjacency lists of any length, one after the other."""

    def __init__(self, lists: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.to = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in ``nodes`` and a neighbour of the node there."""
        size = self.start[nodes + 1] - self.start[nodes]
        place = np.repeat(np.arange(len(nodes)), size)
        return place, self.to[np.repeat(self.start[nodes] - np.cumsum(size) + size, size) + np.arange(len(place))]


class Rows:
    """Adjacency lists of bounded length while a graph is built; ``none`` fills them up."""

    def __init__(self, adj: np.ndarray):
        self.adj, self.none = adj, len(adj) - 1

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.adj[nodes]
        place, k = np.nonzero(near < self.none)
        return place, near[place, k]


def products(v: np.ndarray, at: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Products of pairs, some at a time."""
    parts = [np.einsum("ij,ij->i", v[at[i : i + PAIRS]], q[row[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]
    return np.concatenate(parts or [np.zeros(0, v.dtype)])


def step(lists, row: np.ndarray, node: np.ndarray, seen: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``row, neighbour`` that a row has not seen yet, rows in order; they are seen from here on.

    ``mark`` is room for a number for each row and node; of equal pairs
    the one whose number stays is kept.
    """
    n, out = seen.shape[1], [(row[:0], node[:0])]
    for i in range(0, len(row), PAIRS // 8):
        place, near = lists.of(node[i : i + PAIRS // 8])
        r = row[i + place]
        new = ~seen[r, near]
        r, near = r[new], near[new]
        key, own = r * n + near, np.arange(len(r), dtype=np.int32)
        mark[key] = own
        once_ = mark[key] == own
        r, near = r[once_], near[once_]
        seen[r, near] = True
        out.append((r, near))
    return np.concatenate([r for r, _ in out]), np.concatenate([m for _, m in out])


def walk(q: np.ndarray, v: np.ndarray, lists, start: int, beam: int, floor: float, expand: int = 4):
    """Greedy walks for all rows of ``q`` at once, each with a beam.

    Returns the beams (``len(v)``: none), what was seen, what was expanded,
    and the pairs ``row, node, product`` met with a product of ``floor`` or
    more.
    """
    n = len(v)
    seen = np.zeros((len(q), n), bool)
    seen[:, start] = True
    mark = np.empty(len(q) * n, np.int32)
    ids, sims = np.full((len(q), beam), n), np.full((len(q), beam), -2, np.float32)
    done = np.ones((len(q), beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, q @ v[start], False
    near = np.flatnonzero(sims[:, 0] >= floor)
    path, pool = [], [(near, np.full(len(near), start), sims[near, 0])]
    on = np.arange(len(q))
    while True:
        open_ = np.where(done[on], -3, sims[on])
        pick = np.argpartition(-open_, expand - 1, axis=1)[:, :expand]
        some = np.take_along_axis(open_, pick, 1) > -3
        go = some.any(1)
        on, pick, some = on[go], pick[go], some[go]
        if not len(on):
            return ids, seen, path, pool
        done[on[:, None], pick] = True
        node = np.where(some, ids[on[:, None], pick], n)
        path.append(np.full((len(q), expand), n))
        path[-1][on] = node
        row, new = step(lists, np.repeat(on, expand)[some.ravel()], node.ravel()[some.ravel()], seen, mark)
        if not len(row):
            continue
        s = products(v, new, q, row)
        hit = s >= floor
        pool.append((row[hit], new[hit], s[hit]))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        who, count = row[first], np.diff(np.append(first, len(row)))
        place = np.repeat(np.arange(len(who)), count), np.arange(len(row)) - np.repeat(first, count)
        more, worth = np.full((len(who), int(count.max())), n), np.full((len(who), int(count.max())), -2, np.float32)
        more[place], worth[place] = new, s
        both, s2 = np.concatenate([ids[who], more], 1), np.concatenate([sims[who], worth], 1)
        d2 = np.concatenate([done[who], more == n], 1)
        top = np.argpartition(-s2, beam - 1, axis=1)[:, :beam]
        ids[who], sims[who], done[who] = (np.take_along_axis(x, top, 1) for x in (both, s2, d2))


def search(q: np.ndarray, v: np.ndarray, lists, start: int, beam: int, bound: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``row, node`` in range: greedy walks, then an expansion from all that came in or near the range."""
    _, seen, _, pool = walk(q, v, lists, start, beam, bound - slack)
    row, node, sim = (np.concatenate(x) for x in zip(*pool))
    found, mark = [], np.empty(seen.size, np.int32)
    while len(row):
        hit, go = sim >= bound - NEAR, sim >= bound - slack
        found.append((row[hit], node[hit]))
        order = np.argsort(row[go], kind="stable")
        row, node = step(lists, row[go][order], node[go][order], seen, mark)
        sim = products(v, node, q, row)
    return np.concatenate([np.zeros(0, np.int64), *(r for r, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(m for _, m in found)])


def medoid(v: np.ndarray) -> int:
    """The vector nearest the mean."""
    return int((v @ v.mean(0)).argmax())


def relink(adj: np.ndarray, v: np.ndarray, who: np.ndarray, cand: np.ndarray, alpha: float, most: int = 96) -> None:
    """Give each of ``who`` the pruned list of its candidates, of which the nearest ``most`` count."""
    n, degree = len(v), adj.shape[1]
    for at in range(0, len(who), BLOCK):
        w, c = who[at : at + BLOCK], cand[at : at + BLOCK]
        sim = dots(v, c, v[w])
        sim[c == n] = -2
        if c.shape[1] > most:
            top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            c, sim = np.take_along_axis(c, top, 1), np.take_along_axis(sim, top, 1)
        adj[w] = robust_prune(c, np.sqrt(np.maximum(2 - 2 * sim, 0)), v, degree, alpha)


def dealt(key: np.ndarray, value: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the values of each in a row."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    names, first, n = np.unique(key, return_index=True, return_counts=True)
    out = np.full((len(names), int(n.max())), none)
    out[np.repeat(np.arange(len(names)), n), np.arange(len(key)) - np.repeat(first, n)] = value
    return names, out


def build(v: np.ndarray, degree: int = 24, width: int = 32, alpha: float = 1.2, passes: int = 2, batch: int = 128) -> Lists:
    """Adjacency lists of a shard; every vector can be reached from the medoid.

    Vectors are inserted in a fixed random order, in batches that double up
    to ``batch``; a second pass inserts each again into the whole graph.
    In the end links go both ways: the members of a dense group keep little
    but its middle, so that its middle has to know them all.
    """
    n = len(v)
    adj = np.full((n + 1, degree), n)
    start = medoid(v)
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    for _ in range(passes):
        at, size = 0, 1
        while at < len(order):
            own = order[at : at + size]
            at, size = at + size, min(batch, size * 2)
            ids, _, path, _ = walk(v[own], v, Rows(adj), start, width, 3)
            cand = np.concatenate([ids, *path, adj[own]], 1)
            cand[cand == own[:, None]] = n
            relink(adj, v, own, once(cand, n), alpha)
            i, k = np.nonzero(adj[own] < n)
            to, came = dealt(adj[own][i, k], own[i], n)
            both = once(np.concatenate([adj[to], came], 1), n)
            fits = (both < n).sum(1) <= degree
            adj[to[fits], : min(degree, both.shape[1])] = both[fits, :degree]
            relink(adj, v, to[~fits], both[~fits], alpha)
    a, k = np.nonzero(adj[:n] < n)
    b = adj[a, k]
    return connect(np.concatenate([a, b]), np.concatenate([b, a]), v, start)


def connect(a: np.ndarray, b: np.ndarray, v: np.ndarray, start: int) -> Lists:
    """The links as lists, and what the medoid does not reach tied to the nearest vector that it reaches."""
    n = len(v)
    while True:
        key = np.unique(a * n + b)
        a, b = key // n, key % n
        lists = Lists(np.split(b, np.searchsorted(a, np.arange(1, n))))
        seen = np.zeros(n, bool)
        seen[start] = True
        todo = np.array([start])
        while len(todo):
            todo = np.unique(lists.of(todo)[1])
            todo = todo[~seen[todo]]
            seen[todo] = True
        out, reached = np.flatnonzero(~seen)[:BLOCK], np.flatnonzero(seen)
        if not len(out):
            return lists
        to = reached[(v[out] @ v[reached].T).argmax(1)]
        a, b = np.concatenate([a, to, out]), np.concatenate([b, out, to])


def centroids(sample: pd.DataFrame, want: dict[str, int]) -> dict[str, np.ndarray]:
    """A few rounds of k-means for each group, on the bounded sample."""
    out = {}
    for g, rows in sample.groupby("grp"):
        v = matrix(rows.sort_values("id")["vec"])
        k = min(want[g], len(v))
        c = v[np.random.default_rng(0).permutation(len(v))[:k]]
        for _ in range(5):
            best = np.concatenate([(v[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(v), 4096)])
            for i in range(k):
                if (m := v[best == i]).size:
                    mean = m.mean(0)
                    c[i] = mean / max(np.linalg.norm(mean), 1e-12)
        out[g] = c
    return out


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` nodes reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def visits(placed: DataFrame) -> DataFrame:
    """The rows at every graph of their cluster that they ask, which are those of their own salt and of higher ones, and there in slices.

    A graph's own vectors ask in slice 0 and are there to be found in all
    slices; the others, those of lower salts and questions, are dealt to
    the rest, as many as there are lower salts, so that a slice holds one
    graph and about as many more rows, however large its cluster is.
    """
    at = F.col("at")
    one = F.array(F.when(at > 0, 1 + F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(at, F.lit(1)))).otherwise(0).cast("int"))
    every = placed.withColumn("at", F.explode(F.sequence(F.greatest("salt", F.lit(0)), F.col("salts") - 1)))
    every = every.withColumn("member", at == F.col("salt")).withColumn("slice", F.when(F.col("member"), F.sequence(F.lit(0), at)).otherwise(one))
    return every.withColumn("slice", F.explode("slice")).withColumn("asking", ~F.col("member") | (F.col("slice") == 0))


def find_links(vec: DataFrame, where: dict[str, np.ndarray], bound: float, overlap: int, beam: int, slack: float) -> DataFrame:
    """``id, n, root, hits`` of vectors ``vec(id, grp, vec, copies, asks)``, as one search finds them; rows of one id add up.

    ``n`` counts the other vectors linked, ``root`` is one of them or the
    vector itself and names a group within a shard. Rows that only ask are
    in no graph; what is found for them is listed in ``hits``.
    """
    spark = vec.sparkSession
    shared = spark.sparkContext.broadcast(where)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, vecs = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_pylist()
            own: list = [[0]] * len(vecs)
            for g in set(groups.tolist()):
                if (c := shared.value.get(g)) is not None:
                    rows = np.flatnonzero(groups == g)
                    sim = matrix([vecs[i] for i in rows]) @ c.T
                    top = min(overlap, len(c))
                    near = np.sort(np.argpartition(-sim, top - 1, axis=1)[:, :top], 1)
                    for i, x in zip(rows.tolist(), near.tolist()):
                        own[i] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.int32()))], names=["id", "grp", "vec", "copies", "asks", "own"])

    columns = "id bigint, grp string, vec array<double>, copies bigint, asks boolean"
    placed = vec.select("id", "grp", "vec", "copies", "asks").mapInArrow(assign, f"{columns}, own array<int>")
    placed = once_placed = cut(placed.select("*", F.explode("own").alias("cluster")), "placed")
    sizes = placed.where("not asks").groupBy("grp", "cluster").agg(F.ceil(F.count("*") / F.lit(2.0 * SHARD)).cast("int").alias("salts"))
    placed = placed.join(sizes, ["grp", "cluster"]).withColumn("salt", F.when(F.col("asks"), -1).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int"))
    placed = cut(placed, "shards")

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        near = build(matrix(pdf["vec"]).astype(np.float32))
        return pd.DataFrame({"id": ids, "next": [ids[x].tolist() for x in np.split(near.to, near.start[1:-1])]})

    graph = placed.where("not asks").select("grp", "cluster", "salt", "id", "vec").groupBy("grp", "cluster", "salt")
    graph = cut(graph.applyInPandas(lists, "id bigint, next array<bigint>"), "lists")
    drop(once_placed)
    union = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    every = visits(placed).join(union, "id", "left")

    kinds = {"id": "int64", "n": "int64", "root": "int64", "hits": object}

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asks", "id"], ignore_index=True)
        ids, copies, member, asks = (pdf[c].to_numpy() for c in ("id", "copies", "member", "asks"))
        own = np.full((len(pdf), int(pdf["own"].map(len).max())), -1)
        for i, x in enumerate(pdf["own"]):
            own[i, : len(x)] = x
        inside = np.flatnonzero(member)
        if not len(inside):
            return pd.DataFrame({"id": [], "n": [], "root": [], "hits": []}).astype(kinds)
        place = {int(x): i for i, x in enumerate(ids[inside])}
        lists = Lists([np.array([place[y] for y in pdf["next"][i] if y in place], dtype=np.int64) for i in inside])
        full = matrix(pdf["vec"])
        q, who = full.astype(np.float32), np.flatnonzero(pdf["asking"].to_numpy())
        v, exact = q[inside], full[inside]
        start, got = medoid(v), [(who[:0], who[:0])]
        for i in range(0, len(who), BLOCK):
            row, node = search(q[who[i : i + BLOCK]], v, lists, start, beam, bound, slack)
            row = who[i + row]
            ok = products(exact, node, full, row) >= bound
            got.append((row[ok], inside[node[ok]]))
        a, b = (np.concatenate(x) for x in zip(*got))
        hits: dict[int, list[int]] = {}
        for x, y in zip(ids[a[asks[a]]].tolist(), ids[b[asks[a]]].tolist()):
            hits.setdefault(x, []).append(y)
        keep = ~asks[a] & (a != b)
        pair = np.unique(np.minimum(a[keep], b[keep]) * len(pdf) + np.maximum(a[keep], b[keep]))
        a, b = pair // len(pdf), pair % len(pdf)
        # a pair that meets in several clusters counts in the first of them
        first = np.concatenate(
            [np.where((x[:, :, None] == y[:, None, :]).any(2) & (x >= 0), x, 1 << 30).min(1) for x, y in ((own[a[k : k + PAIRS]], own[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS))]
            or [np.zeros(0, int)]
        )
        root = least_reached(len(pdf), a, b)
        mine = first == key[1]
        n = np.zeros(len(pdf), np.int64)
        np.add.at(n, a[mine], copies[b[mine]])
        np.add.at(n, b[mine], copies[a[mine]])
        some = np.flatnonzero((n > 0) | (root != np.arange(len(pdf))))
        out = pd.DataFrame({"id": ids[some], "n": n[some], "root": ids[root[some]], "hits": [[] for _ in some]})
        more = pd.DataFrame({"id": list(hits), "n": 0, "root": list(hits), "hits": list(hits.values())})
        return pd.concat([out, more]).astype(kinds)

    found = every.groupBy("grp", "cluster", "at", "slice").applyInPandas(ask, "id bigint, n bigint, root bigint, hits array<bigint>")
    found.scratch = (placed, graph)
    return found


def planted(v: np.ndarray, seed: int, bound: float) -> np.ndarray:
    """A unit vector whose cosine with ``v`` is in range, near its bound or far from it."""
    r = np.random.default_rng(seed & 0x7FFFFFFF)
    u = r.standard_normal(len(v))
    u -= (u @ v) * v
    if len(v) == 1 or not np.linalg.norm(u):
        return v
    c = bound + (1 - bound) * (0.05 + 0.9 * r.random())
    return c * v + np.sqrt(1 - c * c) * u / np.linalg.norm(u)


def questions(vec: DataFrame, bound: float) -> tuple[DataFrame | None, pd.DataFrame]:
    """Rows that ask, and their ids with the vectors that they do not ask for: sampled vectors, and vectors planted in their range."""
    some = vec.orderBy(F.xxhash64("name", F.lit(11)), "name", "grp").limit(AUDIT).toPandas()
    if not len(some):
        return None, some
    v = matrix(some["vec"]) if some["vec"].map(len).nunique() == 1 else [matrix([x])[0] for x in some["vec"]]
    rows, n = [], len(some)
    for i, (own, seed, g, x) in enumerate(zip(some["id"].tolist(), some["name"].tolist(), some["grp"].tolist(), v)):
        rows.append((-1 - i, g, x.tolist(), own))
        rows.append((-1 - n - i, g, planted(x, seed, bound).tolist(), None))
    spark = vec.sparkSession
    asked = pd.DataFrame(rows, columns=["id", "grp", "vec", "but"])
    frame = spark.createDataFrame([(a, g, x, 0, True) for a, g, x, _ in rows], "id bigint, grp string, vec array<double>, copies bigint, asks boolean")
    return frame, asked


def true_answers(vec: DataFrame, asked: pd.DataFrame, bound: float) -> DataFrame:
    """``id, node``: every question compared with every vector of its group, block by block."""
    shared = vec.sparkSession.sparkContext.broadcast({g: (r["id"].to_numpy(), matrix(r["vec"])) for g, r in asked.groupby("grp")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf, a, c = b.to_pandas(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g, r in pdf.groupby("grp"):
                if g in shared.value:
                    ids, v = shared.value[g]
                    i, j = np.nonzero(v @ matrix(r["vec"]).T >= bound)
                    a.append(ids[i])
                    c.append(r["id"].to_numpy()[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["id", "node"])

    return vec.select("id", "grp", "vec").mapInArrow(compare, "id bigint, node bigint")


def recall(found: DataFrame, truth: DataFrame, asked: pd.DataFrame) -> float:
    """The lower share of true answers found, of planted questions and, if they have ``ENOUGH``, of sampled vectors."""
    got = found.select("id", F.explode("hits").alias("node")).distinct().withColumn("found", F.lit(1))
    counts = truth.join(got, ["id", "node"], "left").groupBy("id").agg(F.count("*").alias("n"), F.count("found").alias("found")).toPandas()
    counts = counts.merge(asked[["id", "but"]], on="id")
    real = counts["but"].notna()  # a sampled vector answers itself, which is no evidence
    n, m = counts["n"] - real, counts["found"] - real
    shares = [m[k].sum() / n[k].sum() for k in (real, ~real) if n[k].sum() >= (ENOUGH if k is real else 1)]
    return float(min(shares, default=1.0))


def near_vectors(
    df: DataFrame,
    bound: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    recall_least: float = 0.99,
    overlap: int = 2,
    beam: int = 32,
    slack: float = 0.03,
    report: dict | None = None,
) -> DataFrame:
    """Link vectors of equal label whose cosine is ``bound`` or more, and group what links reach.

    Returns ``vec_id, n_links, component_id, kept``, one row for each row.
    Equal vectors of a label are searched for once and count each. Vectors
    that are null, zero, or hold null or non-finite components, and rows
    with a null label or id, link with nothing; vectors of different
    lengths are not compared. A row with a null id has a null component
    and is not kept. Rows that share an id are returned each,
    with the links of their own vectors. An empty
    table gives no rows; further columns are not read, whatever their
    names. Ties do not arise: all links in range count.

    Every vector is indexed and searched for; centroids are learnt from
    ``SAMPLE`` vectors. The recall of each search is audited by ``AUDIT``
    vectors and as many planted ones, against all vectors; below ``recall_least``
    beam, range and overlap are widened and all is searched again. If
    ``ROUNDS`` searches do not suffice, the job fails. ``report``, if
    given, gets the audited recalls. There are ``CENTROIDS`` shards with
    further ones by salt: beyond 160 million vectors, work per vector
    grows with the table, by a search for each further 320 million.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    own = df.select(df[id_col].cast("bigint").alias("id"), df[vec_col].cast("array<double>").alias("vec"), label.alias("label"))
    good = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = good & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull() & F.col("label").isNotNull()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    good = good & (norm > 0) & (norm < F.lit(float("inf")))
    fit = own.where(F.coalesce(good, F.lit(False))).withColumn("grp", F.concat_ws("|", F.size("vec").cast("string"), "label"))
    vec = fit.groupBy("grp", "vec").agg(F.min("id").alias("name"), F.count("*").alias("copies"))
    vec = cut(vec.withColumn("id", F.monotonically_increasing_id()), "vectors")  # ids of the table may name several vectors
    total = vec.count()
    size = max(SHARD, -(-total // CENTROIDS))
    large = vec.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size)  # up to this one graph holds all
    want = {r["grp"]: -(-r["n"] // size) for r in large.collect()}
    where: dict[str, np.ndarray] = {}
    if want:
        share = min(1.0, SAMPLE / total)
        some = vec.where(F.pmod(F.xxhash64("name", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).join(large.select("grp"), "grp", "left_semi")
        where = centroids(some.select(F.col("name").alias("id"), "grp", "vec").toPandas(), want)
    vec = vec.withColumn("asks", F.lit(False))
    asks, asked = questions(vec, bound)
    both = vec if asks is None else cut(vec.select("id", "grp", "vec", "copies", "asks").union(asks), "vectors-asked")
    truth = cut(true_answers(vec, asked, bound), "answers") if len(asked) else None
    for _ in range(ROUNDS):
        found = find_links(both, where, bound, overlap, beam, slack)
        links = cut(found, "links")
        drop(*getattr(found, "scratch", ()))
        share = recall(links, truth, asked) if truth is not None else 1.0
        if report is not None:
            report.setdefault("recall", []).append(share)
        if share >= recall_least:
            break
        drop(links)
        overlap, beam, slack = overlap + 1, beam * 2, slack * 1.5
    else:
        raise RuntimeError(f"near_vectors: audited recall {share:.3f}")
    links = links.where("id >= 0")
    count = links.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(links.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    state = vec.join(count, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    state = cut(state.select("grp", "vec", "name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "vector-state")
    least = state.where("component is not null").groupBy("component").agg(F.min("name").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large group is dealt over tasks
    state = state.withColumn("salt", F.pmod(F.xxhash64("name", "grp"), F.lit(SALTS)).cast("int"))
    state = state.join(least, ["component", "salt"], "left").select("grp", "vec", "n_links", F.coalesce("least", "name").alias("component"))
    named = own.withColumn("grp", F.when(F.coalesce(good, F.lit(False)), F.concat_ws("|", F.size("vec").cast("string"), "label")))
    out = named.join(state, ["grp", "vec"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
