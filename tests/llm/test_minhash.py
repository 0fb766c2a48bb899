import random
import re

from tessera.llm.minhash import near_duplicates, shingles, superminhash
from tessera.llm.registry import QUERIES

import numpy as np


def sets(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return sorted((d, len(s[i]), best[root(i)], best[root(i)] == d) for i, (d, _) in enumerate(rows))


def fixture():
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(60)) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(r.randint(1, 12)):
            w = b.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randrange(30)}"
            rows.append(" ".join(w))
    rows += ["", "   ", None, "one", "ONE", "one two", "One\ttwo", "one two three"] + [base[0].upper()] * 5
    r.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(docs):
    rows = fixture()
    got = near_duplicates(docs(rows), k=3, percent=85, bands=20, rows=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 85)


def test_nulls_repeats_and_empty_table(docs):
    text = "a b c d e f g h i j"
    got = near_duplicates(docs([(None, text), (4, text), (4, text), (9, text), (7, None)])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [
        (False, 4, 4, True), (False, 4, 4, True), (False, 7, 7, True), (False, 9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]
    assert near_duplicates(docs([])).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    m, err = 80, []
    for _ in range(60):
        x = r.integers(0, 2**63, 200, dtype=np.uint64)
        cut = int(r.integers(20, 180))
        a, b = x[:cut], x[cut // 2 :]
        s = superminhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, m)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        err.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.08
    small = superminhash(np.array([5, 5], np.uint64), np.array([0, 1]), 2, m)
    assert (small[0] == small[1]).all() and len({int(v) >> 40 for v in small[0]}) == m


def test_long_text():
    assert len(shingles("w " * 300_000 + "x", 3)) == 2


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op7_minhash_near_dedup"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 85)
