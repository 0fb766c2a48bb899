import hashlib
import random

import numpy as np
import pytest

from tessera.llm import periodic
from tessera.llm.periodic import Suffixes, by_stack, factors, find_runs, periodic_runs, planted, previous_factors
from tessera.llm.registry import QUERIES


def brute(w, words=24, times=3):
    """Every period in turn: stretches in which words ``q`` apart agree; of equal stretches the smallest period counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(words, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(key, text, rewrite=True):
    w = (text or "").encode().split()
    w = planted(key, w) if rewrite else w
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    first = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
    return (key, *first, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_text(r, n, kinds):
    """Words with nested repetitions."""
    w = []
    while len(w) < n:
        if r.random() < 0.5 and w:
            a = r.randrange(len(w))
            w += w[a : a + r.randint(1, 40)] * r.randint(1, 6)
        else:
            w += [f"{r.randrange(kinds)}".encode() for _ in range(r.randint(1, 9))]
    return w[:n]


@pytest.mark.parametrize("words,times", [(24, 3), (6, 3), (5, 2)])
def test_runs_match_brute_force(words, times):
    r = random.Random(words)
    docs = [periodic_text(r, r.randint(0, 260), r.choice([1, 2, 3, 9, 200])) for _ in range(150)] + [[], [b"x"] * 300, [b"a", b"b"] * 100, [b"a"] * 23, [b"a"] * 24]
    got = find_runs(docs, words, times)
    assert got == [brute(d, words, times) for d in docs] and sum(map(len, got)) > 100


def test_runs_inside_factors_are_copied():
    r = random.Random(3)
    inner = [b"a", b"b", b"c"] * 9
    block = [b"l", *inner, b"m"]
    w = block + [b"x"] + block + [b"y"] + [b"z", *block, b"w"] + [b"q"] + [b"z", *block, b"w"]
    assert find_runs([w])[0] == brute(w) and len(brute(w)) == 4
    nest = [f"{r.randrange(5)}".encode() for _ in range(7)] + [b"k"] * 30 + [b"e"]
    w = nest * 5 + [b"!"] + nest * 4
    assert find_runs([w])[0] == brute(w)


def test_factors_are_the_longest_previous_ones():
    r = np.random.default_rng(1)
    for kinds in (1, 2, 5):
        x = r.integers(0, kinds, 90)
        size, source = previous_factors(Suffixes(x))
        for i in range(90):
            most = max((next((k for k in range(90 - i) if x[i + k] != x[j + k]), 90 - i) for j in range(i)), default=0)
            assert size[i] == most and (most == 0 or (source[i] < i and (x[i : i + most] == x[source[i] : source[i] + most]).all()))
        starts = factors(size)
        assert starts[0] == 0 and (np.diff(starts) == np.maximum(size[starts[:-1]], 1)).all()


def test_a_stack_takes_over_from_jumps(monkeypatch):
    r = np.random.default_rng(2)
    x = r.integers(0, 3, 400)
    expected = previous_factors(Suffixes(x))[0].tolist()
    monkeypatch.setattr(periodic, "JUMPS", 0)
    assert previous_factors(Suffixes(x))[0].tolist() == expected
    to, least = by_stack([2, 0, 1], [0, 5, 4, 0], -1)
    assert to.tolist() == [-1, -1, 1] and least.tolist() == [0, 0, 4]


def test_suffixes_of_many_words(monkeypatch):
    x = np.tile(np.arange(3), 800_000)
    s = Suffixes(x)
    assert s.common(np.array([0, 1]), np.array([3, 2])).tolist() == [2_399_997, 0] and len(s.order) == 2_400_000


def test_rows(docs, monkeypatch):
    r = random.Random(8)
    text = lambda: " ".join(w.decode() for w in periodic_text(r, r.randint(0, 200), 30))
    rows = [(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, " \n "), (None, "no id " * 12), (63, "tie a tie b " * 20), (63, "tie a tie b " * 20), (64, "é " * 40)]
    got = [tuple(x) for x in periodic_runs(docs(rows)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "text").collect()]
    by = {}
    for k, t in rows:
        d = digest(k, t, rewrite=False)
        by.setdefault((k, d[-1]), []).append(d[:6])
    for x in got:
        assert x[:6] == by[x[0], hashlib.sha256(x[6].encode()).hexdigest()].pop()
    assert not any(by.values())
    assert periodic_runs(docs([])).count() == 0


def test_long_text(docs):
    n = 400_000
    got = periodic_runs(docs([(1, "a b c " * n), (2, " ".join(map(str, range(n))))])).select("doc_id", "n_runs", "start", "length", "period", "text").collect()
    assert [tuple(x)[:5] for x in sorted(got, key=lambda x: x[0])] == [(1, 1, 0, 3 * n, 3), (2, 0, None, None, None)]
    assert next(x["text"] for x in got if x["doc_id"] == 1) == "a b c"


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r["text"] or "").split()) < 3000]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(rows) > 150
    for k, t in rows:
        assert got[k] == digest(k, t)
