import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import variants
from tessera.llm.registry import QUERIES
from tessera.llm.variants import deletion_keys, spelling_variants


def brute(rows, mistakes, least=5, many=3):
    """Every word against every other."""
    n = Counter()
    for key, text in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if key is None else key}:{x}".encode())
            if mistakes and h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            n[x] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= many}
    near = {w: [] for w in n}
    by_len = {}
    for w in n:
        by_len.setdefault(len(w), []).append(w)

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for k, ws in by_len.items():
        for i, a in enumerate(ws):
            for b in ws[i + 1 :]:
                if one(a, b):
                    near[a].append(b)
                    near[b].append(a)
            for b in by_len.get(k + 1, []):
                if one(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def made(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(25)] + ["aaaaaa", "aaaaa", "aaaaaaa"]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(r.randint(0, 40)):
            w = base[min(int(r.expovariate(0.2)), len(base) - 1)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÉ") + w[k:], w[:k] + r.choice("abé×") + w[k + 1 :]])
            ws.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        rows.append((i, r.choice([" ", ", ", "1", "ł"]).join(ws)))
    chain = [w for w, k in (("chainaaa", 3), ("chainaab", 7), ("chainabb", 15), ("chainbbb", 31), ("chainbbbb", 62)) for _ in range(k)]
    return rows + [(100 + i, w) for i, w in enumerate(chain)] + [(None, rows[0][1]), (7, None), (8, ""), (9, rows[1][1]), (9, rows[1][1])]


@pytest.mark.parametrize("mistakes", [False, True])
def test_matches_brute_force(docs, mistakes):
    rows = made(1)
    got = sorted((tuple(x[c] for c in COLUMNS) for x in spelling_variants(docs(rows), mistakes=mistakes).collect()), key=str)
    expected = brute(rows, mistakes)
    assert got == sorted(expected, key=str) and sum(x[1] is not None for x in expected) > 20 and any(x[2] != (x[1] or x[0]) for x in expected)


def test_equal_keys_of_different_strings(docs, monkeypatch):
    """Every key the same: only the strings tell words apart."""
    real = deletion_keys

    def poor(words):
        word, at, key = real(words)
        return word, at, key & np.uint64(3)

    monkeypatch.setattr(variants, "deletion_keys", poor)
    import pyarrow as pa

    words = [(w, n) for w, _, _, n, _, _ in brute(made(2), False)]
    word, at, key = poor([w for w, _ in words])
    got = variants.match(pa.table({"key": key.view(np.int64), "at": at, "word": [words[i][0] for i in word], "n": [words[i][1] for i in word]}))
    n = Counter()
    for w, k in zip(got["word"].to_pylist(), got["n_near"].to_pylist()):
        n[w] += k
    assert {w: n[w] for w, _ in words} == {x[0]: x[4] for x in brute(made(2), False)}


def test_keys_are_those_of_the_strings():
    words = ["abcde", "é" * 5, "zzabcde", "abcd", "aabcde"]
    word, at, key = deletion_keys(words)
    of = {}
    for i, k, x in zip(word.tolist(), at.tolist(), key.tolist()):
        assert of.setdefault(variants.rest(words[i], k), x) == x
    assert len(set(of.values())) == len(of) and of["abcde"] == key[0]


def test_long_and_empty(docs):
    long = "wordy " * 200_000 + "worby " * 3 + "x" * 300_000
    got = sorted(tuple(x[c] for c in COLUMNS) for x in spelling_variants(docs([(1, long)])).collect())
    assert got == [("worby", "wordy", "wordy", 3, 1, 200_000), ("wordy", None, "wordy", 200_000, 1, None)]
    assert spelling_variants(docs([])).count() == 0 and spelling_variants(docs([(1, None)])).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(x[c] for c in COLUMNS) for x in QUERIES["op13_spelling_variants"](spark, sf).collect()), key=str)
    assert got == sorted(brute(rows, True), key=str)
