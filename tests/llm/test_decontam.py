import hashlib
import random
import re

import pytest

from tessera.llm.decontam import decontaminate
from tessera.llm.registry import QUERIES


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    names |= found
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs):
    r = random.Random(5)
    vocab = ["alpha", "Beta", "été", "x1", "42", "ñu", "Zed"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ".", "!", "-q"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 10, 9, 4, 1, 12, 0, 25])] + [(11, None), (1, "Beta beta."), (1, "Beta beta."), (None, "unique words here")]
    rows = []
    for d in range(60):
        parts = [text(r.randint(0, 12))]
        for _ in range(r.randint(0, 2)):
            w = re.sub("[.!]", "", r.choice(items)[1] or "").upper().split()
            a = r.randrange(len(w) + 1)
            parts += ["\n".join(w[a : a + r.randint(5, 20)]), text(r.randint(0, 5))]
        rows.append((d, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "\x00\x7f--"), (None, items[0][1]), (63, items[0][1]), (63, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as len", "'k' as key")
    got = decontaminate(docs(rows), bench).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, items)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(x)[:4] for x in decontaminate(docs([(1, "a b")]), none).collect()] == [(1, 2, 0, 0)]
    assert decontaminate(docs([]), none).count() == 0


def test_long_texts_and_equal_windows(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, item), (3, "x " * 30)], "item_id bigint, text string")
    rows = [(1, "w " * 300_000 + item), (2, "x " * 100_000), (3, "w " * 1000)]
    got = decontaminate(docs(rows), bench).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, [(1, item), (2, item), (3, "x " * 30)])


@pytest.mark.parametrize("bound", [("SEND", 3), ("SEND_BYTES", 100)])
def test_shuffled_fingerprints_give_the_same(spark, docs, monkeypatch, bound):
    import tessera.llm.decontam as D

    r = random.Random(6)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(14))) for i in range(8)] + [(9, "b c")]
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(20)) + " " + r.choice(items)[1]) for i in range(40)]
    monkeypatch.setattr(D, *bound)
    got = decontaminate(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, items)


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op10_decontamination"](spark, sf).collect()
    expected = brute(rows, items)
    assert sorted((tuple(x) for x in got), key=str) == expected
    assert any(x[5] for x in expected)
