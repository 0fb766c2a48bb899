import random

from tessera.llm.lines import dedup_lines
from tessera.llm.registry import QUERIES


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_words=6):
    seen, gone = [], {}
    for d, no, line in sorted({(d, i, x) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.split("\n"))}):
        w = line.lower().split()
        if not w:
            continue
        for v in seen:
            if v == w or (min(len(v), len(w)) >= min_words and near(v, w)):
                gone.setdefault(d, set()).add(no)
                break
        seen.append(w)
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        cut = gone.get(d, set()) if d is not None else set()
        kept = [x for i, x in enumerate(lines) if i not in cut]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    r = random.Random(2)
    lines = [" ".join(r.choice("abcdefg") for _ in range(r.choice([1, 2, 5, 6, 7, 8, 9, 12]))) for _ in range(25)] + ["", "  "]
    rows = []
    for d in range(60):
        own = []
        for _ in range(r.randint(0, 6)):
            w = r.choice(lines).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                if w:
                    i = r.randrange(len(w))
                    w[i : i + 1] = r.choice([[], [w[i], "z"], ["y"], ["a"], ["z", w[i]]])
            own.append(r.choice([" ", "\t", "  "]).join(w) if r.random() < 0.8 else " ".join(w).upper())
        rows.append((d, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[0][1]), (103, rows[5][1]), (103, rows[5][1])]
    got = dedup_lines(docs(rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)


def test_insertion_at_both_ends(docs):
    base = "one two three four five six seven"
    rows = [(0, base), (1, "zero " + base), (2, base + " eight"), (3, "two three four five six seven"), (4, "one two three four five six"), (5, "x y three four five six seven")]
    got = {x["doc_id"]: x["n_removed"] for x in dedup_lines(docs(rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_empty_table(docs):
    assert dedup_lines(docs([])).count() == 0


def test_long_line(docs):
    long = " ".join(f"w{i}" for i in range(3000))
    got = {x["doc_id"]: x["n_removed"] for x in dedup_lines(docs([(1, long), (2, long + " x"), (3, long + " y z")])).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in QUERIES["op6_line_dedup"](spark, sf).collect()}
    expected = {d: (n, k) for d, n, k, _ in brute(rows)}
    assert got == expected
