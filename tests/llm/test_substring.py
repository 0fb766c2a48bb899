import hashlib
import random
import re
from collections import Counter

from tessera.llm.registry import QUERIES
from tessera.llm.substring import Phrases, remove_repeats, with_copies, without_copies


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    r = random.Random(4)
    word = lambda: r.choice("abcdefghij") * r.randint(1, 9)
    base = [[word() for _ in range(r.randint(20, 150))] for _ in range(12)]
    rows = []
    for d in range(70):
        w = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            b = list(r.choice(base))
            a = r.randrange(len(b))
            piece = b[a : a + r.randint(15, 90)]
            for _ in range(r.randint(0, 1)):
                piece[r.randrange(len(piece))] = "EDIT"
            w += piece + [word() for _ in range(r.randint(0, 8))]
        rows.append((d, r.choice([" ", "\n", "\x0b \t"]).join(w)))
    rows += [(70, None), (71, ""), (72, "\x1c a b"), (73, "x " * 200), (74, " ".join(base[0])), (75, " ".join(base[0])), (None, rows[3][1]), (76, rows[5][1]), (76, rows[5][1])]
    got = sorted((tuple(x) for x in remove_repeats(docs(rows), 35).collect()), key=str)
    assert got == brute(rows, 35)


def test_nothing_is_removed_but_by_the_automaton(docs):
    """Shards see only the passages that they are dealt; a run of one document and a stretch inside another are both found."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(["a"] * 5 + base[10:50] + ["b"] * 5)), (3, " ".join(base[30:60]))]
    assert [x[2] for x in sorted(tuple(x) for x in remove_repeats(docs(rows), 35).collect())] == [40, 40, 0]
    p = Phrases([" ".join(base[5:45]), " ".join(base[20:55])])
    assert p.covered([w.encode() for w in base]).tolist() == [False] * 5 + [True] * 50 + [False] * 5
    assert not p.covered([b"x", *[w.encode() for w in base[5:44]]]).any() and not Phrases([]).covered([b"x"]).any()


def test_many_kinds_of_words():
    words = [f"w{i}".encode() for i in range(70_000)]
    p = Phrases([" ".join(w.decode() for w in words)])
    assert p.width == 3 and p.covered([b"x", *words, b"y"]).sum() == 70_000


def test_many_copies_of_a_row_are_told_by_two(docs):
    """Rows equal in id and text, null ids too, are dealt over all tasks and lose what recurs."""
    copied, short = " ".join(f"c{i}" for i in range(50)), "too short to lose anything"
    rows = [(None, copied)] * 3000 + [(5, short)] * 1500 + [(6, copied + " tail")] + [(i, f"other {i}") for i in range(10, 40)]
    df = docs(rows).select("doc_id", "text")
    rest, pairs = without_copies(df)
    assert rest.count() == 31 and sorted(x["copies"] for x in pairs.collect()) == [1, 1, 1499, 2999]
    assert without_copies(docs(rows[:2]))[1] is None
    got = sorted((tuple(x) for x in remove_repeats(df, 35).collect()), key=str)
    assert got == brute(rows, 35)
    assert with_copies(pairs).where("doc_id is null").count() == 3000


def test_long_texts(docs):
    long = " ".join(f"{i}" for i in range(300_000))
    rows = [(1, long), (2, "z " + long), (3, "x " * 300_000)]
    assert sorted(tuple(x)[:3] for x in remove_repeats(docs(rows), 35).collect()) == [(1, 300_000, 300_000), (2, 300_001, 300_000), (3, 300_000, 300_000)]


def test_empty_table(docs):
    assert remove_repeats(docs([])).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(x) for x in QUERIES["op3_substring_dedup"](spark, sf).collect()), key=str)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 35)), key=str)
