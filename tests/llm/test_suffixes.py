import hashlib
import random
from collections import Counter

import numpy as np

from tessera.llm import suffixes
from tessera.llm.registry import QUERIES
from tessera.llm.suffixes import Shard, find_runs, merge, remove_repeated_bytes, repeated, symbol_bytes


def brute(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for (d, _), r in zip(rows, raw):
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        flag = np.cumsum(gone)[:-1] > 0
        spans = int((flag & ~np.concatenate([[False], flag[:-1]])).sum()) if len(r) else 0
        out.append((d, len(r), int(flag.sum()), spans, bytes(b for b, g in zip(r, flag) if not g)))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9)))
    text = lambda k: "".join(word() + r.choice([" ", " ", "\n", ""]) for _ in range(k))
    base = [text(r.randint(20, 90)) for _ in range(8)]
    rows = []
    for d in range(n):
        t = text(r.randint(0, 20))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randrange(len(b))
            piece = b[a : a + r.randint(20, 400)]
            if r.random() < 0.4 and piece:
                k = r.randrange(len(piece))
                piece = piece[:k] + "#" + piece[k + 1 :]
            t += piece + text(r.randint(0, 5))
        rows.append((d, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, "x" * 900), (n + 3, "ab " * 300), (n + 4, base[0]), (n + 5, base[0]), (None, rows[3][1]), (n + 6, rows[5][1]), (n + 6, rows[5][1])]


def compare(docs, rows, window):
    got = sorted(((d, n, k, s, bytes(x)) for d, n, k, s, x in remove_repeated_bytes(docs(rows), window).collect()), key=str)
    assert got == brute(rows, window)
    return got


def test_matches_brute_force(docs):
    for seed, window in ((1, 200), (2, 64), (3, 17)):
        assert sum(x[2] for x in compare(docs, made(seed), window)) > 1000


def test_long_texts_come_in_pieces(docs, monkeypatch):
    """Runs are cut where pieces meet; every window is in one piece, and copies that are cut elsewhere are found."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 500)
    rows = made(6, 12)
    whole = " ".join(t for _, t in rows if t)
    got = list(suffixes.chunks([whole, None, "short", "x" * 700], 200))
    seen = Counter((p, b + i) for ps, bs, ts in got for p, b, t in zip(ps.tolist(), bs.tolist(), ts) for i in range(len(t) - 199))
    assert max(seen.values()) == 1 and len(seen) == len(whole.encode()) - 199 + 501 and max(len(t) for _, _, ts in got for t in ts) <= 699
    monkeypatch.undo()
    monkeypatch.setattr(suffixes, "runs_of", in_pieces_of(500))
    compare(docs, [*rows, (900, whole), (901, "a" + whole)], 200)


def in_pieces_of(size):
    """``runs_of`` with small pieces, made here, as executors do not see a patched constant."""
    whole = suffixes.runs_of

    def run(docs, window):
        rows = docs.select("row", "text").collect()
        before, suffixes.CHUNK_BYTES = suffixes.CHUNK_BYTES, size
        try:
            out = []
            for place, begin, texts in suffixes.chunks([r["text"] for r in rows], window):
                d, first, n, anchor, seg = find_runs(texts, window)
                out += zip([rows[place[k]]["row"] for k in d], (first + begin[d]).tolist(), n.tolist(), anchor.view(np.int64).tolist(), seg.view(np.int64).tolist())
        finally:
            suffixes.CHUNK_BYTES = before
        return docs.sparkSession.createDataFrame(out, whole(docs, window).schema)

    return run


def test_windows_of_hot_anchors_are_dealt_one_by_one(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_RUNS", 3)
    r = random.Random(7)
    passage = " ".join(f"licence{i}" for i in range(40))
    rows = [(i, "".join(r.choice("abc") for _ in range(6)) + " " + passage + f" end{i % 7}") for i in range(200)]
    compare(docs, rows + made(9, 20), 200)


def test_runs_cover_every_window_once():
    r = random.Random(5)
    texts = [t.encode() for _, t in made(4) if t] + [bytes(r.randrange(256) for _ in range(3000)), b"y" * 700]
    doc, first, size, anchor, seg = find_runs(texts, 200)
    seen = Counter((d, f + k) for d, f, s in zip(doc.tolist(), first.tolist(), size.tolist()) for k in range(s))
    assert set(seen) == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 199)} and max(seen.values()) == 1
    of = {}
    for d, f, s, a in zip(doc.tolist(), first.tolist(), size.tolist(), anchor.tolist()):
        for k in range(s):
            assert of.setdefault(texts[d][f + k : f + k + 200], a) == a


def test_merge_refines_to_the_order_and_prefixes_of_one_sort(monkeypatch):
    """Shards' transforms, merged, stand as if all suffixes had been sorted at once; a shard's transform leads back through its strings."""
    r = np.random.default_rng(3)
    parts, width, depth = [r.integers(1, 4, int(k)).astype(np.uint64) for k in r.integers(8, 40, 6)], 2, 5
    shards, suffix = [], []
    for p in parts:
        follows = np.arange(len(p)) + width < len(p)
        s = Shard(p, follows, width, depth)
        rows = [tuple(p[i::width][:depth].tolist()) for i in range(len(p))]
        assert [rows[i] for i in s.order] == sorted(rows)
        assert [int(x) for x in s.before] == [int(p[i - width]) if i >= width else 0 for i in s.order]
        shards.append(s)
        suffix += [rows[i] for i in s.order]
    order, block, common = merge(shards, depth)
    told = [suffix[i] for i in order]
    assert told == sorted(suffix)
    for i in range(1, len(told)):
        same = next((k for k in range(depth) if told[i][k : k + 1] != told[i - 1][k : k + 1]), depth)
        # strings that end alike are equal at every depth
        assert common[i] == (depth if told[i] == told[i - 1] else same)
        assert (block[order[i]] == block[order[i - 1]]) == (told[i] == told[i - 1])


def test_shards_of_a_bin(monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BITS", 9)
    monkeypatch.setattr(suffixes, "WIDTH", 6)
    r = random.Random(2)
    bodies = [bytes(r.choice(b"ab") for _ in range(r.randint(24, 60))) for _ in range(80)]
    n = np.array([r.choice([1, 1, 1, 2]) for _ in bodies])
    seen = Counter()
    for b, k in zip(bodies, n.tolist()):
        for i in range(len(b) - 23):
            seen[b[i : i + 24]] += k
    assert repeated(bodies, n, 24).tolist() == [seen[b[i : i + 24]] > 1 for b in bodies for i in range(len(b) - 23)]
    assert [symbol_bytes(w) for w in (200, 64, 17, 53, 80)] == [5, 4, 1, 1, 5]


def test_equal_hashes_of_different_bytes_are_told(monkeypatch):
    real, tried = suffixes.symbols, []

    def poor(data, at, width, salt):
        tried.append(salt)
        return real(data, at, width, salt) if salt > 1 else np.ones(len(at), np.uint64)

    monkeypatch.setattr(suffixes, "symbols", poor)
    assert not repeated([bytes(range(80)), bytes(range(100, 180))], np.array([1, 1]), 40).any() and tried == [0, 1, 2]


def test_long_and_empty(docs):
    long = " ".join(str(i) for i in range(150_000))
    got = sorted(tuple(x)[:4] for x in remove_repeated_bytes(docs([(1, long), (2, "z " + long), (3, "q" * 500_000), (4, None)])).collect())
    n = len(long)
    assert got == [(1, n, n, 1), (2, n + 2, n, 1), (3, 500_000, 500_000, 1), (4, 0, 0, 0)]
    assert remove_repeated_bytes(docs([])).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(x) for x in QUERIES["op11_suffix_array_dedup"](spark, sf).collect()), key=str)
    assert got == sorted(((d, n, k, s, hashlib.sha256(b).hexdigest()) for d, n, k, s, b in brute(rows, 200)), key=str)
