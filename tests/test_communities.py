import hashlib
import random
from collections import Counter, defaultdict

from tessera.operators.communities import louvain


def luck(turn, node):
    return int(hashlib.md5(f"{turn}:{node}".encode()).hexdigest()[:12], 16) % 2 == 0


def plain(pairs, rounds=12, levels=8):
    """The same moves with dictionaries, node by node."""
    w = Counter(tuple(sorted(p)) for p in pairs)
    of = {x: x for p in w for x in p}
    total = 2 * sum(w.values())

    def score(com, k):
        tot = Counter()
        for x in k:
            tot[com[x]] += k[x]
        return total * sum(2 * n for (a, b), n in w.items() if com[a] == com[b]) - sum(t * t for t in tot.values())

    for level in range(levels):
        k, near = Counter(), defaultdict(Counter)
        for (a, b), n in w.items():
            k[a] += n
            k[b] += n
            if a != b:
                near[a][b] += n
                near[b][a] += n
        com = {x: x for x in k}
        best, better = score(com, k), False
        for r in range(rounds):
            tot = Counter()
            for x in k:
                tot[com[x]] += k[x]
            new = {}
            for x in k:
                by = Counter({com[x]: 0})
                for y, n in near[x].items():
                    by[com[y]] += n
                gain = {c: total * n - k[x] * (tot[c] - (k[x] if c == com[x] else 0)) for c, n in by.items()}
                top = max(gain.values())
                new[x] = com[x] if gain[com[x]] == top or not luck(f"{level}:{r}", x) else min(c for c in gain if gain[c] == top)
            now = score(new, k)
            if now < best or (now == best and r % 2):
                break
            com, better, best = new, better or now > best, now
        if not better:
            break
        name = {}
        for x in sorted(com, reverse=True):
            name[com[x]] = x
        of = {x: name[com[c]] for x, c in of.items()}
        merged = Counter()
        for (a, b), n in w.items():
            merged[tuple(sorted((name[com[a]], name[com[b]])))] += n
        w = merged
    return of


def modularity(pairs, of):
    m, k, inside, tot = len(pairs), Counter(), 0, Counter()
    for a, b in pairs:
        k[a] += 1
        k[b] += 1
        inside += of[a] == of[b]
    for x, n in k.items():
        tot[of[x]] += n
    return inside / m - sum((t / (2 * m)) ** 2 for t in tot.values())


def test_louvain_equals_plain_moves(spark):
    r = random.Random(1)
    pairs = []
    for c in range(6):
        own = [f"c{c}n{i}" for i in range(10)]
        pairs += [tuple(r.sample(own, 2)) for _ in range(30)]
    pairs += [(f"c{r.randrange(6)}n{r.randrange(10)}", f"c{r.randrange(6)}n{r.randrange(10)}") for _ in range(12)] + [("c0n0", "c0n0"), ("x", "y"), ("loop", "loop")]
    got = {x["id"]: x["community"] for x in louvain(spark.createDataFrame([*pairs, (None, "x")], "source string, target string")).collect()}
    want = plain(pairs)
    assert got == want
    truth = {x: x[:2] if x[0] == "c" else x for x in got} | {"y": "x"}
    assert modularity(pairs, got) >= modularity(pairs, truth) - 0.02 and 5 <= len(set(got.values())) <= 10


def test_no_edges(spark):
    assert louvain(spark.createDataFrame([], "source string, target string")).count() == 0
