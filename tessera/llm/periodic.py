"""Runs: stretches of words that repeat with a period.

The words of some documents are numbered apart and their suffixes sorted
by doubling, documents side by side. From the suffix array and the common
prefixes of its neighbours follows, for each place, the longest factor
that also starts earlier in the document, and with it the division into
factors. A run ``[s, e]`` of period ``q`` repeats itself from ``s + q`` on,
so that each place from there on has a previous factor that reaches ``e``:
at most one factor begins between ``s + q`` and ``e``. Hence a run either

* touches a factor's boundary, and comparing the boundary with the place
  ``q`` words before or after it, in both directions, gives the run; ``q``
  is at most half of what the two factors at the boundary hold; or
* lies strictly inside one factor, and is a copy of a run that starts
  earlier, where the factor's previous occurrence stands. Runs are kept in
  buckets by start and copied factor by factor.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .substring import chunks

#: Rounds of pointer jumping after which a stack takes over.
JUMPS = 48


class Suffixes:
    """Sorted suffixes of a sequence of numbers, with what comparing two of them needs: their ranks by 1, 2, 4, ... numbers."""

    def __init__(self, symbol: np.ndarray):
        n = self.n = len(symbol)
        bits = np.uint64(max(1, int(n).bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        packs = 3 * int(bits) <= 64
        rank = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        row = np.argsort(symbol, kind="stable")
        told = symbol[row]
        head = np.ones(n + 1, bool)
        head[1:n] = told[1:] != told[:-1]
        slot = np.arange(n)
        rank[row] = np.maximum.accumulate(np.where(head[:n], slot, 0)) + 1
        self.order, self.levels, h = row, [rank.copy()], 1
        slot = np.flatnonzero(~(head[:n] & head[1:]))
        while len(slot):
            row = self.order[slot]
            one, two = rank[row].astype(np.uint64), rank[np.minimum(row + h, n)].astype(np.uint64)
            if packs:
                at = (np.sort(one << (bits + bits) | two << bits | np.arange(len(row), dtype=np.uint64)) & mask).astype(np.int64)
            else:
                at = np.lexsort((two, one))
            row, one, two = row[at], one[at], two[at]
            head = np.ones(len(slot) + 1, bool)
            head[1:-1] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            self.order[slot] = row
            rank[row] = np.maximum.accumulate(np.where(head[:-1], slot, 0)) + 1
            self.levels.append(rank.copy())
            slot = slot[~(head[:-1] & head[1:])]
            h *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, which differ; ``n`` is the empty one."""
        a, out = a.copy(), np.zeros(len(a), np.int64)
        b = b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            out += step
            a += step
            b += step
        return out


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest factor that also starts at an earlier place, and that place (-1 if there is none)."""
    n, order = s.n, s.order
    lcp = np.zeros(n + 1, np.int64)
    same = np.flatnonzero(s.levels[0][order[1:]] == s.levels[0][order[:-1]]) + 1
    lcp[same] = s.common(order[same - 1], order[same])
    size, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for step in (-1, 1):
        to, least = np.arange(n) + step, lcp[:n].copy() if step < 0 else lcp[1:].copy()
        # a neighbour of common prefix 0 ends the search; places that stand earlier in the text end it too
        rest = np.flatnonzero(least > 0)
        rest = rest[order[to[rest]] > order[rest]]
        for _ in range(JUMPS):
            if not len(rest):
                break
            over = to[rest]
            least[rest], to[rest] = np.minimum(least[rest], least[over]), to[over]
            rest = rest[least[rest] > 0]
            rest = rest[order[to[rest]] > order[rest]]
        for a, b in groups(s.levels[0][order], rest):
            to[a:b], least[a:b] = by_stack(order[a:b].tolist(), lcp[a : b + 1].tolist(), step)
            to[a:b] += a
        better = np.flatnonzero(least > size[order])
        size[order[better]], source[order[better]] = least[better], order[to[better]]
    return size, source


def groups(rank: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal ranks, which ascend, that hold the given places."""
    told = np.sort(rank[at])
    told = told[np.append(True, told[1:] != told[:-1])] if len(told) else told
    return list(zip(np.searchsorted(rank, told, "left").tolist(), np.searchsorted(rank, told, "right").tolist()))


def by_stack(order: list[int], lcp: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest neighbour in suffix order that stands earlier in the text, and the common prefix with it, by one pass."""
    n = len(order)
    to, least = [-1] * n, [0] * n
    stack: list[int] = []
    for i in range(n) if step < 0 else range(n - 1, -1, -1):
        m = lcp[i] if step < 0 else lcp[i + 1]
        while stack and order[stack[-1]] > order[i]:
            m = min(m, least[stack.pop()])
        if stack:
            to[i], least[i] = stack[-1], m
        stack.append(i)
    return np.array(to), np.array(least)


def factors(size: np.ndarray) -> np.ndarray:
    """Starts of the factors: each is the longest that also starts earlier, or one word."""
    starts, at, step = [], 0, np.maximum(size, 1).tolist()
    n = len(step)
    while at < n:
        starts.append(at)
        at += step[at]
    return np.array(starts, np.int64)


def touching(symbol: np.ndarray, end: np.ndarray, s: Suffixes, starts: np.ndarray, words: int, times: int) -> np.ndarray:
    """``start, end, period`` of the runs that touch a boundary between factors; ``end`` is the last word's place plus one."""
    begin = np.concatenate([[0], end[:-1]])
    bound = np.sort(np.concatenate([starts, end]))
    bound = bound[np.append(True, bound[1:] != bound[:-1])]
    # a document's end is a boundary of its own: pairs (boundary, document), the next document's start being another
    doc = np.searchsorted(end, bound, "right")
    last = np.flatnonzero(end > begin)
    bound, doc = np.concatenate([bound[bound < end[-1]], end[last]]), np.concatenate([doc[bound < end[-1]], last])
    order = np.lexsort((bound, doc))
    bound, doc = bound[order], doc[order]
    left, right = np.zeros(len(bound), np.int64), np.zeros(len(bound), np.int64)
    near = doc[1:] == doc[:-1]
    left[1:] = np.where(near, bound[1:] - bound[:-1], 0)
    right[:-1] = left[1:]
    both = left + right
    keep = np.flatnonzero(both >= words - words // times)
    if not len(keep):
        return np.zeros((0, 3), np.int64)
    bound, doc, most = bound[keep], doc[keep], both[keep] // (times - 1)
    of = np.repeat(np.arange(len(keep)), most)
    q = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    b, d = bound[of], doc[of]
    # only these documents are read backwards
    used = np.unique(doc)
    size = (end - begin)[used]
    flip_end = np.cumsum(size)
    source = np.repeat(end[used] - 1 + flip_end - size, size) - np.arange(flip_end[-1])
    back = Suffixes(symbol[source])
    top = np.full(len(end), -1, np.int64)
    top[used] = flip_end - size + end[used] - 1
    found = []
    for a, c in ((b, b + q), (b - q, b)):
        ok = np.flatnonzero((a >= begin[d]) & (c <= end[d]))
        a, c, k, t = a[ok], c[ok], q[ok], top[d[ok]]
        ahead, behind = s.common(a, c), back.common(t - a + 1, t - c + 1)
        long = np.flatnonzero(ahead + behind + k >= np.maximum(words, times * k))
        a, k, ahead, behind = a[long], k[long], ahead[long], behind[long]
        found.append(np.stack([a - behind, a + k + ahead, k], 1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def copied(runs: list[tuple[int, int, int]], starts: np.ndarray, size: np.ndarray, source: np.ndarray, words: int) -> list[tuple[int, int, int]]:
    """The runs and those strictly inside factors, which are copies of runs that start earlier."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for a, e, q in runs:
        bucket.setdefault(a, []).append((e, q))
    order = sorted(bucket)
    length = size[starts]
    for b, n in zip(starts[length >= words + 2].tolist(), length[length >= words + 2].tolist()):
        at, shift = int(source[b]), b - int(source[b])
        i = bisect_left(order, at + 1)
        while i < len(order) and order[i] + words < at + n:
            for e, q in bucket[order[i]]:
                if e < at + n:
                    there = bucket.setdefault(order[i] + shift, [])
                    if not there:
                        insort(order, order[i] + shift)
                    if (e + shift, q) not in there:
                        there.append((e + shift, q))
            i += 1
    return [(a, e, q) for a in order for e, q in bucket[a]]


def find_runs(docs: list[list[bytes]], words: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of each document's runs of ``max(words, times * period)`` words or more, by start and period."""
    end = np.cumsum([len(d) for d in docs])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not len(end) or not end[-1]:
        return out
    ids, base = [], 0
    for d in docs:
        told: dict[bytes, int] = {}
        ids.extend([base + told.setdefault(w, len(told)) for w in d])
        base += len(told)
    symbol = np.array(ids, np.int64)
    s = Suffixes(symbol)
    size, source = previous_factors(s)
    starts = factors(size)
    runs = touching(symbol, end, s, starts, words, times)
    doc = np.searchsorted(end, runs[:, 0], "right")
    for d in np.unique(doc).tolist():
        a, e = int(end[d]) - len(docs[d]), int(end[d])
        own = copied([tuple(r) for r in runs[doc == d].tolist()], starts[np.searchsorted(starts, a) : np.searchsorted(starts, e)], size, source, words)
        out[d] = sorted((x - a, y - x, q) for x, y, q in own)
        out[d].sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats, which are all after its first period."""
    out, done = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if a > done:
            out += words[done:a]
        done = max(done, b)
    return out + words[done:]


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a period written into every tenth document, by the checksum of its id; a null id changes nothing."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def periodic_runs(
    df: DataFrame,
    words: int = 24,
    times: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The runs of each text: maximal stretches of words with smallest period ``q`` and ``max(words, times * q)`` words or more.

    Words stand between ASCII white space and are numbered from 0;
    ``rewrite(id, words)`` may change them first. Returns ``doc_id,
    n_runs, start, length, period, exponent_milli`` (of the run of the
    greatest length / period; ties: smallest start, then period; nulls
    without runs), ``runs`` (all, by start and period) and ``text`` (words
    joined by one space, without those that a run repeats). One row for
    each row: repeated rows and null ids are treated like others; a null
    text has no words, no runs and an empty result; a text of any length
    is read whole, by one task, with some 100 bytes a word; an empty table
    gives no rows; further columns are not read, whatever their names.
    Words are compared as bytes, by exact numbers.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, docs_ in chunks(b.column(1).to_pylist()):
                if rewrite is not None:
                    docs_ = [rewrite(k, d) for k, d in zip(keys[first : first + len(docs_)], docs_)]
                found = find_runs(docs_, words, times)
                best = [strongest(r) or (None, None, None) for r in found]
                columns = [pa.array([len(r) for r in found], pa.int64())]
                columns += [pa.array([x[k] for x in best], pa.int64()) for k in range(3)]
                columns.append(pa.array([n and 1000 * n // q for _, n, q in best], pa.int64()))
                columns.append(pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(one)))
                columns.append(pa.array([b" ".join(collapse(d, r) if r else d).decode() for d, r in zip(docs_, found)], pa.string()))
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(docs_)), *columns], names=names)

    shape = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string"
    return docs.mapInArrow(run, f"doc_id {kind}, {shape}")
