"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A string of ``window`` bytes that occurs twice is looked for where both of
its occurrences must meet:

* each window is anchored at the least hash of the phrases in it, those at
  the starts of words first. Neighbouring windows with one anchor form a
  run; equal windows have equal anchors, so runs whose anchor occurs once
  hold nothing that recurs;
* the other runs are told once each as bytes, with the number of times
  that they occur, and dealt to bins by anchor. An anchor of very many
  different runs is dealt window by window.

In each bin the runs form shards. Each shard's suffixes are sorted once;
its transform is the symbol before each suffix, in suffix order. A symbol
stands for ``width`` bytes, so that a window is ``window / width`` symbols
and suffixes begin at every byte. The transforms are merged by refining
their interleave: at each depth rows go to the bucket of their first
symbol in the order in which their successors stand. A row's key ascends
within its shard, so this merges sorted runs and sorts no suffixes again.
The depth at which a boundary between neighbours appears is their common
prefix; blocks without boundary down to ``window`` bytes are the repeated
intervals, and they alone decide which bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, join_skewed
from .minhash import mix

#: Bytes of text whose runs are sought at once; longer texts are sought piece by piece.
CHUNK_BYTES = 4_000_000
#: Bytes of runs that a bin is meant to hold, and runs of one anchor beyond which its windows are dealt one by one.
BIN_BYTES, HOT_RUNS = 1_000_000, 2_000
#: Suffixes of a shard and hash of a symbol, in bits; a shard is at most one run larger, so that both fit a word of 64.
SHARD_BITS, SYMBOL_BITS = 18, 44
#: Most bytes of a symbol.
WIDTH = 50
_MUL = np.uint64(0xD6E8FEB86659FD93)
_FAR = 1 << 60


def phrase_bytes(window: int) -> int:
    """Bytes of an anchor phrase, a multiple of eight."""
    return 8 * max(1, min(6, window // 32))


def symbol_bytes(window: int) -> int:
    """Bytes of a symbol: the largest divisor of the window that is not above ``WIDTH``."""
    return next(w for w in range(min(WIDTH, window), 0, -1) if window % w == 0)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))


def nearest(at: np.ndarray, key: np.ndarray, span: int, back: bool) -> np.ndarray:
    """Place of the nearest element within ``span`` whose key is less (before: or equal); far away if there is none."""
    n = len(at)
    out = np.full(n, -_FAR if back else _FAR, np.int64)
    rest = np.arange(n)
    for k in range(1, n):
        rest = rest[rest >= k] if back else rest[rest < n - k]
        if not len(rest):
            break
        other = rest - k if back else rest + k
        there, less = at[other], key[other] <= key[rest] if back else key[other] < key[rest]
        near = there >= at[rest] - span if back else there <= at[rest] + span
        hit = near & less
        out[rest[hit]] = there[hit]
        rest = rest[near & ~less]
    return out


def candidates(data: np.ndarray, start: np.ndarray, end: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where anchors may stand, and whether each is one of the second class: inside stretches without a word's start."""
    at = np.flatnonzero((data[:-1] <= 32) & (data[1:] > 32)) + 1
    edges = np.sort(np.concatenate([at, start, end]))
    gap = np.flatnonzero(np.diff(edges) > span)
    if not len(gap):
        return at, np.zeros(len(at), bool)
    size = edges[gap + 1] - edges[gap] - 1
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[gap] + 1, size)
    both, second = np.concatenate([at, inside]), np.repeat([False, True], [len(at), len(inside)])
    order = np.argsort(both, kind="stable")
    return both[order], second[order]


def find_runs(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of some texts: text, first window in it, number of windows, anchor, and hash of the bytes that the run covers."""
    phrase = phrase_bytes(window)
    span = window - phrase
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    start = end - size
    joined = b"".join(texts)
    if not joined:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    data = np.frombuffer(joined + bytes(phrase + 8), np.uint8)
    at, second = candidates(data[: len(joined)], start, end, span)
    eight = words_at(data)
    h = np.zeros(len(at), np.uint64)
    for k in range(0, phrase, 8):
        h = mix(h * _MUL ^ eight[at + k])
    key = h >> np.uint64(1) | second.astype(np.uint64) << np.uint64(63)
    doc = np.searchsorted(end, at, "right")
    first = np.maximum(np.maximum(nearest(at, key, span, True), at - span), start[doc])
    last = np.minimum(np.minimum(at - 1, nearest(at, key, span, False) - span - 1), end[doc] - window)
    real = np.flatnonzero(first <= last)
    first, last, doc = first[real], last[real], doc[real]
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    seg = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + window).tolist())), np.uint64, len(first))
    return doc, first - start[doc], last - first + 1, key[real], seg


def chunks(texts: list[str | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts as bytes, some at a time, with the place of each in the list and where it begins in its text.

    Long texts come in pieces that overlap by what a window needs, so that
    each window is in one of them.
    """
    place, begin, out, n = [], [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8")
        for at in range(0, max(1, len(raw) - window + 1), CHUNK_BYTES):
            place.append(i)
            begin.append(at)
            out.append(raw[at : at + CHUNK_BYTES + window - 1])
            n += len(out[-1])
            if n >= CHUNK_BYTES:
                yield np.array(place), np.array(begin), out
                place, begin, out, n = [], [], [], 0
    if out:
        yield np.array(place), np.array(begin), out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Shard:
    """The transform of some runs: their suffixes' first symbols in order, the symbol before each, and each one's successor.

    ``symbol[i]`` stands for the bytes at the i-th place and ``follows[i]``
    tells whether the place ``width`` further on begins a suffix too.
    """

    def __init__(self, symbol: np.ndarray, follows: np.ndarray, width: int, depth: int):
        n = len(symbol)
        bits = np.uint64(max(1, n.bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        place = np.arange(n, dtype=np.uint64)
        rank = np.zeros(n, np.uint64)
        row = np.sort(symbol << bits | place)
        self.alphabet(row >> bits, row & mask, rank)
        k = 1
        while k < depth:
            second = np.zeros(n, np.uint64)
            ok = self.reach(follows, width, k)
            second[ok] = rank[ok + k * width]
            row = np.sort(rank << (bits + bits) | second << bits | place)
            self.alphabet(row >> bits, row & mask, rank)
            k *= 2
        self.order = (row & mask).astype(np.int64)
        where = np.empty(n, np.int64)
        where[self.order] = np.arange(n)
        self.first = symbol[self.order]
        self.successor = np.full(n, -1, np.int64)
        ok = np.flatnonzero(follows)
        self.successor[where[ok]] = where[ok + width]
        #: The transform itself: the symbol before each suffix, 0 where a string begins.
        self.before = np.zeros(n, np.uint64)
        self.before[where[ok + width]] = symbol[ok]

    @staticmethod
    def alphabet(key: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        """Dense ranks from 1 of sorted keys, put where they belong."""
        new = np.ones(len(key), np.uint64)
        new[1:] = key[1:] != key[:-1]
        rank[place] = np.cumsum(new, dtype=np.uint64)

    @staticmethod
    def reach(follows: np.ndarray, width: int, k: int) -> np.ndarray:
        """Places that ``k`` symbols further on still begin a suffix."""
        at = np.flatnonzero(follows)
        for j in range(1, k):
            at = at[follows[at + j * width]]
        return at


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of the shards' rows down to ``depth`` symbols.

    Returns the rows (numbered through all shards) in merged order, each
    row's block of equal prefixes, and the common prefix of each row in
    merged order with the one before it, in symbols.
    """
    sizes = np.array([len(s.first) for s in shards])
    base = np.cumsum(sizes) - sizes
    first = np.concatenate([s.first for s in shards])
    after = np.concatenate([np.where(s.successor < 0, -1, s.successor + b) for s, b in zip(shards, base)])
    n = len(first)
    common = np.full(n, depth, np.int8)
    bucket = np.zeros(n, np.int64)
    order = np.argsort(first, kind="stable")
    block, blocks = bucket, 0
    for h in range(depth):
        if h:
            key = np.where(after < 0, 0, block[after])
            key += bucket * (n + 1)
            order = np.argsort(key, kind="stable")
        else:
            key = first
        told = key[order]
        new = np.ones(n, bool)
        new[1:] = told[1:] != told[:-1]
        common[new & (common == depth)] = h
        block = np.empty(n, np.int64)
        block[order] = np.cumsum(new)
        if not h:
            bucket = block
        if (now := int(new.sum())) == blocks:
            break
        blocks = now
    return order, block, common


def repeated(bodies: list[bytes], n: np.ndarray, window: int) -> np.ndarray:
    """Which windows of some runs recur: one flag for each window of each run in turn; run ``i`` occurs ``n[i]`` times."""
    width = symbol_bytes(window)
    depth = window // width
    size = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies) + bytes(WIDTH + 8), np.uint8)
    rows = size - width + 1
    top = np.cumsum(rows)
    run = np.repeat(np.arange(len(rows)), rows)
    place = np.arange(top[-1]) - (top - rows)[run]
    at = place + (np.cumsum(size) - size)[run]
    follows = place + width < rows[run]
    cuts = [0]
    for i, t in enumerate(top.tolist()):
        if t - cuts[-1] >= 1 << SHARD_BITS or i == len(rows) - 1:
            cuts.append(t)
    for salt in range(64):
        symbol = symbols(data, at, width, salt)
        shards = [Shard(symbol[a:b], follows[a:b], width, depth) for a, b in zip(cuts, cuts[1:])]
        order, block, common = merge(shards, depth)
        row = np.concatenate([s.order + a for s, a in zip(shards, cuts)])
        told = row[order]
        same = np.flatnonzero(common[1:] > 0)
        if all_equal(data, at[told[same]], at[told[same + 1]], width):
            break
    else:
        raise RuntimeError("symbols of different bytes have equal hashes")
    weight = np.bincount(block, weights=n[run[row]], minlength=int(block.max()) + 1)
    again = np.empty(len(row), bool)
    again[row] = weight[block] > 1
    return again[place <= size[run] - window]


def symbols(data: np.ndarray, at: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hashes, never 0, of the ``width`` bytes at each place, in as many bits as a shard's sort has room for."""
    eight = words_at(data)
    h = np.full(len(at), salt + 1, np.uint64)
    step = list(range(0, width - 7, 8))
    for k in step + ([width - 8] if width > 8 and width % 8 else []):
        h = mix(h * _MUL ^ eight[at + k])
    if width < 8:
        h = mix(h * _MUL ^ eight[at] & np.uint64((1 << 8 * width) - 1))
    return np.maximum(h >> np.uint64(64 - SYMBOL_BITS), np.uint64(1))


def all_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> bool:
    """Whether the ``width`` bytes at ``a`` and ``b`` agree, pair by pair."""
    if width < 8:
        return all((data[a + k] == data[b + k]).all() for k in range(width))
    eight = words_at(data)
    return all((eight[a + k] == eight[b + k]).all() for k in [*range(0, width - 7, 8), width - 8])


def runs_of(docs: DataFrame, window: int) -> DataFrame:
    """The runs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            for place, begin, texts in chunks(b.column(1).to_pylist(), window):
                doc, first, size, anchor, seg = find_runs(texts, window)
                columns = [pa.array(row[place[doc]]), pa.array(first + begin[doc]), pa.array(size.astype(np.int32)), signed(anchor), signed(seg)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "first", "size", "anchor", "seg"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, first bigint, size int, anchor bigint, seg bigint")


def bodies_of(docs: DataFrame, told: DataFrame, window: int) -> DataFrame:
    """The bytes of the runs that ``told`` names, ``runs`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                raw = text.encode("utf-8")
                out += [(r["anchor"], r["seg"], r["n"], r["hot"], raw[r["first"] : r["first"] + r["size"] + window - 1]) for r in runs]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["anchor", "seg", "n", "hot", "body"])

    by_row = told.groupBy("row").agg(F.collect_list(F.struct("first", "size", "anchor", "seg", "n", "hot")).alias("runs"))
    return docs.join(by_row, "row").select("text", "runs").mapInArrow(run, "anchor bigint, seg bigint, n bigint, hot boolean, body binary")


def windows_of(hot: DataFrame, window: int) -> DataFrame:
    """Each window of the runs of hot anchors, by 128 bits of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            body = b.column("body").to_pylist()
            size = np.array([len(x) - window + 1 for x in body], np.int64)
            run_ = np.repeat(np.arange(len(body)), size)
            at = np.arange(len(run_)) - (np.cumsum(size) - size)[run_]
            raw = b"".join(digest(body[r][a : a + window]) for r, a in zip(run_.tolist(), at.tolist()))
            key = np.frombuffer(raw, np.int64).reshape(-1, 2)
            columns = [b.column(k).take(pa.array(run_)) for k in ("anchor", "seg", "n")]
            columns += [pa.array(at.astype(np.int32)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "n", "at", "w1", "w2"])

    return hot.select("anchor", "seg", "n", "body").mapInArrow(run, "anchor bigint, seg bigint, n bigint, at int, w1 bigint, w2 bigint")


def recurring(parts: DataFrame, window: int, bins: int) -> DataFrame:
    """``anchor, seg, at``: first and last of each stretch of windows of a run that recur, by the merged transforms of its bin."""

    def decide(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        bodies = t["body"].to_pylist()
        size = np.array([len(b) - window + 1 for b in bodies], np.int64)
        flags = repeated(bodies, t["n"].to_numpy(), window)
        run = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(run)) - (np.cumsum(size) - size)[run]
        before = np.concatenate([[False], flags[:-1]]) & (at > 0)
        after = np.concatenate([flags[1:], [False]]) & (at < size[run] - 1)
        a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
        own, start = np.unique(run[a], return_index=True)
        pairs = np.stack([at[a], at[b]], 1).reshape(-1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(2 * start, len(pairs)), pa.int32()), pa.array(pairs, pa.int32()))
        return pa.table({"anchor": t["anchor"].take(pa.array(own)), "seg": t["seg"].take(pa.array(own)), "at": lists})

    keyed = parts.select("anchor", "seg", "n", "body", F.pmod(F.xxhash64("anchor"), F.lit(bins)).alias("bin"))
    return keyed.groupBy("bin").applyInArrow(decide, "anchor bigint, seg bigint, at array<int>")


def remove_repeated_bytes(df: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of ``window`` bytes that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes; strings are judged on the input and never cross
    rows; ``window`` is 16 or more. Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept``, one row for each row; ``kept`` is binary, as a cut
    may fall inside a character. A null text is empty; texts shorter than
    a window keep all bytes; a text of any length is read whole, by one
    task; repeated rows repeat each other's strings and lose them all;
    ties do not arise; null ids stay null; an empty table gives no rows;
    further columns are not read, whatever their names. Runs are told
    apart by 128 bits (anchor and bytes); within a bin bytes are compared.
    """
    if window < 16:
        raise ValueError("a window has 16 bytes or more")
    docs = cut(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    runs = cut(runs_of(docs, window), "runs")
    twice = cut(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    again = cut(join_skewed(runs, twice, ["anchor"]), "recurring")
    drop(runs, twice)
    told = again.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "size")).alias("rep"))
    told = cut(told.select("anchor", "seg", "n", "rep.*"), "told")
    hot = told.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_RUNS).select("anchor", F.lit(True).alias("hot"))
    named = told.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    parts = cut(bodies_of(docs, named, window), "parts")
    warm, hot = parts.where("not hot"), parts.where("hot")
    windows = cut(windows_of(hot, window), "windows")
    rep = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("anchor", "seg", "at")).alias("rep")).where("n > 1")
    single = rep.select("w1", "w2", "n", "rows", "rep.*").join(hot.select("anchor", "seg", "body"), ["anchor", "seg"])
    single = cut(single.select(F.col("w1").alias("anchor"), F.col("w2").alias("seg"), "n", "rows", F.expr(f"substring(body, at + 1, {window})").alias("body")), "single")
    total = warm.select(F.octet_length("body").alias("b")).union(single.select(F.octet_length("body"))).agg(F.sum("b")).first()[0] or 0
    bins = -(-total // BIN_BYTES) or 1
    found = recurring(warm, window, bins)
    one = recurring(single, window, bins).join(single.select("anchor", "seg", "rows"), ["anchor", "seg"])
    one = cut(one.select(F.col("anchor").alias("w1"), F.col("seg").alias("w2"), "rows"), "one")
    one = join_skewed(windows, one, ["w1", "w2"], "rows").groupBy("anchor", "seg").agg(F.collect_set("at").alias("at"))
    found = found.union(one.select("anchor", "seg", F.flatten(F.transform("at", lambda x: F.array(x, x))).alias("at")))
    found = cut(found.join(told.select("anchor", "seg", "n"), ["anchor", "seg"]), "found")
    drop(told, parts, windows, single)
    marks = join_skewed(again, found, ["anchor", "seg"]).groupBy("row").agg(F.collect_list(F.struct("first", "at")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut_out((t or "").encode("utf-8"), m or (), window) for t, m in zip(b.column("text").to_pylist(), b.column("marks").to_pylist())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.join(marks, "row", "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def cut_out(raw: bytes, marks: list[dict], window: int) -> tuple[int, int, int, bytes]:
    """Length, removed bytes, removed stretches and kept bytes of a text; marks are stretches of window starts."""
    spans = sorted((m["first"] + a, m["first"] + b + window) for m in marks for a, b in zip(m["at"][::2], m["at"][1::2]))
    kept, gone, n, done = [], 0, 0, 0
    for a, b in spans:
        if a > done or not n:
            kept.append(raw[done:a])
            n += 1
            gone += b - a
        elif b > done:
            gone += b - done
        done = max(done, b)
    kept.append(raw[done:])
    return len(raw), gone, n, b"".join(kept)
