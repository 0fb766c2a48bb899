"""Best-fit packing of documents into sequences of bounded length.

The packing is found on the histogram of piece lengths alone, whose size
is bounded by the sequence length and not by the data. A configuration
linear program (each configuration is a multiset of lengths that fits one
sequence) is solved by multiplicative weights, whose pricing step is a
knapsack dynamic program, and rounded; the program of what rounding
leaves is solved and rounded in turn. Best-fit packs only what the
program makes no more progress on. Pieces then find their places by their
rank among the pieces of equal length.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .tokens import PATTERN, byte_symbols


class Encoder:
    """Ids of the library ``tokenizers`` for a byte-level vocabulary file.

    Its ranks are run by the faster ``tiktoken``, whose ids are the same
    (tests hold both together); a text that this one refuses, such as one
    with a million spaces in a row, goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.library = path, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation()
                self.library.no_padding()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)


def pieces(df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise each whole text, add id 0, and cut what is longer than ``size``.

    The first piece of a cut document takes the remainder, so that every
    other piece fills a sequence of its own. Returns ``doc_id, piece,
    start, length, ids_crc32``. A null text counts as empty: one piece of
    one id.
    """
    own = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for b in batches:
            row, no, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.zeros(1, "<u4")
                if text:
                    ids = np.append(encode(text), 0).astype("<u4")
                n, s = len(ids), 0
                for k in range(-(-n // size)):
                    e = s + size if k or n % size == 0 else s + n % size
                    row.append(i)
                    no.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
                    s = e
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(lengths: np.ndarray, value: np.ndarray, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best value of every capacity, the item taken last (-1: none, -2: as one less), and which items have a copy left there.

    An item is taken at most as often as there are pieces of its length;
    along the one best way to each capacity, which makes every way a
    configuration that the pieces allow.
    """
    kinds = len(lengths)
    scarce = np.flatnonzero(counts < size // lengths)
    at_scarce = np.full(kinds, -1)
    at_scarce[scarce] = np.arange(len(scarce))
    fewer = np.searchsorted(scarce, np.arange(kinds + 1))
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    used = np.zeros((size + 1, len(scarce)), np.int16)
    for c in range(int(lengths[0]), size + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        before = c - lengths[:k]
        got = value[:k] + best[before]
        if m := fewer[k]:
            s = scarce[:m]
            got[s[used[before[s], at_scarce[s]] >= counts[s]]] = -1
        i = int(got.argmax())
        if got[i] > best[c - 1]:
            best[c], last[c], used[c] = got[i], i, used[before[i]]
            if at_scarce[i] >= 0:
                used[c, at_scarce[i]] += 1
        else:
            best[c], last[c], used[c] = best[c - 1], -2, used[c - 1]
    free = np.ones(kinds, bool)
    free[scarce] = used[size - lengths[scarce], np.arange(len(scarce))] < counts[scarce]
    return best, last, free


def way(last: np.ndarray, lengths: np.ndarray, c: int) -> list[int]:
    """The items of the best way to a capacity."""
    out = []
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            out.append(int(last[c]))
            c -= int(lengths[last[c]])
    return out


def program(lengths: np.ndarray, counts: np.ndarray, size: int, steps: int, eta: float) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """Solve the configuration program by multiplicative weights: how often each configuration is used, the program's value, prices.

    Lengths have prices, at first in proportion to the length. In each step
    one dynamic program gives, for every length, the best configuration
    that holds it; those within ``eta`` of the best are used as often as
    the counts allow when all of them share, and the price of a length
    falls by what was given of it. The value is that of the best prices,
    by duality; the uses of all steps are normalised to it.
    """
    price = lengths / size
    value, dual = 0.0, price
    x: Counter[tuple[int, ...]] = Counter()
    for _ in range(steps):
        best, last, free = knapsack(lengths, price, size, counts)
        reach = best[size - lengths] + np.where(free, price, 0)
        top = max(float(reach.max()), float(best[size]))
        if (bound := float(counts @ price) / top) > value:
            value, dual = bound, price / top
        found: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        for i in np.flatnonzero(reach >= (1 - eta) * top):
            config = tuple(sorted([*([int(i)] if free[i] else ()), *way(last, lengths, size - int(lengths[i]))]))
            if config not in found:
                found[config] = np.unique(config, return_counts=True)
        load = np.zeros(len(lengths))
        for k, a in found.values():
            load[k] += a
        given = np.zeros(len(lengths))
        for config, (k, a) in found.items():
            much = float((counts[k] / load[k]).min())
            x[config] += much
            given[k] += much * a
        price = np.maximum(price * np.exp(-eta * given / counts), 1e-9)
    scale = value / sum(x.values())
    return {c: n * scale for c, n in x.items()}, value, dual


def least_sequences(histogram: dict[int, int], size: int, steps: int = 10, eta: float = 0.5) -> int:
    """A proven lower bound: the dual of the program, priced without regard to the counts."""
    lengths = np.array(sorted(l for l, n in histogram.items() if n), dtype=int)
    if not len(lengths):
        return 0
    counts = np.array([histogram[int(l)] for l in lengths])
    bound = 0.0
    for price in (lengths / size, program(lengths, counts, size, steps, eta)[2]):
        best, _, _ = knapsack(lengths, price, size, np.full(len(lengths), size))
        bound = max(bound, float(counts @ price) / float(best[size]))
    return int(np.ceil(bound - 1e-6))


def best_fit(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: equal sequences are filled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    mask = 0
    for i in range(len(lengths) - 1, -1, -1):
        n, l = int(counts[i]), int(lengths[i])
        while n:
            fit = mask >> l
            if fit:
                room = l + (fit & -fit).bit_length() - 1
                config, m = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            else:
                per = size // l
                room, config, m = size, (), max(1, n // per)
                take = min(per, n)
                open_.setdefault(size - l * take, []).append(((i,) * take, m if take == per else 1))
                mask |= 1 << (size - l * take)
                n -= take * (m if take == per else 1)
                continue
            used = min(n, m)
            if used < m:
                open_.setdefault(room, []).append((config, m - used))
                mask |= 1 << room
            open_.setdefault(room - l, []).append(((*config, i), used))
            mask |= 1 << (room - l)
            n -= used
    return [x for xs in open_.values() for x in xs]


def solve(
    histogram: dict[int, int], size: int, steps: int = 10, eta: float = 0.5, share: float = 0.5, tight: float = 0.01
) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Configurations of lengths and how often each is used, which hold every piece once; and how many the program gave.

    Each phase solves the program of the pieces that are left and rounds
    ``share`` of its solution: down, and then up by one, the most used
    first, until the share is reached. Only configurations whose value is
    within ``tight`` of the best under the program's own prices are used.
    Where a phase gives less than a hundredth of the program's value,
    best-fit packs the rest.
    """
    out: Counter[tuple[int, ...]] = Counter()
    left = {l: n for l, n in histogram.items() if n}
    while left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(l)] for l in lengths])
        rest = counts.copy()
        x, value, dual = program(lengths, counts, size, steps, eta)
        worth = {c: float(dual[list(c)].sum()) for c in x}
        floor = (1 - tight) * max(worth.values())
        order = [(c, *np.unique(c, return_counts=True)) for c in sorted(x, key=lambda c: (-x[c], -worth[c], c)) if worth[c] >= floor]
        goal, done = max(1.0, value * share), 0
        for up in (0, 1):
            for config, k, a in order:
                if done >= goal:
                    break
                times = min(int((rest[k] // a).min()), up or int(x[config] * share))
                if times:
                    out[tuple(int(lengths[i]) for i in config)] += times
                    rest[k] -= a * times
                    done += times
        left = {int(l): int(n) for l, n in zip(lengths, rest) if n}
        if 100 * done < value:
            break
    given = sum(out.values())
    lengths = np.array(sorted(left), dtype=int)
    for config, times in best_fit(lengths, np.array([left[int(l)] for l in lengths], dtype=int), size):
        if config:
            out[tuple(int(lengths[k]) for k in config)] += times
    return sorted(out.items()), given


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each length go: runs of ranks map to runs of sequences. Ordered by length and rank."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


#: Pieces of one length that one task ranks.
BUCKET = 100_000
#: Ranks of one length are below this; length and rank together are one sort key.
SPAN = 1 << 48


def slots(configs: list[tuple[tuple[int, ...], int]]) -> Slots:
    """Number the sequences and lay out each configuration without gaps."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for config, times in configs:
        offset = 0
        for l in config:
            rows.append((l * SPAN + rank[l], sequence, offset))
            rank[l] += times
            offset += l
        sequence += times
    rows.sort()
    a = np.array(rows or [(0, 0, 0)], dtype=np.int64)
    return Slots(a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy())


def pack(df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """Pack whole documents into as few sequences of ``size`` ids as it can.

    Pieces are made once and kept in the shared folder. The histogram that
    comes to the driver has ``size`` rows at most; the table of places,
    which goes to the executors, follows the number of configurations,
    not the rows. Ranks among pieces of one length are counted within
    ``buckets`` hash buckets or more, as many as ``BUCKET`` pieces each
    make, and offset by the sums of the buckets before, so a length that a
    third of all pieces share is dealt over all tasks. Buckets hash a
    number that each piece is given when it is written; equal rows are
    dealt like others.

    Null texts are empty documents (one piece of id 0), repeated rows are
    packed each, null ids stay null, an empty table gives no rows, further
    columns are not read, whatever their names. A text of any length is
    tokenised whole and cut into pieces. Pieces that tie in length are told
    apart by the number that they were given.
    """
    p = cut(pieces(df, path, size, id_col, text_col).withColumn("deal", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = p.sparkSession.sparkContext.broadcast(slots(solve(histogram, size)[0]))
    buckets = max(buckets, -(-max(histogram.values(), default=0) // BUCKET))
    p = p.withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(buckets)).cast("int"))
    by = p.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = W.partitionBy("length", "part").orderBy("deal")
    ranked = p.withColumn("rank", F.row_number().over(own)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = places.value
        for b in batches:
            key = b.column(3).to_numpy() * SPAN + b.column(5).to_numpy()
            at = np.searchsorted(t.key, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(t.sequence[at] + key - t.key[at]), pa.array(t.offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = p.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
