"""Substring dedup by repeated-phrase automata.

Confirming what recurs: a window of ``window`` words is anchored at the
least hash of the phrases of ``PHRASE`` words that it holds; neighbouring
windows with one anchor form a run. Equal windows have equal anchors, so

* anchors that occur once rule out their runs;
* equal runs that occur twice recur as a whole;
* only runs that differ around a recurring anchor have their windows
  compared, each different run once, whatever its number of copies.

Each confirmed passage (a whole run, or the stretch of a run whose windows
all recur) is told once, by one document, as text. The passages are the
patterns. They are dealt to the shards of documents that their runs were
seen in; each shard compiles its patterns into one Aho-Corasick automaton
and streams all its documents through it. The matches, which compare
words and no hashes, are all that decides which words go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, cut, drop
from .minhash import mix, word_hashes

#: Words of an anchor phrase.
PHRASE = 8
#: Bytes of text that a shard is meant to hold.
SHARD_BYTES = 3_000_000
#: Copies of a row that are made by one task at a time.
PORTION = 10_000
#: Symbols of one place of a word's code.
BASE = 256
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SALT = np.uint64(0xA0761D6478BD642F)


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8").split() if text else []


@functools.lru_cache(maxsize=4)
def powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2 ** bits`` powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """Hashes of ranges of a hashed word sequence, modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int):
        power, self.inverse = powers(base, max(18, len(h).bit_length()))
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Runs:
    """The runs of some documents: anchor and its place, first and last window, and a digest of the words that the run covers.

    Places count through the words of all these documents.
    """

    def __init__(self, docs: list[list[bytes]], window: int):
        self.window, self.words = window, list(chain.from_iterable(docs))
        size = np.array([len(d) for d in docs], np.int64)
        n = len(self.words)
        self.h = word_hashes(self.words)
        self.roll = Rolling(self.h, _B1)
        start = np.flatnonzero(np.arange(n) + window <= np.repeat(np.cumsum(size), size))
        if not len(start):
            self.first = self.last = self.doc = start
            self.anchor = self.digest = np.zeros(0, np.uint64)
            return
        k = min(PHRASE, window)
        g = self.roll.ranges(np.arange(n - k + 1), np.arange(k, n + 1))
        at = np.lib.stride_tricks.sliding_window_view(g, window - k + 1).argmin(axis=1)[start] + start
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.first, self.last = start[begin], start[np.concatenate([begin[1:], [len(start)]]) - 1]
        self.doc = np.repeat(np.arange(len(size)), size)[self.first]
        at = at[begin]
        self.anchor = g[at]
        shape = ((self.last - self.first) << 20 | (at - self.first)).astype(np.uint64)
        self.digest = mix(self.roll.ranges(self.first, self.last + window) ^ mix(shape))

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the windows that start at the given places."""
        return self.roll.ranges(start, start + self.window), Rolling(mix(self.h ^ _SALT), _B2).ranges(start, start + self.window)


def chunks(texts: list[str | None], words: int = 200_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Split texts, a number of words at a time, with the place of the first text."""
    first, out, n = 0, [], 0
    for i, t in enumerate(texts):
        out.append(split(t))
        n += len(out[-1])
        if n >= words:
            yield first, out
            first, out, n = i + 1, [], 0
    if out:
        yield first, out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def find_runs(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, seg, shard, n``: how often each run occurs in each shard, counted within batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = b.column(1).to_numpy()
            for at, docs_ in chunks(b.column(0).to_pylist()):
                r = Runs(docs_, window)
                yield counted(r.anchor, r.digest, shards[at + r.doc])

    def counted(anchor: np.ndarray, seg: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((seg, anchor, shard))
        anchor, seg, shard = anchor[order], seg[order], shard[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1]) | (shard[1:] != shard[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        return pa.RecordBatch.from_arrays(
            [signed(anchor[first]), signed(seg[first]), pa.array(shard[first], pa.int32()), pa.array(n.astype(np.int64))], names=["anchor", "seg", "shard", "n"]
        )

    return docs.select("text", "shard").mapInArrow(run, "anchor bigint, seg bigint, shard int, n bigint")


class Phrases:
    """The automaton of a shard's passages. Words are coded by symbols of fixed width, so that matches are whole words."""

    def __init__(self, passages: list[str]):
        split_ = [p.encode("utf-8").split(b" ") for p in passages]
        kinds = dict.fromkeys(w for p in split_ for w in p)
        self.width = 1
        while BASE**self.width < len(kinds):
            self.width += 1
        self.code = {w: "".join(chr(256 + BASE * k + i // BASE**k % BASE) for k in range(self.width)) for i, w in enumerate(kinds)}
        self.none = "\0" * self.width
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in split_:
            self.automaton.add_word("".join(map(self.code.__getitem__, p)))
        self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words stand in an occurrence of a passage."""
        step = np.zeros(len(words) + 1, np.int64)
        if len(self.automaton):
            get, none = self.code.get, self.none
            found = list(self.automaton.iter("".join([get(w, none) for w in words])))
            if found:
                at = np.array(found, np.int64)
                end, size = (at[:, 0] + 1) // self.width, at[:, 1] // self.width
                np.add.at(step, end - size, 1)
                np.add.at(step, end, -1)
        return np.cumsum(step)[:-1] > 0


def without_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows, and ``(doc_id, text, copies)`` of those that are told by two in place of many, if there are any.

    Rows that are equal in id and text and more than a thousandth of all
    are told by two of them: one for itself and one for the others, so that
    all their windows still recur. There are fewer than 1000 such rows.
    """
    key = (F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))
    n = docs.select(*key).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    heavy = cut(n.where((F.col("n") * HEAVY > docs.count()) & (F.col("n") > 2)), "copied")
    if heavy.isEmpty():
        return docs, None
    told = docs.select("*", *key).join(F.broadcast(heavy), ["k1", "k2"], "left")
    pair = told.where("n is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    pair = pair.select("row.*", F.explode(F.array(F.lit(1).cast("bigint"), F.col("n") - 1)).alias("copies"))
    return told.where("n is null").select("doc_id", "text"), cut(pair, "pairs")


def with_copies(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says; copies are made in portions, which are dealt to all tasks."""
    far = (F.col("copies") - 1, F.lit(PORTION).cast("bigint"))
    many = rows.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("bigint"), *far))).repartition("doc_id", "portion")
    here = F.least(F.lit(PORTION), F.col("copies") - F.col("portion")).cast("int")
    return many.withColumn("copy", F.explode(F.array_repeat(F.lit(0), here))).drop("copies", "portion", "copy")


def stretches(words: Column, at: Column, window: int) -> Column:
    """The passages of a run's words that the windows starting ``at`` cover, one for each row of neighbouring starts."""
    firsts = F.filter(at, lambda p: ~F.array_contains(at, p - 1))
    lasts = F.filter(at, lambda p: ~F.array_contains(at, p + 1))
    both = F.arrays_zip(F.sort_array(firsts).alias("a"), F.sort_array(lasts).alias("b"))
    return F.transform(both, lambda s: F.array_join(F.slice(words, s["a"] + 1, s["b"] - s["a"] + window), " "))


def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts anywhere else in the corpus.

    Windows are judged on the input. Returns ``doc_id, n_words, n_removed,
    text``, one row for each row; ``text`` joins the kept words by one
    space. A null text has no words and an empty result; documents shorter
    than a window keep all words; a text of any length is read whole, by
    one task; repeated rows repeat each other's windows and lose them all;
    ties do not arise; null ids stay null; an empty table gives no rows;
    further columns are not read, whatever their names. What recurs is
    confirmed by 128 bits of a run (anchor and digest) or of a window, what
    is removed is compared word by word. Of rows that are equal in id and
    text, if they are more than a thousandth of all, two stand for the rest
    (``without_copies``), so that no shard is told by how often a row is
    repeated; fewer share a shard.
    """
    spark = df.sparkSession
    docs, pairs = without_copies(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")))
    kept = "doc_id", "text", F.lit(None).cast("bigint").alias("copies")
    docs = docs.select(*kept) if pairs is None else docs.select(*kept).unionByName(pairs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    runs = cut(find_runs(docs, window), "runs")
    anchors = runs.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    anchors = cut(anchors.where("total > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    again = cut(runs.join(anchors, "anchor"), "recurring")
    drop(runs, anchors)
    tell = again.groupBy("anchor", "seg", "mixed").agg(F.sum("n").alias("weight"), F.min("shard").alias("shard"))

    def confirm(left: pa.Table, right: pa.Table) -> pa.Table:
        """The passages of the runs that a shard has to tell, and the windows of those that differ around one anchor."""
        asked = zip(right["anchor"].to_pylist(), right["seg"].to_pylist(), right["weight"].to_pylist(), right["mixed"].to_pylist())
        todo = {(a, s): (w, m) for a, s, w, m in asked}
        known = np.unique(right["anchor"].to_numpy())
        tables = [told_rows([], [], [], [], [], [], [])]
        for _, docs_ in chunks(left["text"].to_pylist()) if todo else ():
            r = Runs(docs_, window)
            hit = np.flatnonzero(np.isin(r.anchor.view(np.int64), known))
            own, weight, mixed = [], [], []
            for k, key in zip(hit.tolist(), zip(r.anchor[hit].view(np.int64).tolist(), r.digest[hit].view(np.int64).tolist())):
                if key in todo:
                    w, m = todo.pop(key)
                    own.append(k)
                    weight.append(w)
                    mixed.append(m)
            if not own:
                continue
            k, weight, mixed = np.array(own), np.array(weight), np.array(mixed)
            anchor, seg = r.anchor[k].view(np.int64), r.digest[k].view(np.int64)
            passage = [b" ".join(r.words[i : j + window]).decode() for i, j in zip(r.first[k].tolist(), r.last[k].tolist())]
            none = pa.nulls(len(k), pa.int64())
            tables.append(told_rows(anchor, seg, weight > 1, passage, none.cast(pa.int32()), none, none, none))
            size = (r.last - r.first)[k] + 1
            size = np.where(mixed, size, 0)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, b = r.windows(np.repeat(r.first[k], size) + at)
            rest = [np.repeat(x, size) for x in (anchor, seg, weight > 1, weight)]
            tables.append(told_rows(*rest[:3], pa.nulls(len(at), pa.string()), at, a.view(np.int64), b.view(np.int64), rest[3]))
        return pa.concat_tables(tables)

    def told_rows(anchor, seg, whole, passage, at, a, b, n=()) -> pa.Table:
        kinds = zip(("anchor", "seg", "whole", "passage", "at", "a", "b", "n"), (anchor, seg, whole, passage, at, a, b, n))
        types = {"whole": pa.bool_(), "passage": pa.string(), "at": pa.int32()}
        return pa.table({name: pa.array(x, types.get(name, pa.int64())) for name, x in kinds})

    told = docs.select("shard", "text").groupBy("shard").cogroup(tell.groupBy("shard"))
    told = told.applyInArrow(confirm, "anchor bigint, seg bigint, whole boolean, passage string, at int, a bigint, b bigint, n bigint")
    told = cut(told, "told")
    windows = told.where("passage is null")
    twice = windows.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b")
    marked = windows.where("not whole").join(twice, ["a", "b"]).groupBy("anchor", "seg").agg(F.collect_set("at").alias("at"))
    passages = told.where("passage is not null").select("anchor", "seg", "whole", "passage")
    partly = passages.where("not whole").join(marked, ["anchor", "seg"])
    partly = partly.select("anchor", "seg", F.explode(stretches(F.split("passage", " "), F.col("at"), window)).alias("passage"))
    patterns = cut(passages.where("whole").select("anchor", "seg", "passage").union(partly), "passages")
    drop(told)
    routed = again.select("anchor", "seg", "shard").distinct().join(patterns, ["anchor", "seg"]).select("shard", "passage")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        """Stream a shard's documents through the automaton of its passages."""
        phrases = Phrases(right["passage"].unique().to_pylist())
        n_words, n_removed, out = [], [], []
        for text in left["text"].to_pylist():
            words = split(text)
            n_words.append(len(words))
            if len(words) >= window:
                gone = phrases.covered(words)
                if gone.any():
                    words = [w for w, x in zip(words, gone.tolist()) if not x]
            n_removed.append(n_words[-1] - len(words))
            out.append(b" ".join(words).decode())
        return pa.table({"copies": left["copies"], "doc_id": left["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(out, pa.string())})

    def located(part: DataFrame) -> DataFrame:
        own = part.select("shard", "copies", "doc_id", "text").groupBy("shard").cogroup(routed.groupBy("shard"))
        return own.applyInArrow(locate, f"copies bigint, doc_id {kind}, n_words bigint, n_removed bigint, text string")

    if pairs is None:
        return located(docs).drop("copies")
    return located(docs.where("copies is null")).drop("copies").unionByName(with_copies(located(docs.where("copies is not null"))))
