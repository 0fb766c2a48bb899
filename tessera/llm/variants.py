"""Grouping of spelling variants by deletion keys.

Two words are near if one character is inserted, deleted or replaced. A
word's deletion keys are hashes of what is left without each of its
characters. They follow from the prefix and suffix sums of a polynomial
over all words of a batch at once: what stands after the deleted character
moves by one power. Words that differ by a replacement at place ``i``
share the key of ``i``; a word and a longer one share the word's own key.
Keys are partitioned by their leading bits and sorted; words of equal keys
are compared as strings. Groups are never expanded into pairs: of each
group its size and its two best words tell all that its members need.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .minhash import mix

#: Letters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Keys that a partition is meant to hold, and words whose keys are made at once.
PART_KEYS, WORDS = 200_000, 20_000
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(run: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def misspelt(key: object, run: str) -> str:
    """The run without one of its characters if the checksum of ``key:run`` is divisible by 97; a null key counts as empty text."""
    h = zlib.crc32(run.encode("utf-8"), zlib.crc32(f"{'' if key is None else key}:".encode()))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(df: DataFrame, least: int, many: int, mistakes: bool, id_col: str, text_col: str) -> DataFrame:
    """``word, n`` of the words of ``least`` characters or more that occur ``many`` times or more."""
    # characters are only ever taken away, so that shorter runs are no matter
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if mistakes:
                    own: Counter[str] = Counter()
                    for x, n in Counter(pattern.findall(text)).items() if text else ():
                        own[lower(x)] += n
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for w, n in own.items():
                        if not zlib.crc32(w.encode("utf-8"), start) % 97:
                            w = misspelt(key, w)
                            if len(w) < least:
                                continue
                        held[w] += n
                elif text:
                    for x, n in Counter(pattern.findall(text)).items():
                        held[lower(x)] += n
            if len(held) > HELD:
                yield told(held)
                held = Counter()
        yield told(held)

    def told(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, "word string, n bigint")
    return docs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= many)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, deleted place (-1: none) and key, of every word as it is and without each of its characters."""
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(point)) - (end - size)[word]
    power = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.zeros(len(point) + 1, np.uint64)
    np.cumsum(mix(point + np.uint64(1)) * power[at], dtype=np.uint64, out=sums[1:])
    here = np.arange(len(point))
    before, whole = sums[here] - sums[(end - size)[word]], sums[end] - sums[end - size]
    after = (sums[end[word]] - sums[here + 1]) * _BACK
    key = np.concatenate([mix(whole + size.astype(np.uint64)), mix(before + after + (size[word] - 1).astype(np.uint64))])
    return np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), at]), key


def spread_keys(words: DataFrame, bits: int) -> DataFrame:
    """``part, key, at, word, n``: the deletion keys of all words; ``part`` is a key's leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, WORDS):
                part = b.slice(start, WORDS)
                word, at, key = deletion_keys(part.column(0).to_pylist())
                lead = (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
                columns = [pa.array(lead), pa.array(key.view(np.int64)), pa.array(at.astype(np.int32)), *(part.column(k).take(pa.array(word)) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "at", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "part int, key bigint, at int, word string, n bigint")


def rest(word: str, at: int) -> str:
    return word if at < 0 else word[:at] + word[at + 1 :]


def best_two(members: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two members of the largest counts; ties: in code-point order."""
    return sorted(members, key=lambda m: (-m[1], m[0]))[:2]


def near_words(entries: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Of words ``(word, n, deleted place)`` that leave one string: each word, how many of the others are near, and the best of these."""
    places: dict[int, list[tuple[str, int]]] = {}
    own, longer = None, []
    for w, n, at in entries:
        if at < 0:
            own = (w, n)
            continue
        places.setdefault(at, []).append((w, n))
        # of equal characters in a row the first stands for all: each longer word comes once
        if at == 0 or w[at - 1] != w[at]:
            longer.append((w, n))
    for members in places.values():
        if len(members) > 1:
            top = best_two(members)
            for w, _ in members:
                yield (w, len(members) - 1, *top[w == top[0][0]])
    if own and longer:
        yield (own[0], len(longer), *best_two(longer)[0])
        for w, _ in longer:
            yield (w, 1, *own)


def match(t: pa.Table) -> pa.Table:
    """Sort a partition's keys; words of equal keys that leave equal strings are near."""
    key = t["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    told = key[order]
    same = told[1:] == told[:-1]
    pick = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    some = t.take(pa.array(pick))
    groups: dict[tuple[int, str], list[tuple[str, int, int]]] = {}
    for k, w, n, at in zip(some["key"].to_pylist(), some["word"].to_pylist(), some["n"].to_pylist(), some["at"].to_pylist()):
        groups.setdefault((k, rest(w, at)), []).append((w, n, at))
    out = [x for g in groups.values() if len(g) > 1 for x in near_words(g)]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["word", "n_near", "other", "other_n"])


def spelling_variants(
    df: DataFrame, least: int = 5, many: int = 3, ratio: int = 2, mistakes: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Words of all texts with the more frequent word that each may be a variant of.

    Words are maximal runs of Latin letters (up to U+00FF), A-Z in lower
    case, of ``least`` characters or more that occur ``many`` times or
    more; with ``mistakes`` some occurrences lose a character first
    (``misspelt``). A word's form is its near word of the largest count
    (ties: smallest in code-point order) if that is ``ratio`` times its own
    or more; its root is the last form that following forms leads to.
    Returns ``word, n, n_near, form, form_n, root``, one row for each word;
    form and form_n are null without a form. Null and empty texts have no
    words; a text of any length is read whole, by one task; repeated rows
    count each; null ids are as good as others; an empty table gives no
    rows; further columns are not read, whatever their names. A group of
    words that share a key has at most as many members for each place as
    there are letters.
    """
    if ratio < 2:
        raise ValueError("counts have to grow along forms: a ratio of 2 or more")
    words = cut(count_words(df, least, many, mistakes, id_col, text_col), "words")
    keys = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    bits = max(0, (keys // PART_KEYS).bit_length())
    found = spread_keys(words, bits).groupBy("part").applyInArrow(match, "word string, n_near bigint, other string, other_n bigint")
    order = F.struct((-F.col("other_n")).alias("less"), "other")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    all_ = words.join(found, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    all_ = all_.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    all_ = cut(all_, "near")
    drop(words)
    roots = follow(all_.where("form is not null").select("word", F.col("form").alias("root")))
    return all_.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def follow(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Where the links ``word -> root``, which never lead back, end: each round doubles the way."""
    links = cut(links, "links")
    for _ in range(rounds):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links, last = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links"), links
        drop(last)
        if links.where("moved").isEmpty():
            return links.drop("moved")
    raise RuntimeError("follow: links lead in a circle")
