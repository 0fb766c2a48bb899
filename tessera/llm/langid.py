"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter answers for all languages at once: a place
holds one bit for each language, and the conjunction of an n-gram's
places is the set of languages that contain it. Per-language counts of
those bits, less the hits that false positives alone would give, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Bytes other than ASCII letters and the bytes of longer characters count as a space.
_CLEAN = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The 3- and 4-byte n-grams of a text in blocks, each block without repeats being merged."""
    raw = b" " + text.lower().encode("utf-8") + b" "
    for at in range(0, len(raw), BLOCK):
        b = _CLEAN[np.frombuffer(raw, np.uint8)[at : at + BLOCK + 3]].astype(np.uint32)
        if len(b) < 3:
            continue
        three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        four = (three[:-1] << 8) | b[3:] if len(b) > 3 else three[:0]
        last = at + BLOCK + 3 >= len(raw)
        if not last:
            three = three[:BLOCK]
        out = np.concatenate([three, four])
        # runs of spaces say nothing of a language
        yield out[(out & np.uint32(0xFFFF)) != np.uint32(0x2020)]


@dataclass(frozen=True)
class Filters:
    """Bit-sliced filters; ``table[place, word]`` has a bit for each language."""

    langs: list[str]
    table: np.ndarray
    false: np.ndarray
    common: int

    def masks(self, grams: np.ndarray, word: int) -> np.ndarray:
        bits = self.table.shape[0].bit_length() - 1
        out = None
        for c in _MIX:
            h = (grams ^ (grams >> np.uint32(15))) * c
            m = self.table[(h >> np.uint32(32 - bits)), word]
            out = m if out is None else out & m
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        if not self.langs:
            return "und", 0.0
        hits, n = np.zeros(len(self.langs)), 0
        for g in ngrams(text):
            n += len(g)
            for w in range(self.table.shape[1]):
                m = self.masks(g, w)
                for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    hits[i] += np.count_nonzero(m & np.uint64(1 << (i - w * 64)))
        if not n:
            return self.langs[self.common], 0.0
        real = np.maximum((hits - n * self.false) / (1 - self.false), 0)
        total = real.sum()
        if total <= 0:
            return self.langs[self.common], 0.0
        best = int(real.argmax())
        return self.langs[best], float(min(1.0, real[best] / total))


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]], bits: int, share: float) -> Filters:
    """Filters from the counted n-grams of each language.

    An n-gram enters a language's filter if its relative frequency there is
    at least ``share`` of its highest in any language.
    """
    langs = sorted(grams)
    table = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
    if not langs:
        return Filters([], table, np.zeros(0), 0)
    every = np.unique(np.concatenate([g for g, _ in grams.values()]))
    top = np.zeros(len(every))
    for l in langs:
        g, f = grams[l]
        at = np.searchsorted(every, g)
        top[at] = np.maximum(top[at], f)
    fill = np.zeros(len(langs))
    for i, l in enumerate(langs):
        g, f = grams[l]
        g = g[f >= share * top[np.searchsorted(every, g)]].astype(np.uint32)
        bit = np.uint64(1 << (i % 64))
        for c in _MIX:
            h = ((g ^ (g >> np.uint32(15))) * c) >> np.uint32(32 - bits)
            table[h, i // 64] |= bit
        fill[i] = np.count_nonzero(table[:, i // 64] & bit) / len(table)
    return Filters(langs, table, fill ** len(_MIX), 0)


def fit(train: DataFrame, per_lang: int = 20_000, least: float = 1e-5, share: float = 0.25, bits: int = 20) -> Filters:
    """Learn filters from ``train(id, text, lang)``.

    About ``per_lang`` texts of each language, chosen by a hash of the id,
    are counted. n-grams that make up less than ``least`` of a language's
    are left out, so at most ``1 / least`` of each language come to the
    driver, and the filters have ``2 ** bits`` places at every size.
    """
    train = train.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build({}, bits, share)
    cuts = F.create_map(*[x for l, n in counts.items() for x in (F.lit(l), F.lit(min(1.0, per_lang / n)))])
    chosen = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.element_at(cuts, F.col("lang")) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).extend(ngrams(text))
            for lang, parts in by.items():
                if parts:
                    g, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    from .common import cut

    grams = chosen.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, gram bigint, n bigint")
    grams = cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return build({}, bits, share)
    floors = F.create_map(*[x for l, n in totals.items() for x in (F.lit(l), F.lit(max(2.0, least * n)))])
    kept = grams.where(F.col("n") >= F.element_at(floors, F.col("lang"))).toPandas()
    found = {
        l: (g["gram"].to_numpy(np.int64)[order := np.argsort(g["gram"].to_numpy(), kind="stable")], (g["n"].to_numpy(float) / totals[l])[order])
        for l, g in kept.groupby("lang")
    }
    filters = build(found, bits, share)
    common = max(range(len(filters.langs)), key=lambda i: (counts.get(filters.langs[i], 0), -i)) if filters.langs else 0
    return Filters(filters.langs, filters.table, filters.false, common)


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, **fitting
) -> DataFrame:
    """Predict the language of every whole text; one row for each row, no shuffle of texts.

    Filters are learnt from rows whose crc32 of the id modulo ``folds`` is
    not ``held``; language, source and id are no inputs of a prediction.
    Returns ``doc_id, held_out, lang_pred, score``. ``und`` with score 0
    stands for a null text, one without a letter, and for every text when
    there was nothing to learn from; a letter text without a known n-gram
    gets the commonest language with score 0. Repeated rows are predicted
    each, null ids stay null, an empty table gives no rows, and further
    columns are not read, whatever their names. A text of any length is
    read whole, its n-grams counted as often as they stand; of languages
    that tie, the first by name is returned.
    """
    own = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), df[lang_col].alias("lang"))
    fold = crc_mod(F.col("doc_id"), folds)
    filters = fit(own.where(fold != held).select(F.col("doc_id").alias("id"), "text", "lang"), **fitting)
    shared = df.sparkSession.sparkContext.broadcast(filters)
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for b in batches:
            out = [predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return own.select("doc_id", "text", (fold == held).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
