"""Quality classifier by nearest-neighbour voting.

Texts become latent-semantic vectors: hashed n-grams of bytes and of word
recency, weighted by how rare they are and projected on the leading
singular vectors of a labelled sample. The
sample's vectors go to every executor; exact cosine products with all of
them, block by block, find each document's neighbours, whose labels vote
with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Bytes of a text that are counted together.
BLOCK = 1 << 20
#: Documents of one cosine product.
ROWS = 256


#: What recency terms of one, two and three words begin with, so that they differ from each other and from n-grams of bytes.
RECENCY = (7_000_000, 8_000_000, 9_000_000)


def recency(words: list[str]) -> np.ndarray:
    """For each word how long ago it stood last: the binary length of the distance, 0 if it is new."""
    last: dict[str, int] = {}
    out = np.zeros(len(words), np.uint32)
    for i, w in enumerate(words):
        j = last.get(w)
        if j is not None:
            out[i] = (i - j).bit_length()
        last[w] = i
    return out


def term(g: np.ndarray, factor: int, shift: int) -> np.ndarray:
    """A hash of numbered terms."""
    return ((g ^ (g >> np.uint32(shift))) * np.uint32(factor)) >> np.uint32(7)


def counts(text: str | None, dims: int) -> np.ndarray:
    """Hashed counts of a text's terms: byte bigrams and trigrams, upper case and marks kept, and recency n-grams of words.

    A word's recency says how long ago it stood last; sequences of up to
    three of them tell prose, in which most words are new or far from
    their like, from lists, refrains and words said over and over, in any
    language.
    """
    out = np.zeros(dims)
    raw = text.encode("utf-8") if text else b""
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw, np.uint8)[at : at + BLOCK + 2].astype(np.uint32)
        if len(b) < 2:
            continue
        two = (b[:-1] << 8) | b[1:]
        three = ((two[:-1] << 8) | b[2:]) + np.uint32(1 << 24)
        for g in (two, three):
            out += np.bincount(term(g, 0x9E3779B1, 11) % np.uint32(dims), minlength=dims)
    r = recency(text.split()) if text else np.zeros(0, np.uint32)
    for n, start in enumerate(RECENCY, 1):
        if len(r) >= n:
            g = np.zeros(len(r) - n + 1, np.uint32)
            for k in range(n):
                g = g * np.uint32(64) + r[k : len(r) - n + 1 + k]
            out += np.bincount(term(g + np.uint32(start), 0x85EBCA77, 15) % np.uint32(dims), minlength=dims)
    return out


@dataclass(frozen=True)
class Model:
    """Projection and labelled vectors; its size follows the sample's bound."""

    weight: np.ndarray
    basis: np.ndarray
    refs: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = np.sqrt(x).astype(np.float32) * self.weight
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ self.basis
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.refs):
            return out
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            x = np.stack([counts(t, len(self.weight)) for t in part])
            sim = self.vectors(x) @ self.refs.T
            k = min(self.k, sim.shape[1])
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(float) ** 4
            vote = (w * self.labels[near]).sum(1)
            total = w.sum(1)
            some = (total > 1e-9) & (x.sum(1) > 0)
            out[at : at + ROWS][some] = vote[some] / total[some]
        return np.clip(out, 0, 1)


def fit(rows: DataFrame, dims: int, rank: int, k: int) -> Model:
    """A model of labelled rows ``(text, label)``, whose number the caller bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [zlib.compress(counts(t, dims).astype(np.float32).tobytes(), 1) for t in b.column(0).to_pylist()]  # mostly zeros
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.binary())], names=["label", "x"])

    got = rows.select("text", "label").mapInArrow(run, "label double, x binary").toPandas()
    if not len(got):
        return Model(np.ones(dims), np.zeros((dims, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, k)
    x = np.empty((len(got), dims), np.float32)
    for i, packed in enumerate(got["x"]):
        x[i] = np.frombuffer(zlib.decompress(packed), np.float32)
    labels = got["label"].to_numpy(float)
    del got
    # in the order of the counts' bytes, then of labels
    order = sorted(range(len(x)), key=lambda i: (x[i].tobytes(), labels[i]))
    x, labels = x[order], labels[order]
    return learn(x, labels, rank, k)


def learn(x: np.ndarray, labels: np.ndarray, rank: int, k: int) -> Model:
    """A model of counted texts: inverse document frequencies, then a truncated singular value decomposition."""
    dims = x.shape[1]
    weight = (np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 0.1).astype(np.float32)
    y = np.sqrt(x)
    y *= weight
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), np.float32(1e-12))
    rng = np.random.default_rng(7)
    q = rng.standard_normal((dims, min(rank + 16, *y.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(y.T @ (y @ q))
    _, _, v = np.linalg.svd(y @ q, full_matrices=False)
    basis = (q @ v.T)[:, :rank]
    refs = y @ basis  # what the model's vectors of these texts are, without weighing them once more
    refs = (refs / np.maximum(np.linalg.norm(refs, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return Model(weight, basis, refs, labels, float(labels.mean()), k)


def prepare(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int, dims: int, rank: int, k: int
) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    own = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("double").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.where(crc_mod(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.avg("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of rows that share an id one is learnt from, so that the bound on ids is a bound on rows
    rows = own.join(F.broadcast(marks), "doc_id").where("text is not null and text <> ''")
    return fit(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")), dims, rank, k)


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held: int = 0,
    sample: int = 3000,
    dims: int = 4096,
    rank: int = 64,
    k: int = 9,
    threshold: float = 0.3,
) -> DataFrame:
    """Score the quality of every whole text; one row for each row, no shuffle of texts.

    At most ``sample`` labelled rows, chosen by a hash of the id among
    those whose crc32 modulo ``folds`` is not ``held``, are learnt from,
    of rows that share an id the one with the least text; the model's
    size follows that bound alone. Labels, language, source
    and id are no inputs of a score. Returns ``doc_id, held_out, score,
    predicted`` (1 if the score is ``threshold`` or more). Null and empty
    texts, and texts like no labelled one, get the share of label 1 among
    the labelled rows (0.5 if there are none). An id labelled twice counts
    with its mean. Repeated rows are scored each, null ids stay null, an
    empty table gives no rows, further columns are not read, whatever their
    names. A text of any length is counted whole. Of neighbours that tie
    for the last of the ``k`` places either may vote; a score at the
    threshold counts as label 1.
    """
    model = prepare(df, labels, id_col, text_col, label_col, folds, held, sample, dims, rank, k)
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held_out = (crc_mod(F.col("doc_id"), folds) == held).alias("held_out")
    return own.select("doc_id", "text", held_out).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held: int = 0,
    sample: int = 3000,
    dims: int = 4096,
    rank: int = 64,
    k: int = 9,
    threshold: float = 0.3,
) -> DataFrame:
    """The rows, with all their columns, whose text ``classify`` scores at ``threshold`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(prepare(df, labels, id_col, text_col, label_col, folds, held, sample, dims, rank, k))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at).to_pylist()) >= threshold))

    return df.mapInArrow(run, df.schema)
