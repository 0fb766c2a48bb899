"""Near-duplicate documents by SuperMinHash, banding, verification and grouping.

SuperMinHash (Ertl, 2017) gives each element a random permutation of the
signature's places; the rank at which a place comes up leads its value,
so the values of one element are correlated and the estimate has less
variance than with independent hashes. Once every place of a document
holds a value of a rank below the next one, no element can lower any
value, and the work stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop

#: Odd constants that spread bits (fixed values of the public splitmix64 finaliser, and multipliers of our own).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Elements of a batch that are ranked at once.
CHUNK = 100_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + h[i : n + i]) * _M2 + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The set of hashed ``k``-word shingles of a text: A-Z in lower case, words between ASCII white space."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(grams(h, min(k, len(h))))


def superminhash(x: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures of ``docs`` sets at once; ``doc[i]`` is the set of element ``x[i]``. Sets without elements keep the top value."""
    h = np.full(docs * m, _NONE, np.uint64)
    place = np.arange(m)
    perm = None
    for j in range(m):
        seed = mix(x + np.uint64(int(_STEP) * (2 * j + 1) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(j) << np.uint64(40)) | (seed >> np.uint64(24))
        k = j + (mix(seed ^ _STEP) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(x))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(h, doc * m + slot, value)
        open_ = (h.reshape(docs, m).max(axis=1) >> np.uint64(40)) > j
        keep = open_[doc]
        if not keep.any():
            break
        if perm is None:
            x, doc, k = x[keep], doc[keep], k[keep]
            perm = np.tile(place.astype(np.uint16), (len(x), 1))
            perm[np.arange(len(x)), k] = 0
        elif not keep.all():
            x, doc, perm = x[keep], doc[keep], perm[keep]
    return h.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * _M1 + sig[:, b * rows + r])
        out[:, b] = key
    return out


def signatures(df: DataFrame, k: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, set_a, set_b, bands`` of every row: the set's size, a 128-bit digest of the set, and its band keys."""
    own = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, n, keys = [], [], []
            texts = b.column(1)
            digests = np.zeros((len(texts), 2), np.uint64)

            def flush(sets, first):
                if not sets:
                    return
                sizes = np.array([len(s) for s in sets])
                x = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), sizes)
                keys.append(band_keys(superminhash(x, doc, len(sets), m), bands, rows))
                for i, c in enumerate((_M1, _M2)):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ c), dtype=np.uint64)])
                    ends = np.cumsum(sizes)
                    digests[first : first + len(sets), i] = total[ends] - total[ends - sizes]

            size = first = 0
            for i in range(len(texts)):
                s = shingles(texts[i].as_py(), k)
                n.append(len(s))
                sets.append(s)
                size += len(s)
                if size >= CHUNK:
                    flush(sets, first)
                    sets, size, first = [], 0, i + 1
            flush(sets, first)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, bands), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(digests[:, 0].view(np.int64)) if len(n) else pa.array([], pa.int64()),
                    pa.array(digests[:, 1].view(np.int64)) if len(n) else pa.array([], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(flat.ravel())),
                ],
                names=["id", "n", "set_a", "set_b", "bands"],
            )

    return own.mapInArrow(run, f"id {kind}, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b, linked, both`` of the pairs, on the full sets of shingles; ``both`` is the size of what they share."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, size, last, right = [], [], None, None
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if right is None or y != last:
                    last, right = y, shingles(y, k)
                left = shingles(x, k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                size.append(both)
                ok.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(size, pa.int64())], names=["a", "b", "linked", "both"])

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, linked boolean, both bigint")


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """``id, shingle`` of every text's set."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).to_pylist()]
            if sets:
                at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "shingle"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, shingle bigint")


def near_duplicates(
    df: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Documents with equal sets are first reduced to one representative (the
    smallest id). Banding buckets then give candidates in two rounds, both
    confirmed on full sets. First every member is compared with the most
    central representative that it shares a bucket with, the one with the
    fewest shingles of its own; that joins most groups by as many links as
    members. Then, in buckets that still hold several components, pairs
    across components are compared, but for those that cannot be similar:
    of n shingles u that no other candidate has cannot be shared, so with
    m = min(n1 - u1, n2 - u2) the similarity is m / (n1 + n2 - m) at most;
    if both were compared with one representative and share i1 and i2
    shingles with it, m is min(i1, i2) + min(n1 - i1 - u1, n2 - i2 - u2)
    at most. No bucket is capped, no candidate cut off, and pairs inside a joined
    group are never emitted. A pair at the bound is missed with
    probability (1 - s^rows)^bands.

    Returns ``doc_id, n_shingles, component_id, kept``, one row for each
    row. Null or blank texts have no shingles and link with nothing.
    Repeated rows are returned each and fall into one component; a null id
    is returned with a null component and ``kept`` false; rows that share
    an id but not the text are each grouped by their own text, and their
    groups join where the id is a representative. An empty table gives no
    rows; further columns are not read, whatever their names. Texts of any
    length are read whole; of documents that tie, the smallest id is kept.
    """
    sig = cut(signatures(df, k, bands, rows, id_col, text_col), "signatures")
    by = ["n", "set_a", "set_b"]
    sets = sig.where("n > 0 and id is not null").groupBy(*by).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    keys = cut(sets.select("rep", "n", F.explode("bands").alias("key")), "keys")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    shared = keys.join(cut(shared, "buckets"), "key")
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(shared.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    texts = cut(texts, "texts")
    alone = shingle_rows(texts, k).groupBy("shingle").agg(F.min("id").alias("rep"), F.max("id").alias("hi")).where("rep = hi")
    alone = cut(alone.groupBy("rep").agg(F.count("*").alias("own")), "own-shingles")
    member = shared.join(alone, "rep", "left").select("key", "rep", "n", F.coalesce("own", F.lit(0)).alias("own"))
    member = cut(member, "members")
    head = cut(member.groupBy("key").agg(F.min(F.struct("own", "rep")).alias("head"), F.min("n").alias("least")), "heads")
    pairs = member.join(head, "key").groupBy("rep").agg(F.min("head").alias("head")).where("rep <> head.rep")
    pairs = pairs.select(F.col("rep").alias("a"), F.col("head.rep").alias("b"))
    tried = cut(verify(pairs, texts, k, percent), "verified")
    groups = components(tried.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    pivot = tried.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "both")
    able = member.join(head.select("key", "least"), "key").where(100 * (F.col("n") - F.col("own")) >= percent * (F.col("least") + F.col("own")))
    placed = able.select("key", "rep", "n", "own").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.join(pivot, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = cut(placed.withColumn("rest", F.col("n") - F.col("both") - F.col("own")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    rest = placed.join(cut(mixed, "mixed"), "key").join(sets.select("rep", F.array_sort("bands").alias("bands")), "rep")
    rest = cut(rest, "rest")
    most = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own"))
    most = F.when(F.col("x.pivot") == F.col("y.pivot"), F.least(most, F.least("x.both", "y.both") + F.least("x.rest", "y.rest"))).otherwise(most)
    apart = (F.col("x.component") < F.col("y.component")) & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most))
    once = F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))  # a pair is met in the first bucket that it shares
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & once)
    across = across.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    across = cut(across.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "across")
    more = verify(across, texts, k, percent).where("linked").select("a", "b")
    links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    drop(texts, rest, across, tried, placed)
    named = sets.select(*by, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select(*by, F.coalesce("component", "rep").alias("component")), "components")
    out = sig.select("id", *by).join(named, by, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
