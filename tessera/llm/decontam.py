"""Benchmark decontamination by winnowing, with DataFrame functions only.

Training and test texts are fingerprinted alike: the hashes of all runs
of ``gram`` words, of which each window of ``window - gram + 1`` keeps the
least. Two texts that share ``window`` words share such a window and so
its least hash; hence the join of the fingerprints finds every document
that holds any window of any item. Hits are then extended: all windows of
these documents are joined with the windows of the items, and their
words compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed value of the contract: what stands between words, after A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints of the test set, and bytes of their text, up to which they are sent to every executor; beyond, both sides are shuffled.
SEND, SEND_BYTES = 200_000, 16_000_000


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def hashes(w: Column) -> Column:
    """A 64-bit hash of every word."""
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column, k: int) -> Column:
    """A hash of every run of ``k`` words, in order; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.when(F.size(h) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def winnowed(g: Column, w: int) -> Column:
    """The least hash of every ``w`` neighbours, each once; none if there are fewer."""
    low = F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
    return F.when(F.size(g) >= w, F.array_distinct(low)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(h: DataFrame, gram: int, window: int) -> DataFrame:
    """Adds ``marks`` to rows with hashed words ``h``."""
    return h.withColumn("g", grams(F.col("h"), gram)).withColumn("marks", winnowed(F.col("g"), window - gram + 1)).drop("g")


def decontaminate(
    df: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    gram: int = 5,
) -> DataFrame:
    """Find the words of documents that stand in an occurrence of an item's window.

    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. Returns ``doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated``, one row for each row.

    Null and blank texts have no words; items with null text or none are
    never hit; a null item id counts among the items as an empty string.
    Repeated rows are returned each, repeated items count once. A null
    document id stays null. Empty tables give no rows, or none hit.
    Further columns are not read, whatever their names. Texts of any length
    are read whole; of windows that tie for the least hash any one serves.
    Candidates are found by 64-bit hashes; a hit is a window whose words
    are equal. Fingerprints and windows of the items are sent to every
    executor up to ``SEND`` of each, and shuffled beyond, with equal results.
    """
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    keyed = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("digest", F.xxhash64("text"))
    items = bench.select(F.coalesce(bench[item_col].cast("string"), F.lit("")).alias("item"), words(bench[item_text]).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("h", hashes(F.col("w"))).select("item", "w", "h")
    items = cut(items.withColumn("len", F.least(F.lit(window), F.size("h"))), "items")
    lens = sorted(r["len"] for r in items.select("len").distinct().collect())
    short = [n for n in lens if n < window]

    def spots(rows: DataFrame, keep: list[str]) -> DataFrame:
        """``len, start, key, phrase`` of all windows of rows with words ``w``, hashed in ``h``, of every length that items have."""

        def windows(n: int) -> Column:
            phrase = lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " ")
            return F.transform(grams(F.col("h"), n), lambda x, i: F.struct(F.lit(n).alias("len"), i.alias("start"), x.alias("key"), phrase(i).alias("phrase")))

        every = [windows(n) for n in lens]
        none = F.array().cast("array<struct<len:int,start:int,key:bigint,phrase:string>>")
        return rows.select(*keep, F.explode(F.concat(none, *every)).alias("span")).select(*keep, "span.*")

    own = spots(items.withColumnRenamed("len", "n"), ["item", "n"]).where("len = n")
    own = cut(own.groupBy("len", "key", "phrase").agg(F.collect_set("item").alias("items")), "windows")
    marks = fingerprints(items.where(F.col("len") == window), gram, window).select(F.explode("marks").alias("mark"))
    marks = cut(marks.union(own.where(F.col("len") < window).select("key")).distinct(), "marks")

    def small(side: DataFrame) -> DataFrame:
        """Broadcast a written table of at most ``SEND`` rows and ``SEND_BYTES`` bytes of text."""
        text = [F.octet_length(c) for c in ("phrase",) if c in side.columns] + [F.expr("aggregate(items, 0L, (n, x) -> n + octet_length(x))") for c in ("items",) if c in side.columns]
        n, size = side.agg(F.count("*"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0))).first()
        return F.broadcast(side) if n <= SEND and size <= SEND_BYTES else side

    split = keyed.select("id", "digest", "doc_id", words(F.col("text")).alias("w"))
    sizes = cut(split.select("id", "digest", "doc_id", F.size("w").cast("bigint").alias("n_words")), "sizes")
    found = fingerprints(split.select("id", "digest", hashes(F.col("w")).alias("h")), gram, window)
    found = found.select("id", "digest", F.explode(F.concat("marks", *[grams(F.col("h"), n) for n in short])).alias("mark"))
    found = cut(found.join(small(marks), "mark", "left_semi").select("id", "digest").distinct(), "found")
    hit = keyed.select("id", "digest", "text").join(found, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    hit = hit.select("id", "digest", words(F.col("text")).alias("w"))
    hit = spots(hit.select("id", "digest", "w", hashes(F.col("w")).alias("h")), ["id", "digest"])
    hit = hit.join(small(own), ["len", "key", "phrase"])
    hit = hit.groupBy("id", "digest").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    end = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).cast("bigint").alias("n"),
        ),
    )
    hit = hit.select("id", "digest", end["n"].alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("names"))
    out = sizes.join(hit, ["id", "digest"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
