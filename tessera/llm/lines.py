"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as sequences of words, and the edit bound is one word
(replaced, inserted or removed). Equal lines are reduced to their first
occurrence; the rest of the work is done on different lines:

* Two lines within one edit agree in their first or in their last half.
  Lines that share no half with any other have no neighbour and leave.
* The others emit the hash of every variant with one word deleted. Equal
  variants deleted at the same place join replacements; a variant equal to
  a whole line joins an insertion. In each group of equal keys all lines
  are neighbours of its earliest line, so each is joined with that one
  alone, and no pairs inside a group are emitted.
* The joined lines' edit distance is verified on their words.

A line is removed if an earlier line, in order of document id and line
number, equals it or is within the edit bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop

#: Line numbers are below this; document id and line number make one ordered number.
_SPAN = "4294967296"
#: What the second hash begins with.
SECOND = 0x5DEECE66D


def line_words(line: Column) -> Column:
    """Words of a line in lower case; none if it is blank. A single space as separator needs no pattern."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    low = F.lower(line)
    return F.array_remove(F.when(other, F.split(low, r"\s+")).otherwise(F.split(low, " ")), "")


def keys(w: Column) -> list[Column]:
    """Two independent hashes of a line's words, 128 bits that stand for the line."""
    return [F.xxhash64(w).alias("key"), F.xxhash64(F.lit(SECOND), w).alias("also")]


def blocks(w: Column, n: Column) -> Column:
    """Keys of a line's halves: as a line of its own length, and as the longer one of a pair."""

    def keys(c: Column) -> list[Column]:
        m = F.floor(c / 2).cast("int")
        return [F.xxhash64(F.lit(0), c, F.slice(w, 1, m)), F.xxhash64(F.lit(1), c, F.slice(w, n - (c - m) + 1, c - m))]

    return F.array(*keys(n), *keys(n - 1))


def variants(cand: DataFrame) -> DataFrame:
    """``ord, n, i, v`` of candidate lines ``(ord, w)``: the hash without word ``i``, and with ``i`` -1 of the whole line.

    The hash is an exclusive or over words and places, so that running
    values give all variants in time linear in the line's length.
    """
    one = cand.select("ord", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    one = one.select("ord", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    by = W.partitionBy("ord")
    upto = by.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    run = one.select(
        "ord", "n", "i", "here",
        F.bit_xor("here").over(upto).alias("head"), F.bit_xor("moved").over(upto).alias("shifted"),
    )
    ends = one.groupBy("ord").agg(F.bit_xor("here").alias("all"), F.bit_xor("moved").alias("all_moved"), F.first("n").alias("n"))
    less = run.join(ends.select("ord", "all_moved"), "ord")
    v = F.col("head").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("shifted"))
    return less.select("ord", "n", "i", v.alias("v")).union(ends.select("ord", "n", F.lit(-1).alias("i"), F.col("all").alias("v")))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word sequences are at most one replaced, inserted or removed word apart."""
    shorter, longer = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differ = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
    first = F.filter(F.sequence(F.lit(0), F.size(shorter) - 1), lambda i: F.get(shorter, i) != F.get(longer, i))
    at = F.coalesce(F.get(first, F.lit(0)), F.size(shorter))
    tail = F.slice(shorter, at + 1, F.size(shorter)) == F.slice(longer, at + 2, F.size(longer))
    return F.when(F.size(a) == F.size(b), F.size(differ) <= 1).when(F.size(longer) - F.size(shorter) == 1, tail).otherwise(False)


def near_lines(first: DataFrame, words: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``ord`` of the different lines ``(ord, halves)`` that an earlier one is within one edit of.

    ``words`` fetches ``(ord, w)`` of the few lines that share a half.
    """
    key = cut(first.select("ord", F.explode("halves").alias("key")), "halves")
    more = cut(key.groupBy("key").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a <> b").select("key"), "shared-halves")
    some = cut(key.join(more, "key", "left_semi").select("ord").distinct(), "sharing")
    drop(key, more)
    cand = cut(words(some), "candidates")
    v = cut(variants(cand), "variants")
    replaced = v.where("i >= 0").groupBy("v", "i", "n").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first <> last")
    replaced = cut(replaced.select("v", "i", "n", "first"), "replaced")
    links = v.join(replaced, ["v", "i", "n"]).where("ord <> first").select("ord", "first")
    whole = v.where("i = -1").groupBy("v", "n").agg(F.min("ord").alias("whole"))
    longer = v.where("i >= 0").select("v", (F.col("n") - 1).alias("n"), "ord")
    least = cut(longer.join(whole, ["v", "n"]).select("v", "n", "ord", "whole"), "inserted")
    links = links.union(least.where("whole < ord").select("ord", F.col("whole").alias("first")))
    links = links.union(least.groupBy("whole").agg(F.min("ord").alias("first")).where("first < whole").select(F.col("whole").alias("ord"), "first"))
    links = links.distinct()
    links = links.join(cand.select("ord", F.col("w").alias("a")), "ord").join(cand.select(F.col("ord").alias("first"), F.col("w").alias("b")), "first")
    near = cut(links.where(within_one(F.col("a"), F.col("b"))).select("ord").distinct(), "near-lines")
    drop(some, cand, v, replaced, least)
    return near


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, carry: tuple[str, ...] = (), named: str = "doc_id"
) -> DataFrame:
    """Remove lines that equal, or nearly equal, an earlier line of the corpus.

    Returns the id (as ``named``), ``n_lines, n_removed, text``, one row for each row;
    ``text`` has the kept lines in order; columns named in ``carry`` are
    returned as they are. Blank lines stay and remove
    nothing. Lines of fewer than ``min_words`` words are compared for
    equality only (in lower case, white space as one space). Ids must be
    integers; rows with a null id keep all lines and remove none. A null
    text stays null with no lines; an empty one has one blank line. Rows
    that repeat id and text count as one and are each returned; of rows
    that share an id but not the text, the line number orders them. An
    empty table gives no rows; further columns are not read, whatever
    their names. Texts and lines of any length are read whole; of lines
    that tie, the earliest stays. Equal lines are told by two independent
    64-bit hashes of their words, near ones by the words themselves.
    """
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), F.struct(F.lit(0).alias("none"), *[df[c] for c in carry]).alias("carried"))
    ord_ = (F.col("doc_id").cast("decimal(20,0)") * F.expr(f"cast({_SPAN} as decimal(11,0))") + F.col("no")).cast("decimal(38,0)")
    at = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    at = at.where(F.col("line").rlike(r"\S")).select("doc_id", "no", line_words(F.col("line")).alias("w"))
    at = at.select("doc_id", "no", *keys(F.col("w")), F.when(F.size("w") >= min_words, blocks(F.col("w"), F.size("w"))).alias("b"))
    occurrences = cut(at.select("doc_id", "no", "key", "also", ord_.alias("ord"), *[F.col("b")[i].alias(f"b{i}") for i in range(4)]), "occurrences")
    first = occurrences.groupBy("key", "also").agg(F.min("ord").alias("first"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(4)])
    first = whole_first = cut(first, "first-lines")
    occurrences = occurrences.select("doc_id", "no", "key", "also", "ord")

    def words(some: DataFrame) -> DataFrame:
        span = F.expr(f"cast({_SPAN} as decimal(11,0))")
        no = F.pmod(F.col("ord"), span)
        asked = some.select(((F.col("ord") - no) / span).cast("decimal(20,0)").cast("bigint").alias("doc_id"), no.cast("int").alias("no"))
        asked = asked.groupBy("doc_id").agg(F.collect_set("no").alias("asked"))
        lines = docs.select("doc_id", "text").join(asked.hint("shuffle_hash"), "doc_id")  # at any size alike; texts are not sorted
        lines = lines.select("doc_id", F.split("text", "\n").alias("lines"), "asked").select("doc_id", "lines", F.explode("asked").alias("no"))
        got = lines.select("doc_id", "no", line_words(F.get("lines", F.col("no"))).alias("w")).where(F.size("w") >= min_words)
        got = got.select(ord_.alias("ord"), "w", *keys(F.col("w")))
        own = first.select(F.col("first").alias("ord"), "key", "also")
        return got.join(own, ["ord", "key", "also"], "left_semi").dropDuplicates(["ord"]).select("ord", "w")

    long = first.where("b0 is not null").select(F.col("first").alias("ord"), F.array("b0", "b1", "b2", "b3").alias("halves"))
    near = near_lines(long, words)
    first = first.select("key", "also", "first")
    state = first.join(near.select(F.col("ord").alias("first"), F.lit(True).alias("near")), "first", "left")
    state = cut(state, "line-state")
    drop(whole_first, near)
    gone = occurrences.join(state, ["key", "also"]).where("near or ord > first")
    gone = gone.groupBy("doc_id").agg(F.collect_set("no").alias("gone"))
    none = F.array().cast("array<int>")
    out = docs.join(gone.hint("shuffle_hash"), "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    out = out.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none)))
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint")
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).cast("bigint")
    return out.select(F.col("doc_id").alias(named), n.alias("n_lines"), (n - left).alias("n_removed"), F.when(F.col("text").isNotNull(), text).alias("text"), *[F.col("carried")[c].alias(c) for c in carry])
