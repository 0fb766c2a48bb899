"""Corpus pipeline: filter, deduplicate, decontaminate and pack the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's documents. All but the last
return the columns of ``documents``.

All stages decide by row: null and repeated ids are as good as others. A
text of any length is read whole, by one task. An empty table gives no
rows. Further columns pass through, whatever their names (packing returns
its own); only ``corpus_pipeline_row_number`` is kept for the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop, table, tune
from tessera.llm.decontam import decontaminate
from tessera.llm.lines import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good

#: Name of the row number that stages add for themselves; it is longer than any column of the tables.
ROW = "corpus_pipeline_row_number"
#: Ids of rows whose own is null begin here, where only the order of lines looks at them.
NO_ID = 1 << 62


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written, so that the numbers stay the same however often a task runs again.

    Ids may be null or repeated; what a stage decides, it decides by row.
    """
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts get the labels' mean and stay unless that is low.

    Rows are judged one by one: null or repeated ids make no difference;
    a long text is counted whole. An empty table gives no rows, further
    columns are returned as they are.
    """
    tune(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents that had text and keep none of it.

    Earlier is by document id and line number; rows without an id come
    last, in the order of the table. Null texts stay. Rows that repeat id
    and text lose the same lines and stay for the next stage to drop. A
    text of very many lines, or of one long line, is treated like others.
    An empty table gives no rows, further columns are returned as they are
    (but ``n_chars`` is counted anew where lines went).
    """
    tune(spark)
    rows = numbered(docs)
    rest = tuple(c for c in docs.columns if c != "text")
    keyed = rows.withColumn(ROW, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.col(ROW)))
    out = dedup_lines(keyed, id_col=ROW, carry=rest, named="row").where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row stays, the one of the smallest id.

    Rows without an id are grouped like others and stay only if no row of
    their group has one; of rows that tie, the first in the table stays.
    Rows without text are in no group and stay. Long texts are compared by
    all their shingles. An empty table gives no rows, further columns are
    returned as they are.
    """
    tune(spark)
    rows = numbered(docs)
    group = near_duplicates(rows, k=5, percent=80, id_col=ROW).where("n_shingles > 0")
    member = group.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    best = member.groupBy("component_id").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = member.join(best, "component_id").where(F.col("best")[ROW] != F.col(ROW)).select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a window of a benchmark item go, whatever their id; null texts stay.

    A window at any place of a long text counts. An empty table gives no
    rows, further columns are returned as they are.
    """
    tune(spark)
    rows = numbered(docs)
    gone = decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences of 2048 ids; null ids stay null, repeated rows are packed each.

    Long texts are cut into pieces of 2048 ids. An empty table gives no
    rows; further columns are not read.
    """
    tune(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The classifier and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
