"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are long, so it is well under Spark's default.
BATCH_ROWS = 1000
#: A key with more than this part of all rows is heavy.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few texts at once; shuffle files go when their job is over.

    What a later job reads is in the shared folder by then (``cut``). The
    settings are those of the session and stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset,
    a local folder stands in if all runs on this machine; elsewhere
    executors could not read each other's files, and the job is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        named = os.path.join(tempfile.gettempdir(), "tessera-shared")
    return named.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends here: a lost executor costs no recomputation of what
    stands before, and what follows may read the rows more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no plan reads any more: what was made of them is written by now."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(conf).delete(path, True)


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Join ``left`` with a written table of unique keys that tells in ``count`` how many rows of ``left`` each key has.

    Keys with more than a thousandth of all those rows are broadcast, and
    their rows are not shuffled; there are fewer than 1000 such keys.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY > total
    told, rest = right.where(heavy).drop(count), right.where(~heavy).drop(count)
    light = left.join(F.broadcast(told.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(told), keys).unionByName(light.join(rest, keys))


def crc_mod(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(modulus), F.lit(0)).cast("int")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(src, dst)`` as ``(node, component)``.

    Alternating large-star and small-star steps; each step is a grouped
    minimum (combined on the map side) and a join that AQE may split, so
    a hub with very many links is never gathered in one task. The state
    goes to the shared folder after every round. Nodes without links are
    not returned. ``component`` is the smallest node reached.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = cut(e.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        last = e
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
