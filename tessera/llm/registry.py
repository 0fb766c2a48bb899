"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "query"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query; it runs with small Arrow batches."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 words that occur more than once."""
    from .substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals."""
    from .lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles agree by 85 % or more."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=20, rows=4)


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.98 or more."""
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that stand in windows of benchmark items."""
    from .decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that occur more than once."""
    from .suffixes import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words with a period in every document, every tenth of which has one written into it."""
    from .periodic import periodic_runs, planted

    out = periodic_runs(table(spark, sf_dir, "documents"), words=24, times=3, rewrite=planted)
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256")
    )


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, and the words that they may be variants of."""
    from .variants import spelling_variants

    out = spelling_variants(table(spark, sf_dir, "documents"), least=5, many=3, ratio=2, mistakes=True)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
