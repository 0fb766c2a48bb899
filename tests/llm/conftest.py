import pytest

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names clash with inner ones."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t) for i, t in rows], DOCS)
        for name in ("id", "key", "n", "w", "ord", "rep", "label", "lang", "source", "part", "rank", "bands", "item"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
