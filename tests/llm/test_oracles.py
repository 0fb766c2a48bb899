import duckdb
import pytest

from tessera.llm.registry import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    at = c.execute(ORACLES[name])
    names = [d[0] for d in at.description]
    expected = sorted(at.fetchall(), key=str)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES[name](spark, SF).collect()), key=str) == expected


def test_vector_sql_knows_links(spark):
    """The driver's small tables hold no links, so that SQL and operator are also held together on a table that does."""
    import numpy as np

    from tessera.llm.vectors import near_vectors

    r = np.random.default_rng(8)
    base = r.standard_normal((40, 12))
    vecs = [b + 0.08 * r.standard_normal(12) for b in base for _ in range(3)] + [np.zeros(12)]
    rows = [(i, [float(np.float32(x)) for x in v], int(r.integers(0, 2))) for i, v in enumerate(vecs)] + [(500, None, 0), (501, [None] * 12, 0), (502, [1.0] * 12, None)]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    expected = sorted(c.execute(ORACLES["op8_embedding_near_dedup"]).fetchall())
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert sorted(tuple(x) for x in got.collect()) == expected and sum(x[1] for x in expected) > 50
