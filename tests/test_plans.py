"""Every registered query against its SQL in DuckDB, on the driver's smallest tables."""

import math

import duckdb
import pytest

import tessera.plans as plans
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x.asDict().values())
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = plans.PLANS[name](spark, SF)
    at = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in at.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in at.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
