"""Every registered query with a DuckDB equivalent gives the same rows on the smallest tables."""

import math
import os

import pytest

from folioflow.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == names
    want = sorted((tuple(cell(r[order.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want
    spark.catalog.clearCache()


def test_every_query_has_a_known_form():
    assert set(oracle_sql()) <= set(queries())
    assert set(queries()) - set(oracle_sql()) == {"answers_with_provenance"}
