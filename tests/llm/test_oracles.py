"""Every corpus query with a DuckDB equivalent gives the same rows on the smallest tables."""

import pytest

from folioflow.llm.queries import oracle_sql, queries
from tests.test_oracles import SF, cell, duck, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_corpus_oracle(spark, duck, name):  # noqa: F811
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == names
    assert got == sorted((tuple(cell(r[order.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
