"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
check, at the smallest scale)."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in ORACLE:
        assert df.count() > 0
        return
    types = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    rel = con.sql(ORACLE[name])
    spark_types = {c: types.get(t, t) for c, t in df.dtypes}
    oracle_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == oracle_types
    r = compare(df, con, ORACLE[name])
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns
