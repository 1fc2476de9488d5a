import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"
SF_SMALL = SF
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def rows():
    """rows(name): a table of the smallest scale as a list of dicts."""

    def read(name, sf=SF):
        con = duckdb.connect()
        rel = con.sql(f"select * from '{sf}/{name}.parquet'")
        return [dict(zip(rel.columns, r)) for r in rel.fetchall()]

    return read


@pytest.fixture(scope="session")
def ready(spark):
    from threadlens.llm.common import ready

    ready(spark)
    return spark
