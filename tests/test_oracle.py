"""Every registered query against its DuckDB oracle on sf0.001."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from epispark.catalog.queries import QUERIES

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare_oracle import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, con, name):
    spd = E.queries()[name](spark, SF_SMALL).toPandas()
    opd = con.execute(E.oracle_sql()[name]).df()
    sc, sr = rows_of(spd)
    oc, orr = rows_of(opd)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["periodo", "n"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())
