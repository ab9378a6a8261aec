"""Every registered query against its SQL check, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from queries import REGISTRY
from queries.inputs import TABLES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(columns, rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, db, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == plain(columns, result.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["segment", "n_orders", "total"] and df.count() == 5
