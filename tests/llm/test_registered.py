"""The registered queries on the smallest given tables, against their SQL where they have any."""

import os

import __spark_entry__ as entry_module
import duckdb
import pytest

from pipecheck.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_all_operators_and_the_pipeline():
    names = set(entry_module.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    rows = df.collect()
    sql = entry_module.oracle_sql().get(name)
    table, key = next((t, k) for t, k in (("pages", "page_id"), ("conversations", "conv_id"), ("documents", "doc_id")) if k in df.columns)
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).distinct().count()
    if sql:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert set(names) == set(df.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())
