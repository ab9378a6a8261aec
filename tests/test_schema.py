import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.types import is_widening, safe_cast, schema_from_ddl, sql_name
from pipecheck.operators import align, quality, schema
from pipecheck.operators.samples import smallest_distinct, smallest_distinct_each
from tests.conftest import values


def test_profile(frame):
    df = frame([(1, "Alice", 30), (2, "Bob", 25)], "id int, name string, age int")
    got = values(schema.table_profile(df))
    assert got == [
        (1, "id", "INTEGER", True, 2), (2, "name", "VARCHAR", True, 2), (3, "age", "INTEGER", True, 2)
    ]


def test_compare_same_table(frame):
    df = frame([(1, "Alice")], "id int, name string")
    assert {r.status for r in schema.compare_schemas(df, df.schema).collect()} == {"OK"}


def test_compare_order_counts_and_widening(frame):
    src = frame([(1, "$12.50", 3), (2, "N/A", 4), (3, "7", 5), (4, None, 6)], "id int, price string, extra int")
    dest = T.StructType().add("price", "double").add("region", "string").add("id", "long")
    rows = [tuple(r) for r in schema.compare_schemas(src, dest).orderBy("ordinal").collect()]
    assert rows == [
        (1, "price", "VARCHAR", "price", "DOUBLE", "TYPE MISMATCH", False, 4, 2),
        (2, None, None, "region", "VARCHAR", "MISSING IN SOURCE", False, 4, None),
        (3, "id", "INTEGER", "id", "BIGINT", "TYPE MISMATCH", True, 4, 0),
        (4, "extra", "INTEGER", None, None, "EXTRA IN SOURCE", False, 4, None),
    ]


def test_column_names_are_case_sensitive(frame):
    src = frame([(1,)], "Amount int")
    got = values(schema.compare_schemas(src, T.StructType().add("amount", "integer")), "status")
    assert got == [("EXTRA IN SOURCE",), ("MISSING IN SOURCE",)]


def test_mismatch_samples(frame):
    src = frame([(1, "$12.50"), (2, "N/A"), (3, None)], "id int, price string")
    dest = T.StructType().add("id", "integer").add("price", "double")
    assert values(schema.mismatch_samples(src, dest)) == [
        ("price", "$12.50", False), ("price", "N/A", False), ("price", None, True)
    ]
    assert schema.mismatch_samples(src, src.schema).count() == 0


def test_sample_values(frame):
    df = frame([(i % 13,) for i in range(200)], "n int")
    got = schema.sample_values(df, "n").collect()
    assert [(r.value, r.data_type) for r in got] == [(str(i), "INTEGER") for i in range(10)]
    assert schema.sample_values(frame([], "n int"), "n").count() == 0


@pytest.mark.parametrize("distinct", [1, 9, 10, 11, 40, 3000])
@pytest.mark.parametrize("nulls", [False, True])
def test_smallest_distinct_is_exact(frame, distinct, nulls):
    random.seed(distinct)
    pool = random.sample(range(-(10**9), 10**9), distinct)
    # A third of all rows hold one value.
    rows = [(v,) for v in pool + [pool[0]] * (distinct // 2 + 5)] + ([(None,)] * 3 if nulls else [])
    got = [r.n for r in smallest_distinct(frame(rows, "n long"), "n").collect()]
    want = ([None] if nulls else []) + sorted(pool)
    assert got == want[:10]
    keyed = [(c, str(v) if v is not None else None) for c in "ab" for (v,) in rows]
    each = smallest_distinct_each(frame(keyed, "k string, n string"), "k", "n")
    text = ([None] if nulls else []) + sorted(str(v) for v in pool)
    for c in "ab":
        assert {r.n for r in each.filter(F.col("k") == c).collect()} == set(text[:10])


def test_all_sources(frame):
    dest = T.StructType().add("id", "integer")
    got = schema.compare_all_sources({"a": frame([(1,)], "id int"), "b": frame([], "x int")}, dest)
    assert values(got, "source_table", "status") == [
        ("a", "OK"), ("b", "EXTRA IN SOURCE"), ("b", "MISSING IN SOURCE")
    ]


def test_catalogs(frame):
    columns = frame(
        [("s", 1, "id", "INTEGER"), ("s", 2, "old", "DOUBLE"), ("d", 1, "id", "integer"), ("d", 2, "new", "DOUBLE"), ("d", 3, "t", "DATE"), ("s", 3, "t", "VARCHAR")],
        "table_name string, ordinal int, column_name string, data_type string",
    )
    pairs = frame([("s", "d"), ("s", "d"), ("s", "nowhere")], "source_table string, dest_table string")
    got = values(schema.compare_catalogs(columns, pairs), "dest_table", "column_name", "status")
    assert got == [
        ("d", "id", "OK"), ("d", "new", "MISSING IN SOURCE"), ("d", "old", "EXTRA IN SOURCE"), ("d", "t", "TYPE MISMATCH")
    ]


def test_resolve_sources(frame):
    rows = [
        (1, (None, ["a", "b"])), (2, ("in/x.2024.csv", [])), (3, ("x.csv", ["c"])),
        (4, (None, None)), (5, ("", None)), (6, ("/d/.hidden", None)), (7, ("plain", None)),
    ]
    df = frame(rows, "id int, source struct<path: string, tables: array<string>>")
    assert values(schema.resolve_sources(df), "id", "source_table") == [
        (1, "a"), (1, "b"), (2, "x.2024"), (3, "c"), (6, ".hidden"), (7, "plain")
    ]


@pytest.mark.parametrize(
    "text, double, integer, date",
    [
        ("12.50", True, False, False), ("$12.50", False, False, False), ("1.5f", False, False, False),
        ("1d", False, False, False), (" 7 ", True, True, False), ("-3", True, True, False), ("1e3", True, False, False),
        ("99999999999", True, False, False), ("", False, False, False), ("2024-11-01", False, False, True),
        ("2024", True, True, False), ("2024-13-01", False, False, False), ("nan", True, False, False), ("1,000", False, False, False),
    ],
)
def test_casts_follow_sql(frame, text, double, integer, date):
    df = frame([(text,)], "v string")
    cast = [safe_cast(F.col("v"), T.StringType(), t).isNotNull() for t in (T.DoubleType(), T.IntegerType(), T.DateType())]
    assert tuple(df.select(*cast).first()) == (double, integer, date)


def test_type_names():
    assert sql_name(T.ArrayType(T.FloatType())) == "FLOAT[]"
    assert sql_name(T.DecimalType(18, 2)) == "DECIMAL(18,2)"
    assert is_widening(T.IntegerType(), T.LongType()) and not is_widening(T.LongType(), T.IntegerType())
    assert is_widening(T.IntegerType(), T.DoubleType()) and not is_widening(T.LongType(), T.DoubleType())


PRICES = ["$12.50", "N/A", None, "8", "$1,200.00", "", " N/A ", "call", "n/a"]


def test_dirty_values(frame):
    df = frame([(p,) for p in PRICES], "price string")
    targets = {"price": T.DoubleType()}
    assert values(quality.uncastable_profile(df, targets)) == [("price", "DOUBLE", 9, 1, 7)]
    shapes = {r.shape: r.n_values for r in quality.uncastable_shapes(df, targets).collect()}
    assert shapes == {"$99.99": 1, "$9,999.99": 1, "": 1, " A/A ": 1, "AAAA": 1, "A/A": 2}
    runs = {r.shape for r in quality.uncastable_shapes(df, targets, runs=True).collect()}
    assert runs == {"$9.9", "A/A", "$9,9.9", "", " A/A ", "A"}
    clean = df.select(quality.clean_cast(F.col("price"), T.DoubleType()).alias("c"))
    assert [r.c for r in clean.collect()] == [12.5, None, None, 8.0, 1200.0, None, None, None, None]
    assert values(quality.clean_report(df, targets)) == [("price", 1, 2, 3, 2)]


def test_strict_clean_cast_fails(frame):
    df = frame([("call",)], "price string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(quality.clean_cast(F.col("price"), T.DoubleType(), strict=True)).collect()


def test_rename_candidates(frame):
    src = frame([(1, 2.0, "x", 3.0)], "order_id int, total_amount double, amount_note string, ship_day double")
    dest = T.StructType().add("order_id", "integer").add("amount", "double").add("region", "string")
    got = values(align.rename_candidates(src, dest), "dest_column", "source_column", "rank", "tie", "n_uncastable")
    assert got == [("amount", "amount_note", 2, False, 1), ("amount", "total_amount", 1, False, 0)]
    assert values(align.missing_columns(src, dest), "dest_column") == [("region",)]


def test_rename_tie_is_reported(frame):
    src = frame([(1.0, 2.0)], "amount_a double, amount_b double")
    dest = T.StructType().add("amount", "double")
    got = values(align.rename_candidates(src, dest), "source_column", "rank", "tie")
    assert got == [("amount_a", 1, True), ("amount_b", 1, True)]


def test_align(frame):
    src = frame([("1", 2.5, "x")], "id string, total_amount double, junk string")
    dest = T.StructType().add("amount", "double").add("id", "integer").add("region", "string")
    out = align.align_to_schema(src, dest, {"total_amount": "amount"}, {"region": "UNKNOWN"})
    assert out.dtypes == [("amount", "double"), ("id", "int"), ("region", "string")]
    assert values(out) == [(2.5, 1, "UNKNOWN")]
    with pytest.raises(ValueError, match="region"):
        align.align_to_schema(src, dest, {"total_amount": "amount"})
    bad = frame([("CUST-1", 2.5, "x")], "id string, total_amount double, junk string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        align.align_to_schema(bad, dest, {"total_amount": "amount"}, {"region": "U"}).collect()


def test_samples_and_shapes_do_not_sort_their_tables(spark, tmp_path):
    """Minima of texts are taken of numbers first, or of values that were made distinct."""
    spark.createDataFrame([(f"v{n % 7}", n) for n in range(50)], "a string, b int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = schema.sample_values(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert [r.value for r in schema.sample_values(df, "a", 3).collect()] == ["v0", "v1", "v2"]


def test_unrelated_columns_are_never_paired(spark):
    source = spark.createDataFrame([], ", ".join(f"s{n}x int" for n in range(200)))
    dest = schema_from_ddl(", ".join(f"d{n}y INTEGER" for n in range(200)))
    assert align.rename_candidates(source, dest).count() == 0
    assert align.missing_columns(source, dest).count() == 200


def test_candidates_by_name_read_no_table(frame):
    source = frame([(1, 2)], "unit_price int, other int")
    dest = T.StructType().add("price", "double").add("note", "string")
    got = align.candidate_columns(source, dest)
    assert values(got) == values(align.rename_candidates(source, dest), "dest_column", "source_column") == [("price", "unit_price")]
    assert "Aggregate" not in got._jdf.queryExecution().toString()
    assert align.candidate_columns(source, source.schema).count() == 0
