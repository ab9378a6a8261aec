import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pipecheck.functions.shapes import key_prefix, key_shape, strip_prefix, value_shape
from pipecheck.operators import keys
from pipecheck.operators.classify import failure_kind, zero_row_join
from pipecheck.plans.diagnose import column_findings, diagnose, load_signs
from tests.conftest import values


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT 1 FROM orders o JOIN customers c ON o.cid = c.id", ("orders", "cid", "customers", "id")),
        ("select 1 from orders as o\n join customers as c\n on c.id=o.cid", ("customers", "id", "orders", "cid")),
        ("SELECT 1 FROM orders JOIN customers c ON orders.cid = c.id", ("orders", "cid", "customers", "id")),
        ("SELECT 1 FROM orders LEFT JOIN customers c ON orders.cid = c.id", ("orders", "cid", "customers", "id")),
        ("SELECT 1 FROM a x JOIN b y ON x.k = y.k JOIN c z ON z.k = y.k", ("a", "k", "b", "k")),
        ("SELECT 1 FROM a x JOIN b y ON x.k = CAST(y.k AS INT)", None),
        ("SELECT 1 FROM a", None),
    ],
)
def test_join_keys_of_sql(frame, sql, want):
    got = values(keys.sql_join_keys(frame([(sql,)], "sql string")), "left_table", "left_column", "right_table", "right_column")
    assert got == ([want] if want else [])


def test_shapes(frame):
    df = frame([("CUST-101", "$12.50")], "k string, v string")
    row = df.select(key_shape(F.col("k")), key_prefix(F.col("k")), value_shape(F.col("v")), value_shape(F.col("k"), True)).first()
    assert tuple(row) == ("CUST-9", "CUST-", "$99.99", "A-9")


def test_strip_prefix(frame):
    df = frame([("CUST-101",), ("101",), ("CUST-x",), ("CUST-1.5f",), (None,), ("CUST-99999999999999999999",)], "k string")
    got = [r[0] for r in df.select(strip_prefix(F.col("k"), "CUST-")).collect()]
    assert got == [101, 101, None, None, None, None]


@pytest.fixture
def sides(frame):
    random.seed(7)
    # One key holds a third of the left rows, and some rows are copies.
    left = [(i, 42 if i % 3 == 0 else random.randint(1, 400)) for i in range(3000)]
    left += [(-1, 42)] * 50 + [(9000, None)]
    right = [(f"CUST-{k}", f"n{k}") for k in range(0, 300)] + [("CUST-7", "again"), ("CUST-x", "junk"), (None, "none")]
    return left, right, frame(left, "order_id int, customer int"), frame(right, "customer_id string, name string")


def brute_force(left, right):
    names = {}
    for key, name in right:
        if key and key[5:].isdigit():
            names.setdefault(int(key[5:]), []).append(name)
    return Counter((i, k, n) for i, k in left for n in names.get(k, []))


@pytest.mark.parametrize("hot_share", [None, 0.1, 0.9])
def test_repaired_join_against_brute_force(sides, hot_share):
    left, right, l, r = sides
    got = keys.repaired_join(l, "customer", r, "customer_id", "CUST-", hot_share)
    assert got.columns == ["order_id", "customer", "name"]
    assert Counter(tuple(row) for row in got.collect()) == brute_force(left, right)


def test_hot_keys_are_few(sides):
    _, _, l, _ = sides
    assert values(keys.hot_keys(l, "customer", 0.1)) == [(42,)]


def test_same_column_on_both_sides_is_an_error(frame):
    l, r = frame([(1, 2)], "k int, x int"), frame([("A1", 3)], "k2 string, x int")
    with pytest.raises(ValueError, match="x"):
        keys.repaired_join(l, "k", r, "k2", "A")


def test_match_rate_against_brute_force(sides):
    left, right, l, r = sides
    rows = {row.form: row for row in keys.match_rate(l, "customer", r, "customer_id", "CUST-").collect()}
    known = {int(k[5:]) for k, _ in right if k and k[5:].isdigit()}
    matched = [k for _, k in left if k in known]
    got = rows["repaired"]
    assert (got.left_rows, got.matched_rows, got.matched_keys) == (len(left), len(matched), len(set(matched)))
    assert got.match_rate == pytest.approx(len(matched) / len(left), abs=1e-6)
    assert rows["raw"].matched_rows == 0


def test_match_rate_of_nothing(frame):
    l, r = frame([], "k int"), frame([("A1",)], "q string")
    assert {r.match_rate for r in keys.match_rate(l, "k", r, "q", "A").collect()} == {0.0}


def test_lost_keys(sides):
    _, _, _, r = sides
    assert values(keys.lost_keys(r, "customer_id", "CUST-")) == [(303, 1, 1)]


def test_key_samples(sides):
    _, _, l, r = sides
    got = values(keys.sample_join_keys(l, "customer", r, "customer_id"), "side", "data_type", "value")
    assert len(got) == 20 and ("right", "VARCHAR", "CUST-0") in got and ("left", "INTEGER", "1") in got


@pytest.mark.parametrize(
    "log, sql, want",
    [
        ("completed with 0 rows inserted", "SELECT * FROM a JOIN b", True),
        ("completed with 0 row", "select * from a join b", True),
        ("Source: (10 rows)", "SELECT * FROM a JOIN b", False),
        ("0 rows", "SELECT * FROM a", False),
        ("", "SELECT * FROM a JOIN b", False),
    ],
)
def test_zero_row_join(frame, log, sql, want):
    df = frame([(log, sql)], "log string, sql string")
    assert df.select(zero_row_join(F.col("log"), F.col("sql"))).first()[0] is want


def test_failure_kind_order(frame):
    rows = [(a, b, c, d) for a in (True, False) for b in (True, False) for c in (True, False) for d in (True, False)]
    df = frame(rows, "z boolean, r boolean, m boolean, b boolean")
    for row in df.withColumn("kind", failure_kind(*[F.col(c) for c in "zrmb"])).collect():
        first = next((k for flag, k in zip(row[:4], (
            "join_key_format_mismatch", "column_name_mismatch", "missing_column", "type_cast_error")) if flag), "unknown")
        assert row.kind == first


def test_diagnose_takes_all_tables_of_a_load(frame):
    comparisons = frame(
        [("a", "d", "x", "MISSING IN SOURCE", None), ("b", "d", "p", "TYPE MISMATCH", 3), ("c", "d", "p", "TYPE MISMATCH", 0)],
        "source_table string, dest_table string, dest_column string, status string, n_uncastable long",
    )
    candidates = frame([("a", "d", "x")], "source_table string, dest_table string, dest_column string")
    loads = frame(
        [(1, "b", "d", "", ""), (1, "a", "d", "", ""), (2, "b", "d", "", ""), (3, "c", "d", "", ""), (4, "new", "d", "", ""),
         (5, "a", "d", "x JOIN y", "0 rows")],
        "load_id int, source_table string, dest_table string, sql string, log string",
    )
    got = values(diagnose(load_signs(loads), column_findings(comparisons, candidates)), "load_id", "failure_kind")
    assert got == [
        (1, "column_name_mismatch"), (2, "type_cast_error"), (3, "unknown"), (4, "unknown"), (5, "join_key_format_mismatch")
    ]


def test_a_healthy_join_load_is_unknown(frame):
    comparisons = frame(
        [("o", "d", "id", "OK", None), ("o", "d", "name", "MISSING IN SOURCE", None), ("c", "d", "id", "MISSING IN SOURCE", None), ("c", "d", "name", "OK", None)],
        "source_table string, dest_table string, dest_column string, status string, n_uncastable long",
    )
    candidates = frame([("c", "d", "id")], "source_table string, dest_table string, dest_column string")
    loads = frame([(1, "o", "d", "", ""), (1, "c", "d", "", ""), (2, "c", "d", "", "")], "load_id int, source_table string, dest_table string, sql string, log string")
    got = values(diagnose(load_signs(loads), column_findings(comparisons, candidates)), "load_id", "failure_kind")
    assert got == [(1, "unknown"), (2, "column_name_mismatch")]


def test_keys_with_letters_fractions_and_a_hot_key(frame):
    left = frame([("A7", 1), (" 007", 2), ("B", 3), ("", 4), (None, 5)], "k string, v int")
    right = frame([("CUST-A7", "x"), ("CUST-7", "y"), ("CUST-", "z")], "id string, w string")
    assert values(keys.repaired_join(left, "k", right, "id", "CUST-"), "v", "w") == [(1, "x"), (2, "y")]
    doubles = frame([(101.7, 1), (101.0, 2), (1e300, 3), (float("nan"), 4)], "k double, v int")
    people = frame([("CUST-101", "a")], "id string, w string")
    assert values(keys.repaired_join(doubles, "k", people, "id", "CUST-"), "v", "w") == [(2, "a")]
    many = frame([(1 if n % 3 == 0 else n, n) for n in range(300)], "k long, v int")
    sides = frame([(f"CUST-{n}", n) for n in range(300)] + [("CUST-1", 1000)], "id string, w int")
    plain, salted = (values(keys.repaired_join(many, "k", sides, "id", "CUST-", share), "v", "w") for share in (None, 0.2))
    assert plain == salted and len(plain) == 401
    with pytest.raises(ValueError, match="hot_share"):
        keys.repaired_join(many, "k", sides, "id", "CUST-", 0)
