"""Columns found by their values, and the form in which two keys meet."""

import random

import pytest
from pyspark.sql import functions as F

from pipecheck.operators import key_format as k
from pipecheck.operators import value_match as v
from tests.conftest import values


@pytest.fixture
def dest(frame):
    rows = [(n, f"north {n % 4}", float(n % 9), None if n % 5 else f"2031-01-0{n % 9 + 1}") for n in range(60)]
    return frame(rows, "client int, region string, level double, day string")


def test_territory_is_found_for_region(frame, dest):
    source = frame([(n + 1000, f" north {n % 4} ", n % 9, "x") for n in range(40)], "person int, territory string, grade bigint, other string")
    got = v.renames_by_value(source, dest).select("dest_column", "source_column", "n_rows", "n_rows_found", "n_values", "n_found", "share", "rank", "tie")
    # Small numbers are clients as well as levels: both are reported.
    assert values(got) == [("client", "grade", 40, 40, 9, 9, 1.0, 1, False), ("level", "grade", 40, 40, 9, 9, 1.0, 1, False), ("region", "territory", 40, 40, 4, 4, 1.0, 1, False)]


def test_least_share_and_ties(frame):
    dest = frame([("a",), ("b",), ("c",), ("d",)], "kind string")
    source = frame([("a", "a", "a"), ("b", "b", "z"), ("c", "c", "y"), ("d", "z", "x"), (None, None, None), ("d", "a", " ")], "p string, q string, r string")
    got = v.renames_by_value(source, dest, 0.7)
    assert values(got, "source_column", "n_found", "share", "rank", "tie") == [("p", 4, 1.0, 1, False), ("q", 3, 0.75, 2, False)]
    twice = source.select("p", F.col("p").alias("p2"))
    assert {r.tie for r in v.renames_by_value(twice, dest).collect()} == {True}


def test_without_rows_or_columns(frame, dest):
    source = frame([], "territory string")
    assert v.renames_by_value(source, dest).count() == 0
    assert v.renames_by_value(frame([("north 1",)], "territory string"), dest.limit(0)).count() == 0
    assert v.renames_by_value(dest, dest).count() == 0


@pytest.mark.parametrize("common", [0, 20000, 40000])
def test_error_of_estimates(spark, common):
    left = spark.range(50000).select(F.col("id").alias("a"))
    right = spark.range(50000 - common, 110000 - common).select(F.col("id").alias("b"))
    rows = v.value_candidates(left, right, least=0.0).collect()
    assert abs(rows[0].share - common / 50000) < v.MARGIN


def test_large_sets_keep_their_pairs(spark):
    left = spark.range(30000).select(F.concat(F.lit("v"), F.when(F.col("id") < 6000, -F.col("id") - 1).otherwise(F.col("id"))).alias("a"))
    right = spark.range(80000).select(F.concat(F.lit("v"), "id").alias("b"))
    assert values(v.renames_by_value(left, right, 0.8), "n_values", "n_found", "share") == [(30000, 24000, 0.8)]


def test_sketches_of_parts_merge(spark):
    df = spark.range(90000).select(F.col("id").cast("string").alias("a"))
    parts = [v.column_sketches(df.filter(f"cast(a as bigint) % 3 = {n}"), ["a"]) for n in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2]).agg(F.theta_union_agg("s0").alias("s"))
    assert merged.select(F.theta_sketch_estimate("s")).first()[0] == v.column_sketches(df, ["a"]).select(F.theta_sketch_estimate("s0")).first()[0]


@pytest.mark.parametrize(
    "key, steps, want",
    [
        ("Ab-01", (), "Ab-01"), ("Ab-01", ("case",), "ab-01"), ("A b_0/1", ("separators",), "Ab01"), ("CU-007-x", ("prefix",), "007-x"), ("CU-007-x", ("suffix",), "CU-007"),
        ("CU-007-x", ("prefix", "suffix", "zeros"), "7"), ("007", ("zeros",), "7"), ("000", ("zeros",), "0"), ("a0b", ("zeros",), "a0b"), ("abc", ("prefix", "suffix"), "abc"),
        ("c-0010", ("zeros",), "c-10"), ("--", ("separators",), None), (None, k.STEPS, None),
    ],
)
def test_steps(frame, key, steps, want):
    assert frame([(key,)], "k string").select(k.normalised(F.col("k"), steps)).first()[0] == want


def test_three_faults_at_once(frame):
    rng = random.Random(2)
    ids = rng.sample(range(1, 100000), 500)
    left = frame([(f"{n:08d}", 1) for n in ids] + [(None, 1)], "k string, x int")
    right = frame([(f"CUST-{n}/A", n) for n in ids[:400]] + [("CUST-none", 0), (None, 0)], "r string, n int")
    rows = sorted(k.key_format(left, "k", right, "r").collect(), key=lambda r: r["rank"])
    assert (rows[0].steps, rows[0].left_keys, rows[0].matched_keys, rows[0].left_rows, rows[0].matched_rows, rows[0].match_rate) == ("prefix+suffix+zeros", 500, 400, 501, 400, 0.798403)
    joined = k.format_join(left, "k", right, "r", tuple(rows[0].steps.split("+")))
    assert sorted(r.n for r in joined.collect()) == sorted(ids[:400])


def test_steps_that_merge_keys_lose(frame):
    left = frame([(f"a{n}",) for n in range(50)] + [(f"b{n}",) for n in range(50)], "k string")
    right = frame([(f"A{n}",) for n in range(50)] + [(f"B{n}",) for n in range(50)], "r string")
    rows = sorted(k.key_format(left, "k", right, "r").collect(), key=lambda r: r["rank"])
    assert (rows[0].steps, rows[0].matched_keys) == ("case", 100)


def test_plain_keys_and_keys_that_never_meet(frame):
    left = frame([(n,) for n in range(9)], "k int")
    assert [r.steps for r in k.key_format(left, "k", frame([(float(n),) for n in range(9)], "r double"), "r").collect()] == [""]
    assert k.key_format(left, "k", frame([("x",)], "r string"), "r").count() == 0
    assert k.key_format(left.limit(0), "k", left.withColumnRenamed("k", "r"), "r").count() == 0
