"""Appends that happen once, quarantine, and profiles that add up."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.operators import commits as c
from pipecheck.operators import states
from pipecheck.operators.quality import clean_report, uncastable_shapes
from pipecheck.plans.quarantine import append_good_rows
from pipecheck.plans.repair import propose_repair
from pipecheck.session import staging_table
from pipecheck.sources.ddl import create_tables
from tests.conftest import values


@pytest.fixture
def table(spark):
    name = staging_table(spark, "once")
    c.create_repair_table(spark, name, "id INTEGER, note TEXT")
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows(frame, low, high):
    return frame([(n, f"n{n}") for n in range(low, high)], "id int, note string")


class Lost(Exception):
    pass


@pytest.mark.parametrize("place", ["_say", "_publish", "after publish", "in publish"])
def test_rows_are_there_once_wherever_a_driver_is_lost(spark, frame, table, monkeypatch, place):
    c.append_once(rows(frame, 0, 3), table, "first")
    say, publish = c._say, c._publish

    def lose(*_, **__):
        raise Lost

    with monkeypatch.context() as m:
        if place == "in publish":
            # Half of the rows are in the partition when the driver is lost.
            m.setattr(c, "_publish", lambda s, t, i, staged: (s.sql(f"INSERT INTO {t} PARTITION ({c.REPAIR} = '{i}') SELECT * FROM parquet.`{staged}` LIMIT 2"), lose()))
        elif place == "after publish":
            m.setattr(c, "_publish", lambda *a: (publish(*a), lose()))
        elif place == "_say":
            m.setattr(c, "_say", lambda s, t, i, state, *rest: lose() if state == c.COMMITTED else say(s, t, i, state, *rest))
        else:
            m.setattr(c, place, lose)
        with pytest.raises(Lost):
            c.append_once(rows(frame, 3, 8), table, "second")
    assert values(c.committed_rows(spark, table), "id") == [(0,), (1,), (2,)]
    assert c.recover(spark, table) == ["second"]
    assert c.recover(spark, table) == []
    assert c.append_once(rows(frame, 3, 8), table, "second") == c.Commit(c.COMMITTED, 5, True)
    assert values(c.committed_rows(spark, table)) == [(n, f"n{n}") for n in range(8)] == sorted(values(spark.table(table), "id", "note"))


def test_lost_before_anything_is_logged(spark, frame, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(c, "_say", lambda *_: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            c.append_once(rows(frame, 0, 2), table, "r")
    assert c.recover(spark, table) == [] and spark.table(table).count() == 0
    assert c.append_once(rows(frame, 0, 2), table, "r") == c.Commit(c.COMMITTED, 2)


def test_a_check_that_fails_and_other_cases(spark, frame, table):
    assert c.append_once(rows(frame, 0, 2), table, "bad", F.col("id") > 5).state == c.REFUSED
    assert c.append_once(rows(frame, 0, 2), table, "few", min_rows=3).state == c.REFUSED
    assert c.append_once(rows(frame, 0, 2), table, "bad", F.col("id") > 5).repeated
    assert c.append_once(rows(frame, 0, 0), table, "none") == c.Commit(c.COMMITTED, 0)
    assert spark.table(table).count() == 0
    with pytest.raises(ValueError, match="columns"):
        c.append_once(rows(frame, 0, 1).drop("note"), table, "x")
    with pytest.raises(ValueError, match="id"):
        c.append_once(rows(frame, 0, 1), table, "x' OR 1")
    with pytest.raises(ValueError, match="prepared"):
        c.commit(spark, table, "unknown")


def test_quarantine(spark, frame):
    name = staging_table(spark, "stock")
    create_tables(spark, f"CREATE TABLE {name} (item TEXT, n INTEGER, price DOUBLE)")
    source = frame(
        [("a", "1", "$2.50"), ("b", "x", "ask"), ("c", "2.5", "3"), ("d", "99999999999", "N/A"), ("e", None, ""), ("f", "1,000", "1e5"), ("b", "x", "ask")],
        "item string, n string, price string",
    )
    repair = propose_repair(source, spark.table(name).schema)
    appended, aside = append_good_rows(source, name, repair)
    assert appended == 3 and values(spark.table(name)) == [("a", 1, 2.5), ("e", None, None), ("f", 1000, 100000.0)]
    assert values(aside, "column_name", "value", "reason") == [
        ("n", "2.5", "no whole number"), ("n", "99999999999", "out of range"), ("n", "x", "no number"), ("n", "x", "no number"), ("price", "ask", "no number"), ("price", "ask", "no number")
    ]
    lost = {r.column_name: r.n_lost for r in clean_report(source, {"n": T.IntegerType(), "price": T.DoubleType()}).collect()}
    assert lost == {r.column_name: r["count"] for r in aside.groupBy("column_name").count().collect()}
    assert {r.source_row for r in aside.filter("value = '2.5'").collect()} == {'{"item":"c","n":"2.5","price":"3"}'}
    spark.sql(f"DROP TABLE {name}")


TARGETS = {"price": T.DoubleType(), "day": T.DateType()}


def test_states_of_parts_are_those_of_the_whole(spark, tmp_path):
    df = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), F.col("id") % 50, F.lit("-"), F.col("id") % 3)).alias("price"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("2031-01-0"), F.col("id") % 9 + 1)).otherwise("soon").alias("day"),
    )
    path = str(tmp_path / "states")
    for part in range(4):
        states.add_part(df.filter(F.col("id") % 4 == part), TARGETS, path)
    merged = sorted(states.stored_profile(spark, path).collect())
    assert merged == sorted(states.profile(states.column_states(df, TARGETS)).collect())
    shapes = {(r.column_name, s.shape): s.n for r in merged for s in r.shapes}
    assert shapes == {(r.column_name, r.shape): r.n_values for r in uncastable_shapes(df, TARGETS, runs=True).collect()}
    assert {r.column_name: (r.n_rows, r.n_null, r.n_values) for r in merged} == {"price": (30000, 4286, 150), "day": (30000, 0, 10)}


def test_states_without_rows_or_faults(spark, frame, tmp_path):
    path = str(tmp_path / "states")
    empty = frame([], "price string, day string")
    states.add_part(empty, TARGETS, path)
    states.add_part(frame([("1.5", None)], "price string, day string"), TARGETS, path)
    got = {r.column_name: (r.n_rows, r.n_null, r.n_uncastable, r.n_values, r.shapes) for r in states.stored_profile(spark, path).collect()}
    assert got == {"price": (1, 0, 0, 1, []), "day": (1, 1, 0, 0, [])}


def test_no_shuffle_of_values(spark):
    df = spark.range(100000).select(F.concat(F.lit("x"), "id").alias("price"))
    plan = states.column_states(df, {"price": T.DoubleType()})._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan
