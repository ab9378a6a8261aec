import pytest
from pyspark.sql import functions as F

from pipecheck.operators import verify
from pipecheck.session import staging_database, staging_table
from pipecheck.sources.ddl import create_tables
from tests.conftest import values


@pytest.fixture
def dest(spark):
    name = staging_table(spark, "dest")
    create_tables(spark, f"CREATE TABLE {name} (id INTEGER, region TEXT)")
    yield name
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize(
    "minimum, check, want", [(None, "x > 0", (2, None, True)), (3, "x > 0", (2, 3, False)), (2, "x > 0", (2, 2, True)), (None, "x > 9", (0, None, False))]
)
def test_verify(frame, minimum, check, want):
    df = frame([(0,), (1,), (2,)], "x int")
    assert tuple(verify.verify(df, F.expr(check), minimum).first()) == want


@pytest.mark.parametrize(
    "query, minimum, want",
    [
        ("SELECT count(*) AS n FROM range(5)", None, ("verified", 5)),
        ("SELECT count(*) AS n FROM range(5)", 6, ("failed", 5)),
        ("SELECT count(*) AS n FROM range(0)", None, ("failed", 0)),
        ("SELECT id FROM range(0)", None, ("failed", 0)),
        ("SELECT -3 AS n", None, ("failed", -3)),
        ("SELECT 'seven' AS n", None, ("unverified", None)),
        ("SELECT count(*) FROM no_such_table", None, ("error", None)),
        ("", None, ("unverified", None)),
        ("WITH r AS (SELECT id FROM range(4)) SELECT count(*) FROM r; -- all", None, ("verified", 4)),
        ("SELECT reflect('java.lang.Math', 'abs', -1)", None, ("error", None)),
        ("SELECT count(*) FROM range(3) WHERE 'reflect(' <> 'x'", None, ("verified", 3)),
    ],
)
def test_verify_query(spark, query, minimum, want):
    assert verify.verify_query(spark, query, minimum) == want


def staged(spark):
    return [t.name for t in spark.catalog.listTables(staging_database(spark)) if t.name.startswith("repair_")]


def test_good_repair_is_appended(spark, frame, dest):
    df = frame([(1, "UNKNOWN"), (2, "UNKNOWN")], "id int, region string")
    row = verify.apply_repair(df, dest, F.col("region") == "UNKNOWN", 2).first()
    assert (row.status, row.staged_rows, row.appended_rows, row.table_checked_rows, row.error) == ("verified", 2, 2, 2, None)
    assert values(spark.table(dest)) == [(1, "UNKNOWN"), (2, "UNKNOWN")]
    assert staged(spark) == []


def test_failing_check_leaves_the_table_alone(spark, frame, dest):
    df = frame([(1, "x")], "id int, region string")
    row = verify.apply_repair(df, dest, F.col("region") == "UNKNOWN").first()
    assert (row.status, row.checked_rows, row.appended_rows) == ("failed", 0, 0)
    assert spark.table(dest).count() == 0 and staged(spark) == []


def test_repair_that_does_not_compute_is_an_error(spark, frame, dest):
    df = frame([("1",), ("x",)], "id string").select(F.col("id").cast("int").alias("id"), F.lit("r").alias("region"))
    row = verify.apply_repair(df, dest, F.col("id") > 0).first()
    assert row.status == "error" and "CAST_INVALID_INPUT" in row.error
    assert spark.table(dest).count() == 0 and staged(spark) == []


def test_wrong_columns_are_an_error(spark, frame, dest):
    row = verify.apply_repair(frame([(1,)], "id int"), dest, F.col("id") > 0).first()
    assert row.status == "error" and "region" in row.error


def test_without_a_check_it_is_unverified(spark, frame, dest):
    row = verify.apply_repair(frame([(1, "a")], "id int, region string"), dest).first()
    assert (row.status, row.appended_rows) == ("unverified", 1)


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE victim", "INSERT INTO victim VALUES (2)", "WITH r AS (SELECT 7 AS n) INSERT INTO victim SELECT n FROM r", "TRUNCATE TABLE victim",
        "SELECT 1) AS a; DROP TABLE victim --", "SELECT 1; DROP TABLE victim", "FROM victim INSERT INTO victim SELECT n", "SET spark.sql.ansi.enabled = false",
        "CREATE OR REPLACE TABLE victim (x int)", "/* SELECT */ DROP TABLE victim",
    ],
)
def test_nothing_but_a_select_runs(spark, text):
    spark.createDataFrame([(1,)], "n int").write.mode("overwrite").saveAsTable("victim")
    assert verify.verify_query(spark, text) == ("error", None)
    reports = spark.createDataFrame([("c", "m", "INSERT INTO other SELECT 1 AS n", text), ("d", "m", f"INSERT INTO other {text}", "SELECT 1")], FIXES)
    rows = verify.score_fixes(spark, reports, "other", spark.table("victim").schema).collect()
    assert all(r.fix_error or r.check_error for r in rows) and values(spark.table("victim")) == [(1,)]
    assert spark.conf.get("spark.sql.ansi.enabled") != "false"


FIXES = "case_id string, model string, fixed_sql string, verification_query string"


def test_names_of_columns_texts_and_databases(spark):
    spark.createDataFrame([(1, "x"), (2, "named")], "named int, note string").createOrReplaceTempView("named_in")
    spark.createDataFrame([(9, "old")], "named int, note string").write.mode("overwrite").saveAsTable("named")
    fix = "INSERT INTO {} (named, note) SELECT named, note FROM named_in"
    checks = {
        "column": "SELECT count(named) FROM named", "qualified": "SELECT count(*) FROM default.named", "catalog": "SELECT count(*) FROM spark_catalog.`default`.named AS x",
        "text": "SELECT count(*) FROM named WHERE note = 'named'", "quoted": "SELECT count(*) FROM named WHERE note <> 'default.named'", "both": "SELECT count(named.named) FROM named",
    }
    reports = [(k, "m", fix.format("default.named" if k == "qualified" else "named"), c) for k, c in checks.items()]
    dest = spark.table("named").schema
    rows = verify.score_fixes(spark, spark.createDataFrame(reports, FIXES), "named", dest).collect()
    assert {r.case_id: (r.fix_error, r.check_error, r.cnt) for r in rows} == {k: (None, None, 1 if k == "text" else 2) for k in checks}
    assert values(spark.table("named")) == [(9, "old")]


def test_insert_on_its_own_table(spark):
    spark.createDataFrame([], "n int, m int").write.mode("overwrite").saveAsTable("own_into")
    assert verify.run_insert(spark, "INSERT INTO default.own_into (n) SELECT id FROM range(3);") == 3
    assert values(spark.table("own_into")) == [(0, None), (1, None), (2, None)]


def test_equal_fixes_run_once_and_go_on_after_a_loss(spark, monkeypatch, tmp_path):
    from pipecheck.operators import verify as v

    spark.createDataFrame([(1,), (2,)], "n int").createOrReplaceTempView("once_from")
    spark.createDataFrame([], "n int").write.mode("overwrite").saveAsTable("once_into")
    dest, run, texts = spark.table("once_into").schema, v.insert_rows, []
    monkeypatch.setattr(v, "insert_rows", lambda session, text, *rest: texts.append(text) or run(session, text, *rest))
    monkeypatch.setattr(v, "OUTCOME_ROWS", 2)
    fixes = [("INSERT INTO once_into SELECT n FROM once_from", "SELECT COUNT(*) FROM once_into"), ("nonsense", None), (None, None),
             ("INSERT INTO once_into SELECT n FROM once_from WHERE n > 1", "SELECT COUNT(*) FROM once_into"), ("INSERT INTO once_into SELECT 1", "SELECT x FROM once_into")]
    reports = spark.createDataFrame([(f"c{n}", "m", *fixes[n % 5]) for n in range(40)], FIXES)
    folder = str(tmp_path / "outcomes")
    v.score_fixes(spark, reports.filter("case_id in ('c0', 'c1', 'c2')"), "once_into", dest, outcomes=folder).collect()
    assert len(texts) == 3
    rows = v.score_fixes(spark, reports, "once_into", dest, at_once=2, outcomes=folder).collect()
    assert len(texts) == 5 and sorted(r.case_id for r in rows) == sorted(f"c{n}" for n in range(40))
    want = [(False, False, 2), (True, False, None), (True, False, None), (False, False, 1), (False, True, None)]
    assert all((r.fix_error is not None, r.check_error is not None, r.cnt) == want[int(r.case_id[1:]) % 5] for r in rows)
    assert v.score_fixes(spark, reports.limit(0), "once_into", dest).count() == 0 and spark.table("once_into").count() == 0
    assert not [t for t in spark.catalog.listTables(staging_database(spark)) if t.name.startswith("fix_")]
