"""The four kinds of broken load, from files to a verified append."""

import pytest
from pyspark.sql import functions as F

from pipecheck.functions.types import schema_from_ddl
from pipecheck.operators.keys import key_prefixes, match_rate, repaired_join
from pipecheck.operators.schema import compare_schemas
from pipecheck.operators.verify import apply_repair, run_insert, score_fixes, verify_query
from pipecheck.plans.repair import propose_repair, repaired
from pipecheck.sources.ddl import create_destination
from pipecheck.sources.tables import csv_files, read_csv, register_csv_tables
from tests.conftest import values


def prepare(folder, ddl, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    (folder / "dest_schema.sql").write_text(ddl)


def fix(spark, folder, table, check, infer=True):
    source = read_csv(spark, str(folder / "source_data.csv"), infer=infer)
    assert create_destination(spark, str(folder))
    dest = spark.table(table).schema
    repair = propose_repair(source, dest)
    outcome = apply_repair(repaired(source, dest, repair), table, check).first()
    return source, dest, repair, outcome


def test_renamed_column(spark, tmp_path):
    prepare(
        tmp_path,
        "CREATE TABLE IF NOT EXISTS g_trips (\n trip INTEGER,\n length DOUBLE,\n driver INTEGER\n)\n",
        source_data="driver,trip_length,trip\n7,12.5,1\n7,0.75,2\n9,310,3\n",
    )
    source, dest, repair, outcome = fix(spark, tmp_path, "g_trips", F.col("length").isNotNull())
    statuses = values(compare_schemas(source, dest).filter("status <> 'OK'"), "source_column", "dest_column", "status")
    assert statuses == [("trip_length", None, "EXTRA IN SOURCE"), (None, "length", "MISSING IN SOURCE")]
    assert repair.renames == {"trip_length": "length"} and not repair.defaults
    assert (outcome.status, outcome.appended_rows, outcome.table_checked_rows) == ("verified", 3, 3)
    assert verify_query(spark, "SELECT COUNT(*) AS n FROM g_trips WHERE length > 1") == ("verified", 2)


def test_missing_column(spark, tmp_path):
    prepare(
        tmp_path,
        "CREATE TABLE IF NOT EXISTS g_plants (bed INTEGER, species TEXT, colour TEXT)",
        source_data="bed,species\n4,fern\n5,moss\n6,iris\n7,reed\n8,ivy\n",
    )
    _, _, repair, outcome = fix(spark, tmp_path, "g_plants", F.col("colour") == "UNKNOWN", infer=False)
    assert repair.defaults == {"colour": "UNKNOWN"} and not repair.renames
    assert (outcome.status, outcome.appended_rows, outcome.table_checked_rows) == ("verified", 5, 5)
    assert values(spark.table("g_plants"), "bed", "species")[0] == (4, "fern")


def test_dirty_cast(spark, tmp_path):
    prepare(
        tmp_path,
        "CREATE TABLE IF NOT EXISTS g_tolls (gate VARCHAR, fee DOUBLE)",
        source_data="gate,fee\nnorth,$3\nsouth,N/A\neast,\"$1,204.25\"\nwest,$0.5\n",
    )
    source, dest, repair, outcome = fix(spark, tmp_path, "g_tolls", F.col("fee").isNotNull())
    mismatch = compare_schemas(source, dest).filter("status = 'TYPE MISMATCH'").first()
    assert (mismatch.source_column, mismatch.n_rows, mismatch.n_uncastable) == ("fee", 4, 4)
    assert repair.cleaned == ["fee"]
    assert (outcome.status, outcome.appended_rows, outcome.table_checked_rows) == ("verified", 4, 3)
    assert outcome.lost_values == 0 and values(spark.table("g_tolls"), "fee")[:2] == [(0.5,), (1204.25,)]


def test_join_keys(spark, tmp_path):
    prepare(
        tmp_path,
        "CREATE TABLE IF NOT EXISTS g_lent (loan INTEGER, reader VARCHAR)",
        g_loans="loan,card\n31,8\n32,15\n33,8\n34,42\n",
        g_cards="card_no,reader\nLIB/8,Noor\nLIB/15,Pia\nLIB/42,Qi\n",
    )
    create_destination(spark, str(tmp_path))
    found = register_csv_tables(spark, csv_files(spark, str(tmp_path)))
    loans, cards = found["g_loans"], found["g_cards"]
    faults = key_prefixes(loans, "card", cards, "card_no").filter("one_sided")
    assert values(faults) == [("", 4, 0, True), ("LIB/", 0, 3, True)]
    rates = {r.form: r.match_rate for r in match_rate(loans, "card", cards, "card_no", "LIB/").collect()}
    assert rates == {"raw": 0.0, "repaired": 1.0}
    joined = repaired_join(loans, "card", cards, "card_no", "LIB/").select("loan", "reader")
    outcome = apply_repair(joined, "g_lent", min_rows=4).first()
    assert (outcome.status, outcome.appended_rows) == ("verified", 4)
    assert values(spark.table("g_lent"))[:2] == [(31, "Noor"), (32, "Pia")]


def test_a_column_with_no_source_and_no_text_needs_a_default(spark):
    source = spark.createDataFrame([(1,)], "id int")
    dest = schema_from_ddl("id INTEGER, weight DOUBLE")
    try:
        repaired(source, dest, propose_repair(source, dest))
    except ValueError as problem:
        assert "weight" in str(problem)
    else:
        raise AssertionError("no error")
    given = propose_repair(source, dest, {"weight": 0.5})
    assert values(repaired(source, dest, given)) == [(1, 0.5)]


def test_left_over_columns_and_ties_are_never_filled(spark):
    dest = schema_from_ddl("id INTEGER, region TEXT")
    for columns in ("id int, territory string", "id int, ship_region string, home_region string"):
        source = spark.createDataFrame([], columns)
        repair = propose_repair(source, dest)
        assert repair.unresolved == ["region"] and not repair.defaults and not repair.renames
        with pytest.raises(ValueError, match="region"):
            repaired(source, dest, repair)


def test_lost_values_are_refused(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS g_lost (v DOUBLE) USING parquet")
    source = spark.createDataFrame([("1.5",), ("$2",), ("N/A",), ("about 3",), (None,)], "v string")
    dest = spark.table("g_lost").schema
    frame = repaired(source, dest, propose_repair(source, dest))
    outcome = apply_repair(frame, "g_lost", F.col("v").isNotNull()).first()
    assert (outcome.status, outcome.lost_values, outcome.appended_rows) == ("refused", 1, 0)
    outcome = apply_repair(frame, "g_lost", F.col("v").isNotNull(), most_lost=1).first()
    assert (outcome.status, outcome.lost_values, outcome.appended_rows) == ("verified", 1, 5)
    assert spark.table("g_lost").columns == ["v"]


def test_insert_texts(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string").createOrReplaceTempView("g_from")
    dest = schema_from_ddl("n INTEGER, t TEXT")
    spark.createDataFrame([], dest).write.mode("overwrite").saveAsTable("g_into")
    assert run_insert(spark, "insert into g_into (t) select t from g_from where n > 1;") == 1
    assert run_insert(spark, "INSERT INTO g_into WITH x AS (SELECT * FROM g_from) SELECT * FROM x") == 2
    assert values(spark.table("g_into")) == [(1, "a"), (2, "b"), (None, "b")]
    with pytest.raises(ValueError, match="2 values for 1"):
        run_insert(spark, "INSERT INTO g_into (n) SELECT n, t FROM g_from")
    reports = spark.createDataFrame(
        [("a", "m", "INSERT INTO g_into (n) SELECT n FROM g_from", "SELECT COUNT(*) FROM g_into"), ("b", "m", "nonsense", "SELECT 1"),
         ("c", "m", "INSERT INTO g_into (n) SELECT n FROM g_from", ""), ("d", "m", "INSERT INTO g_into SELECT * FROM nowhere", None)],
        "case_id string, model string, fixed_sql string, verification_query string",
    )
    got = {r.case_id: (r.fix_error is not None, r.check_error, r.cnt) for r in score_fixes(spark, reports, "g_into", dest).collect()}
    assert got == {"a": (False, None, 2), "b": (True, None, None), "c": (False, None, None), "d": (True, None, None)}
    assert spark.table("g_into").count() == 3
