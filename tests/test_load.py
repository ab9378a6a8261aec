"""Whole loads from their folders: diagnosis, repair, verified rows."""

import json

import pytest
from pyspark.sql import functions as F

from pipecheck.plans.load import column_sources, diagnose_load, open_load, repair_load
from tests.conftest import values

LOADS = {
    "renamed": dict(
        engine="duckdb", table="l_tides", source={"type": "csv", "path": "l_gauges.csv"},
        sql="INSERT INTO l_tides (gauge, water_level)\nSELECT gauge, water_level FROM l_gauges",
        ddl="CREATE TABLE IF NOT EXISTS l_tides (gauge INTEGER, level DOUBLE)",
        files={"l_gauges": "gauge,water_level\n7,0.35\n8,1.10\n9,-0.2\n4,0.0\n"},
        log="2033-02-01 00:10:09 ERROR  tides: water_level is unknown here\n",
        kind="column_name_mismatch", check="level IS NOT NULL", rows=4, checked=4,
    ),
    "missing": dict(
        engine="sqlite", table="l_rooms", source={"type": "csv", "path": "house/l_rooms_in.csv"},
        sql="INSERT INTO l_rooms (room, label, wing)\nSELECT room, label, wing FROM l_rooms_in",
        ddl="CREATE TABLE IF NOT EXISTS l_rooms (room INTEGER, label TEXT, wing TEXT)",
        files={"l_rooms_in": "room,label\n11,Attic\n12,\n13,Hall\n"},
        log="2033-02-02 01:20:18 ERROR  rooms: wing is unknown here\n",
        kind="missing_column", check="wing = 'UNKNOWN' AND label IS NOT NULL", rows=3, checked=3,
    ),
    "cast": dict(
        engine="duckdb", table="l_fares", source={"type": "csv", "path": "l_tickets.csv"},
        sql="INSERT INTO l_fares (route, fare)\nSELECT route, CAST(fare AS DOUBLE) FROM l_tickets",
        ddl="CREATE TABLE IF NOT EXISTS l_fares (route VARCHAR, fare DOUBLE)",
        files={"l_tickets": 'route,fare\nnorth,$4.20\nsouth,N/A\neast,"1,250.00"\nwest,3\n'},
        log="2033-02-03 02:30:27 ERROR  fares: $4.20 is no number\n",
        kind="type_cast_error", check="fare IS NOT NULL", rows=4, checked=3,
    ),
    "keys": dict(
        engine="duckdb", table="l_stays", source={"type": "multi_table", "tables": ["l_visits", "l_guests"]},
        sql="INSERT INTO l_stays (visit, guest, nights)\nSELECT v.visit, g.guest, v.nights\n"
            "FROM l_visits v\nJOIN l_guests g ON v.badge = g.badge\n",
        ddl="CREATE TABLE IF NOT EXISTS l_stays (visit INTEGER, guest VARCHAR, nights DOUBLE)",
        files={"l_visits": "visit,badge,nights\n51,3,2\n52,4,0.5\n53,3,7\n", "l_guests": "badge,guest\nG-3,Ida\nG-4,Tom\n"},
        log="2033-02-04 03:40:36 WARN   stays: 0 rows came in\n",
        kind="join_key_format_mismatch", check="nights > 0", rows=3, checked=3,
    ),
    "renamed in a join": dict(
        engine="duckdb", table="l_crews", source={"type": "multi_table", "tables": ["l_trips", "l_boats"]},
        sql="INSERT INTO l_crews (trip, boat_label, crew, port)\nSELECT t.trip, b.label, t.crew, b.port\n"
            "FROM l_trips AS t\nJOIN l_boats b ON t.boat = b.boat WHERE t.trip > 0\n",
        ddl="CREATE TABLE IF NOT EXISTS l_crews (trip INTEGER, boat_label VARCHAR, crew INTEGER, port VARCHAR)",
        files={"l_trips": "trip,boat,crew\n1,5,\"1,200\"\n2,6,N/A\n3,5,8\n", "l_boats": "boat,boat_label,port\n5,Gull,A\n6,Tern,B\n"},
        log="2033-02-05 04:50:45 ERROR  crews: b.label is unknown here\n",
        kind=None, check="boat_label IS NOT NULL", rows=3, checked=3,
    ),
}


@pytest.mark.parametrize("name", LOADS)
def test_load(spark, tmp_path, name):
    case = LOADS[name]
    (tmp_path / "load.json").write_text(json.dumps({
        "name": name, "source": case["source"], "transform": {"sql": case["sql"]},
        "destination": {"engine": case["engine"], "table": case["table"]},
    }))
    (tmp_path / "error.log").write_text("2033-02-01 00:00:01 INFO   opened, 10 rows wait\n" + case["log"])
    (tmp_path / "dest_schema.sql").write_text(case["ddl"])
    for stem, text in case["files"].items():
        (tmp_path / f"{stem}.csv").write_text(text)
    load = open_load(spark, str(tmp_path))
    found = diagnose_load(spark, load)
    assert case["kind"] in (None, found.kind)
    assert values(found.alerts, "line") == [(case["log"].strip(),)]
    row = repair_load(spark, load, found.kind, F.expr(case["check"])).first()
    assert (row.status, row.appended_rows, row.table_checked_rows) == ("verified", case["rows"], case["checked"])
    if name == "keys":
        assert values(spark.table("l_stays")) == [(51, "Ida", 2.0), (52, "Tom", 0.5), (53, "Ida", 7.0)]
        assert spark.table("l_guests").first().badge == "G-3"
    if name == "renamed in a join":
        assert values(spark.table("l_crews")) == [(1, "Gull", 1200, "A"), (2, "Tern", None, "B"), (3, "Gull", 8, "A")]
        assert column_sources(spark, load)["boat_label"] == ("l_boats", "label")
        assert "label" not in spark.table("l_boats").columns


def test_a_load_without_a_valid_description(spark, tmp_path):
    (tmp_path / "load.json").write_text('{"name": "x"}')
    with pytest.raises(ValueError, match="description"):
        open_load(spark, str(tmp_path))


def join_load(spark, folder, trips, boats):
    case = LOADS["renamed in a join"]
    (folder / "load.json").write_text(json.dumps({
        "name": "j", "source": case["source"], "transform": {"sql": case["sql"].replace("l_crews", "l_crews2")}, "destination": {"engine": "duckdb", "table": "l_crews2"},
    }))
    (folder / "dest_schema.sql").write_text(case["ddl"].replace("l_crews", "l_crews2"))
    (folder / "l_trips.csv").write_text(trips)
    (folder / "l_boats.csv").write_text(boats)
    return open_load(spark, str(folder))


def test_a_join_that_would_lose_values_is_refused(spark, tmp_path):
    load = join_load(spark, tmp_path, "trip,boat,crew\n1,5,few\n2,5,3\n", "boat,boat_label,port\n5,Gull,A\n")
    row = repair_load(spark, load, "type_cast_error").first()
    assert (row.status, row.lost_values, row.appended_rows) == ("refused", 1, 0)
    row = repair_load(spark, load, "type_cast_error", most_lost=1).first()
    assert row.appended_rows == 2


def test_a_join_without_a_sure_source_is_refused(spark, tmp_path):
    load = join_load(spark, tmp_path, "trip,boat,crew\n1,5,2\n", "boat,kind,owner,port\n5,Gull,x,A\n")
    with pytest.raises(ValueError, match="label"):
        repair_load(spark, load, "missing_column")
    assert repair_load(spark, load, "missing_column", defaults={"label": "none"}).first().appended_rows == 1
