import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pipecheck.functions.types import schema_from_ddl, spark_ddl
from pipecheck.session import shared_folder, staging_table
from pipecheck.sources import ddl, logs, sink, specs, tables
from tests.conftest import values


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


def test_file_stem():
    assert tables.file_stem("in/source_data.csv") == "source_data"
    assert tables.file_stem("a.tar.gz") == "a.tar"
    assert tables.file_stem("/x/.hidden") == ".hidden"
    assert tables.file_stem("plain") == "plain"


def test_csv_types_are_inferred(spark, tmp_path):
    path = write(tmp_path, "s.csv", "id,total,day,price\n1,2.5,2031-05-07,7 EUR\n2,,2031-05-09,free\n")
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "int", "total": "double", "day": "date", "price": "string"}
    assert values(df, "total") == [(2.5,), (None,)]


def test_csv_as_text_and_empty_fields(spark, tmp_path):
    path = write(tmp_path, "s.csv", "id,name\n1,\n2,Bob\n")
    df = tables.read_csv(spark, path, infer=False)
    assert set(dict(df.dtypes).values()) == {"string"}
    assert values(df, "name") == [("Bob",), (None,)]
    kept = tables.read_csv(spark, path, infer=False, empty_as_null=False)
    assert values(kept, "name") == [("",), ("Bob",)]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'id,note\n1,"a\nb ""c"""\n2,"d, e"\n')
    assert values(tables.read_csv(spark, path)) == [(1, 'a\nb "c"'), (2, "d, e")]
    plain = write(tmp_path, "p.csv", 'id,note\n1,"a ""b"""\n')
    assert values(tables.read_csv(spark, plain)) == [(1, 'a "b"')]


def test_every_csv_of_a_folder_becomes_a_view(spark, tmp_path):
    write(tmp_path, "left_side.csv", "a\n1\n")
    write(tmp_path, "right_side.csv", "b\n2\n")
    write(tmp_path, "nothing.csv", "")
    write(tmp_path, "other.txt", "c\n3\n")
    found = tables.register_csv_tables(spark, tables.csv_files(spark, str(tmp_path)))
    assert sorted(found) == ["left_side", "right_side"]
    assert values(tables.run_sql(spark, "SELECT a + b AS c FROM left_side, right_side")) == [(3,)]
    write(tmp_path, "left_side.csv", "a\n5\n")
    tables.register_csv_tables(spark, tables.csv_files(spark, str(tmp_path)))
    assert values(spark.table("left_side")) == [(5,)]


@pytest.mark.parametrize("rows, shown, cut", [(49, 49, False), (50, 50, False), (51, 50, True), (0, 0, None)])
def test_preview(spark, rows, shown, cut):
    result = tables.preview(spark.range(rows)).collect()
    assert len(result) == shown
    assert {r.truncated for r in result} == ({cut} if rows else set())


def test_bad_sql_raises(spark):
    with pytest.raises(AnalysisException):
        tables.run_sql(spark, "SELECT * FROM nonexistent_table")


def test_ddl_words():
    assert spark_ddl("id INTEGER, name TEXT, price REAL, code VARCHAR, c2 VARCHAR(10)") == (
        "id INT, name STRING, price DOUBLE, code STRING, c2 STRING"
    )
    assert spark_ddl("id INTEGER PRIMARY KEY, at TIMESTAMP, n DECIMAL(10,2), UNIQUE (at, n)") == (
        "id INT, at TIMESTAMP_NTZ, n DECIMAL(10,2)"
    )
    assert spark_ddl('CREATE TABLE t ("my id" INT8, unique_id CHAR(3))') == "CREATE TABLE t (`my id` BIGINT, unique_id STRING)"
    assert spark_ddl("text TEXT, real REAL NOT NULL") == "text STRING, real DOUBLE NOT NULL"


def test_schema_from_ddl(spark):
    schema = schema_from_ddl("id INTEGER, name TEXT, amount DOUBLE PRECISION, day DATE")
    assert [f.dataType.simpleString() for f in schema] == ["int", "string", "double", "date"]


def test_script_wins_over_single_ddl_and_keeps_tables(spark, tmp_path):
    write(tmp_path, "dest_schema.sql", "CREATE TABLE IF NOT EXISTS only_single (a INTEGER)\n")
    assert ddl.create_destination(spark, str(tmp_path))
    assert spark.table("only_single").dtypes == [("a", "int")]
    write(tmp_path, "schema.sql", "CREATE TABLE IF NOT EXISTS s_one (a TEXT);\nCREATE TABLE IF NOT EXISTS s_two (b REAL);\n")
    assert ddl.create_destination(spark, str(tmp_path))
    assert spark.table("s_two").dtypes == [("b", "double")]
    spark.sql("INSERT INTO s_one VALUES ('x')")
    ddl.create_destination(spark, str(tmp_path))
    assert values(spark.table("s_one")) == [("x",)]
    assert not ddl.create_destination(spark, str(tmp_path / "missing"))


def test_append_goes_by_name_and_counts(spark, frame):
    name = staging_table(spark, "t")
    ddl.create_tables(spark, f"CREATE TABLE {name} (a INTEGER, b TEXT)")
    assert sink.append(frame([("x", 1), ("y", 2)], "b string, a int"), name) == 2
    assert sink.append(frame([], "b string, a int"), name) == 0
    assert values(spark.table(name)) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="no value for"):
        sink.append(frame([(1,)], "a int"), name)
    with pytest.raises(ValueError, match="no place for"):
        sink.append(frame([(1, "x", 2)], "a int, b string, c int"), name)


def test_staging_lives_in_the_shared_folder(spark):
    name = staging_table(spark, "t")
    spark.range(3).write.saveAsTable(name)
    assert shared_folder(spark) in spark.table(name).inputFiles()[0]
    spark.sql(f"DROP TABLE {name}")


def test_log_lines_are_numbered_over_file_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    path = write(tmp_path, "big.log", "\n \n" + "\n".join(lines) + "\n\n")
    short = write(tmp_path, "short.log", "  first\r\nsecond\r\n\r\nlast  \n")
    blank = write(tmp_path, "blank.log", " \n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = logs.read_log_lines(spark, [path, short, blank, str(tmp_path / "no.log")])
        name = F.element_at(F.split("path", "/"), -1).alias("name")
        got = {}
        for row in df.select(name, "line_no", "line").collect():
            got.setdefault(row.name, []).append((row.line_no, row.line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [line for line in lines]
    want[-1] = want[-1].rstrip()
    assert sorted(got["big.log"]) == list(enumerate(want, 1))
    assert sorted(got["short.log"]) == [(1, "first"), (2, "second"), (3, ""), (4, "last")]
    assert "blank.log" not in got


def test_missing_log_is_empty(spark, tmp_path):
    assert logs.read_log_lines(spark, str(tmp_path / "error.log")).count() == 0


def test_split_logs(frame):
    df = frame([("a", "\n x\ny \r\nz\n"), ("b", "  \n"), ("c", None)], "path string, text string")
    assert values(logs.split_logs(df)) == [("a", 1, "x"), ("a", 2, "y "), ("a", 3, "z")]


@pytest.mark.parametrize("split", [None, "64"])
@pytest.mark.parametrize(
    "name, text",
    [
        ("small", "Hello, World!"), ("big", "x" * 3000), ("exact", "y" * 1999 + "\n"), ("one_more", "y" * 2000 + "\n"),
        ("lines", "".join(f"line {i} é\n" for i in range(900))), ("unended", "\n".join("abc" * (i % 50) for i in range(300))),
        ("windows", "a\r\nb\r\n\r\nc"), ("blank", "\n\n\n"), ("old_mac", "a\rb\nc"), ("newlines", "\n" * 2500),
    ],
)
def test_file_preview(spark, tmp_path, name, text, split):
    path = write(tmp_path, f"{name}.txt", text)
    other = write(tmp_path, "other.txt", "z")
    want = text.replace("\r\n", "\n").replace("\r", "\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", split)
    try:
        rows = {r.path.rsplit("/", 1)[1]: r for r in logs.preview_files(spark, [path, other]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    row = rows[f"{name}.txt"]
    assert (row.preview, row.total_chars, row.truncated) == (want[:2000], len(want), len(want) > 2000)
    assert rows["other.txt"].preview == "z"


SPEC = {
    "name": "load", "source": {"type": "multi_table", "tables": ["a", "b"]},
    "destination": {"engine": "duckdb", "table": "t"}, "transform": {"sql": "SELECT 1"},
}


def test_specs_from_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(SPEC, indent=2))
    for i, change in enumerate(
        [{"name": None}, {"destination": {"engine": "oracle", "table": "t"}}, {"transform": {}}, {"source": {"path": "x"}}]
    ):
        (tmp_path / f"bad{i}.json").write_text(json.dumps({**SPEC, **change}))
    df = specs.read_specs(spark, str(tmp_path))
    problems = sorted(r.spec_error or "" for r in df.collect())
    assert problems == ["", "name is missing", "source.type is missing", "transform.sql is missing", "unknown engine"]
    assert values(specs.valid(df), "source.tables") == [(["a", "b"],)]


def test_manifest_and_expected_fixes(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(
        '{"id": "case_01", "name": "n", "difficulty": "easy", "category": "schema", "engine": "duckdb"}\n'
        '{"id": "case_02", "name": "m", "difficulty": "easy", "category": "schema", "engine": "other"}\n'
    )
    assert values(specs.read_manifest(spark, str(tmp_path / "manifest.json")), "id") == [("case_01",)]
    folder = tmp_path / "fixes" / "case_04"
    folder.mkdir(parents=True)
    (folder / "fix.json").write_text(json.dumps({"root_cause": "keys", "expected_row_count_min": 5}))
    df = specs.read_expected_fixes(spark, str(tmp_path / "fixes" / "*"))
    assert values(df, "case_id", "root_cause", "expected_row_count_min") == [("case_04", "keys", 5)]
    (tmp_path / "fixes.json").write_text('{"case_id": "a", "root_cause": "x"}\n{"case_id": "b", "root_cause": "y"}\n')
    lines = specs.read_expected_fixes(spark, str(tmp_path / "fixes.json"), per_line=True)
    assert values(lines, "case_id", "root_cause") == [("a", "x"), ("b", "y")]


def test_empty_files_have_a_preview(spark, tmp_path):
    (tmp_path / "full.txt").write_text("one\ntwo\n")
    (tmp_path / "empty.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.preview, r.total_chars, r.truncated) for r in logs.preview_files(spark, str(tmp_path)).collect()}
    assert got == {"full.txt": ("one\ntwo\n", 8, False), "empty.txt": ("", 0, False)}
