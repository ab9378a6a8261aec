"""CSV files cut into records block by block, and the types of many files at once."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pipecheck.sources import csv_records as c
from pipecheck.sources import tables
from tests.conftest import values


@pytest.fixture
def blocks(spark):
    """Files are cut every so many bytes."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def text_of(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def noise(rng, n):
    parts = ["x", ",", '"', "\n", "\r\n", " ", "é", '""', "1", "\n\n", "long " * 30]
    return [("id", "note", "more"), *((str(k), "".join(rng.choices(parts, k=rng.randrange(6))), rng.choice(["", "a", "b\nc"])) for k in range(n))]


@pytest.mark.parametrize("size", [40, 173, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_against_a_reader_of_whole_files(spark, blocks, tmp_path, size, end):
    rng = random.Random(size)
    wanted = []
    for n in range(3):
        text = text_of(noise(rng, 60), end)
        (tmp_path / f"f{n}.csv").write_text(text, newline="")
        wanted += [tuple(r) for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    blocks(size)
    records = c.csv_records(spark, str(tmp_path))
    assert records.filter("first").count() == 3
    got = [tuple(next(csv.reader(io.StringIO(r.record, newline="")))) for r in records.filter("not first").collect()]
    assert sorted(got) == sorted(wanted)


def test_a_file_of_several_blocks_is_read_by_several_tasks(spark, blocks, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text(text_of([("id", "note"), *((str(k), f"line {k}\nnext") for k in range(500))]), newline="")
    blocks(1000)
    lines = c.csv_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() >= 8
    states = c.block_states(lines)
    assert states.count() >= 8 and 0 < states.filter("inside = 1").count()
    plan = c.csv_records(spark, str(path), lines, states)._jdf.queryExecution().toString()
    assert "multiLine" not in plan
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "int", "note": "string"}
    assert sorted(values(df)) == sorted((k, f"line {k}\nnext") for k in range(500))


def test_a_record_over_many_blocks_and_an_open_quote(spark, blocks, tmp_path):
    long = "\n".join(f"row {k}" for k in range(200))
    (tmp_path / "a.csv").write_text(f'id,note\n1,"{long}"\n2,b\n3,"never closed\n4,d\n', newline="")
    blocks(64)
    records = [r.record for r in c.csv_records(spark, str(tmp_path)).collect()]
    assert sorted(records) == sorted(["id,note", f'1,"{long}"', "2,b", '3,"never closed\n4,d'])


def test_empty_files_and_empty_lines(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "some.csv").write_text("\n\na,b\n\n1,2\n \n")
    rows = c.csv_records(spark, str(tmp_path)).collect()
    assert [(r.first, r.record) for r in sorted(rows, key=lambda r: not r.first)] == [(True, "a,b"), (False, "1,2")]


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        tables.read_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match="headers"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), schema="b int, a int")


@pytest.mark.parametrize(
    "texts, kind",
    [
        (["1", "-7", None], "int"), (["1", "3000000000"], "bigint"), (["1", "2.5"], "double"), (["3000000000", "1e3"], "double"), (["2031-01-02", None], "date"),
        (["2031-01-02", "2031-01-02 03:04:05"], "timestamp"), (["true", "FALSE"], "boolean"), (["1", "true"], "string"), (["1", "x"], "string"),
        (["2031-01-02", "5"], "string"), (["2031-13-45"], "string"), ([None, None], "string"), (["99999999999999999999"], "double"), (["1f"], "string"),
    ],
)
def test_types(frame, texts, kind):
    rows = [("f", True, 'k,"v,""w"""')] + [("f", False, f"1,{'' if t is None else t}") for t in texts]
    got = {r.column_name: r for r in c.file_schemas(frame(rows, "path string, first boolean, record string")).collect()}
    assert set(got) == {"k", 'v,"w"'} and got['v,"w"'].data_type == kind
    assert (got['v,"w"'].n_rows, got['v,"w"'].n_null) == (len(texts), texts.count(None))


def test_fields_against_a_csv_reader(frame):
    rng = random.Random(3)
    rows = [["".join(rng.choices(["a", ",", '"', "\n", "", " "], k=4)) for _ in range(rng.randrange(1, 6))] for _ in range(200)]
    texts = [text_of([r]).removesuffix("\n") for r in rows]
    got = frame(list(enumerate(texts)), "n int, record string").select("n", c.fields(F.col("record")).alias("f")).collect()
    assert all([v or "" for v in r.f] == rows[r.n] for r in got)


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "left.csv").write_text("a,b\n1,2031-04-05\n2,\n")
    (tmp_path / "right part.csv").write_text('a,note\n1,"x\ny"\n3,z\n')
    (tmp_path / "ignored.txt").write_text("c\n1\n")
    rows = values(tables.folder_schemas(spark, str(tmp_path)))
    assert rows == [("left", 1, "a", "int", 2, 0), ("left", 2, "b", "date", 2, 1), ("right part", 1, "a", "int", 2, 0), ("right part", 2, "note", "string", 2, 0)]
    found = tables.register_csv_folder(spark, str(tmp_path))
    assert values(found["right part"]) == [(1, "x\ny"), (3, "z")]
    assert values(spark.sql("SELECT l.a, note FROM left l JOIN `right part` r ON l.a = r.a")) == [(1, "x\ny")]
