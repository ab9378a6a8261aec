import pytest

from pipecheck.operators import logs
from pipecheck.sources.logs import read_log_lines
from pipecheck.streaming.logs import stream_log_lines, stream_matches, write_available
from tests.conftest import values

SAMPLE = [
    "2031-02-03 04:05:06 WARN   disk nearly full",
    "2031-02-03 04:05:09 DEBUG  opened warehouse",
    "2031-02-03 04:06:00 INFO   table parts: 12 columns",
    "2031-02-03 04:06:30 FATAL  Parser gave up at token 9",
    "2031-02-03 04:06:31 INFO   closing",
    "2031-02-03 04:06:31 WARN   rollback of parts",
    "2031-02-03 04:06:32 ERROR  exit code 3",
]

LINES = "path string, line_no bigint, line string"


@pytest.fixture
def lines(frame):
    return frame([("a.log", i, line) for i, line in enumerate(SAMPLE, 1)], LINES)


def test_default_filter(lines):
    assert values(logs.matching_lines(lines), "line_no") == [(1,), (4,), (6,), (7,)]


@pytest.mark.parametrize("pattern, want", [("Parser", [4]), ("parser GAVE", [4]), (r"^\S+ \S+ info", [3, 5]), ("nothing", [])])
def test_pattern_ignores_case(lines, pattern, want):
    assert values(logs.matching_lines(lines, pattern), "line_no") == [(n,) for n in want]


def test_level_anywhere_but_in_capitals(frame):
    df = frame([("a", 1, "no error"), ("a", 2, "INFO seen ERRORS"), ("a", 3, "FATAL")], LINES)
    assert values(logs.matching_lines(df), "line_no") == [(2,), (3,)]


def test_accents_match_in_any_case(frame):
    df = frame([("a", 1, "ÉCHEC du chargement")], LINES)
    assert logs.matching_lines(df, "échec").count() == 1


def test_first_matches_and_rest(frame):
    rows = [("many", i, f"ERROR {i}") for i in range(1, 26)] + [("few", i, "WARN") for i in range(1, 4)] + [("none", 1, "ok")]
    got = logs.first_matches(frame(rows, LINES)).collect()
    many = sorted(r.line_no for r in got if r.path == "many")
    assert many == list(range(1, 21)) and {r.n_more for r in got if r.path == "many"} == {5}
    assert {r.n_more for r in got if r.path == "few"} == {0}
    assert {r.path for r in got} == {"many", "few"}


def test_status(frame, lines):
    more = lines.unionByName(frame([("b.log", 1, "INFO all good")], LINES))
    paths = frame([("a.log",), ("b.log",), ("c.log",), ("a.log",)], "path string")
    assert values(logs.log_status(paths, more), "path", "n_matches", "status") == [
        ("a.log", 4, "matched"), ("b.log", 0, "no match"), ("c.log", 0, "empty")
    ]


def test_bad_pattern_is_reported(frame, lines, spark):
    assert logs.pattern_error(spark, "a(b|c)+") is None
    got = logs.log_status(frame([("a.log",)], "path string"), lines, "a(").first()
    assert got.status == "bad pattern" and "PATTERN" in got.error


def test_fields(frame):
    df = frame([("a", 1, SAMPLE[1]), ("a", 2, "junk"), ("a", 3, "2031-13-45 04:05:06 INFO   x")], LINES)
    rows = {r.line_no: r for r in logs.parsed_lines(df).collect()}
    assert (rows[1].ts_text, rows[1].level, rows[1].message) == ("2031-02-03 04:05:09", "DEBUG", "opened warehouse")
    assert rows[1].ts.isoformat() == "2031-02-03T04:05:09"
    assert (rows[2].ts, rows[2].level) == (None, "") and rows[3].ts is None


def test_stream_filters_like_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.log").write_text("\n".join(SAMPLE) + "\n")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = stream_matches(stream_log_lines(spark, str(folder)), "error|parser")
        write_available(stream, out, checkpoint).awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    met = [SAMPLE[3], SAMPLE[6]]
    assert run() == met
    (folder / "two.log").write_text("late error\n")
    assert run() == sorted([*met, "late error"])


def test_status_of_files(frame, spark, tmp_path):
    texts = {"bad.log": "2031-01-01 00:00:00 ERROR  no space\n", "fine.log": "2031-01-01 00:00:00 INFO   done\n", "empty.log": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    asked = [str(tmp_path / name) for name in (*texts, "none.log")]
    asked[1] = f"file://{asked[1]}"
    got = logs.log_status(frame([(p,) for p in asked], "path string"), read_log_lines(spark, asked))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in got.collect()} == {
        "bad.log": "matched", "fine.log": "no match", "empty.log": "empty", "none.log": "empty"
    }


def test_line_numbers_do_not_depend_on_the_packing_of_files(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"{n}.log").write_text("".join(f"{n} {k}\n" for k in range(6)))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        try:
            rows = read_log_lines(spark, str(tmp_path))
            spark.conf.set("spark.sql.files.minPartitionNum", "3")
            got = rows.collect()
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert len(got) == 72 and all(r.line.split()[1] == str(r.line_no - 1) for r in got)
