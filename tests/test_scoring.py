import random

import pytest
from pyspark.sql import functions as F

from pipecheck.functions import terms as TS
from pipecheck.operators import scoring
from pipecheck.plans.evaluate import evaluate
from tests.conftest import values


@pytest.fixture
def matches(frame):
    def run(predicted, expected, threshold=0.5):
        df = frame([(predicted, expected)], "p string, e string")
        return df.select(TS.cause_matches(F.col("p"), F.col("e"), threshold)).first()[0]

    return run


@pytest.mark.parametrize(
    "predicted, expected, want",
    [
        ("Column name mismatch: total_amount vs amount", "Column name mismatch: load references total_amount but table has amount", True),
        ("Missing column region in source data", "Missing column 'region' in source CSV data", True),
        ("Database connection timeout", "Column name mismatch", False),
        ("", "something", False), ("something", "", False), (None, "something", False), ("something", None, False),
        ("anything", "the a is", False), ("alpha", "alpha beta", True), ("alpha", "alpha beta gamma", False),
    ],
)
def test_cause(matches, predicted, expected, want):
    assert matches(predicted, expected) is want


def test_terms(frame):
    df = frame([("Column name mismatch: 'total_amount' vs the X amount, Amount é9 a1",)], "t string")
    got = df.select(TS.term_set(F.col("t"))).first()[0]
    assert sorted(got) == ["a1", "amount", "column", "mismatch", "name", "total_amount", "vs"]
    assert len(TS.STOP_WORDS) == len(set(TS.STOP_WORDS)) == 56


def test_ratio_and_differences(frame):
    df = frame([(["b", "a", "z"], ["a", "c", "b", "d"])], "have array<string>, want array<string>")
    have, want = F.col("have"), F.col("want")
    row = df.select(
        TS.overlap_ratio(have, want), TS.precision(have, want), TS.matched_terms(have, want), TS.missing_terms(have, want)
    ).first()
    assert tuple(row) == (0.5, pytest.approx(2 / 3), ["a", "b"], ["c", "d"])


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7, 1.0])
def test_match_all_against_brute_force(frame, threshold):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)]
    # Word 0 is in nearly every text; a third of the texts are copies.
    texts = {i: set(random.choices(vocabulary, k=random.randint(0, 25))) | ({"w0"} if i % 9 else set()) for i in range(120)}
    texts.update({i: texts[1] for i in range(120, 180)})
    wanted = {j: set(random.choices(vocabulary, k=random.randint(0, 9))) for j in range(30)}
    wanted[30] = {"w0"}
    p = frame([(i, " ".join(sorted(t))) for i, t in texts.items()], "pid int, text string")
    e = frame([(j, " ".join(sorted(t))) for j, t in wanted.items()], "eid int, text string")
    got = {(r.pid, r.eid): r.ratio for r in scoring.match_all(p, e, "pid", "eid", threshold=threshold).collect()}
    want = {
        (i, j): round(len(t & w) / len(w), 6)
        for i, t in texts.items() for j, w in wanted.items()
        if w and len(t & w) / len(w) >= threshold
    }
    assert got == pytest.approx(want)


def test_match_all_needs_a_threshold(frame):
    df = frame([(1, "a")], "id int, text string")
    with pytest.raises(ValueError):
        scoring.match_all(df, df.withColumnRenamed("id", "e"), "id", "e", threshold=0)


REPORTS = "case_id string, model string, status string, root_cause string, fixed_sql string, verification_query string, steps_taken int, time_seconds double, error string"
EXPECTED = "case_id string, case_name string, root_cause string, verification_query string, expected_row_count_min long"
CHECKS = "case_id string, model string, fix_error string, check_error string, cnt long"


@pytest.fixture
def results(frame):
    def run(reports, expected, checks):
        df = scoring.case_results(frame(reports, REPORTS), frame(expected, EXPECTED), frame(checks, CHECKS))
        return {r.case_id: r for r in scoring.case_labels(df).collect()}

    return run


def test_case_results(results):
    ok = ("success", "missing column region", "INSERT", "", 1, 2.0, None)
    reports = [(f"c{i}", "m", *ok) for i in range(1, 6)]
    reports += [
        ("c6", "m", "success", "missing column region", "INSERT", "SELECT own", 1, 2.0, ""),
        ("c7", "m", "success", "something else", "", "", 1, 2.0, ""),
        ("c8", "m", "max_steps_reached", "", "INSERT", "", 15, 9.0, ""),
        ("c9", "m", *ok[:-1], "timed out"), ("c10", "m", *ok), ("c11", "m", *ok),
    ]
    expected = [(f"c{i}", f"name {i}", "Missing column 'region'", "SELECT expected", 5 if i == 4 else None) for i in range(1, 10)]
    expected.append(("c11", "n", "Missing column 'region'", None, None))
    checks = [
        ("c1", "m", None, None, 3), ("c2", "m", None, None, 0), ("c3", "m", "syntax", None, 3), ("c4", "m", None, None, 4),
        ("c5", "m", None, "no table", None), ("c6", "m", None, None, 1), ("c7", "m", None, None, 3), ("c8", "m", None, None, 3),
        ("c9", "m", None, None, 3), ("c10", "m", None, None, 3), ("c11", "m", None, None, None),
    ]
    rows = results(reports, expected, checks)
    assert {k for k, r in rows.items() if r.fix_valid} == {"c1", "c6", "c11"}
    assert {k for k, r in rows.items() if not r.root_cause_match} == {"c7", "c8", "c9", "c10"}
    assert rows["c6"].check_query == "SELECT own" and rows["c1"].check_query == "SELECT expected" and rows["c11"].check_query == ""
    assert (rows["c9"].error, rows["c9"].steps_taken, rows["c9"].fix_label) == ("timed out", 0, "ERR")
    assert rows["c10"].error == "no expected fix" and rows["c10"].root_cause_label == "ERR"
    assert (rows["c2"].root_cause_label, rows["c2"].fix_label) == ("PASS", "FAIL")


RESULT = "case_id string, model string, root_cause_match boolean, fix_valid boolean, steps_taken int, time_seconds double"


def test_means(frame):
    df = frame([("a", "m", True, True, 1, 10.0), ("b", "m", True, False, 2, 20.0), ("c", "n", False, False, 0, 1.0)], RESULT)
    assert values(scoring.eval_means(df, "model")) == [("m", 1.0, 0.5, 1.5, 15.0, 2, 1, 2), ("n", 0.0, 0.0, 0.0, 1.0, 0, 0, 1)]
    assert values(scoring.eval_means(frame([], RESULT))) == [(0.0, 0.0, 0.0, 0.0, 0, 0, 0)]


def test_case_filter(frame):
    df = frame([("case_01_a",), ("case_02_b",), ("case_1",)], "id string")
    assert values(scoring.filter_cases(df, "case_0")) == [("case_01_a",), ("case_02_b",)]
    assert scoring.filter_cases(df).count() == 3 and scoring.filter_cases(df, "x").count() == 0


def test_available_cases(frame):
    df = frame([("case_01_a",), ("case_02_b",), ("case_02_b",), (None,)], "id string")
    assert values(scoring.available_cases(df, "x")) == [("case_01_a",), ("case_02_b",)]
    assert scoring.available_cases(df, "case_0").count() == scoring.available_cases(df).count() == 0
    assert scoring.available_cases(df.limit(0), "x").count() == 0
    assert values(scoring.available_cases(df.withColumnRenamed("id", "case_id"), "case_1", "case_id")) == [("case_01_a",), ("case_02_b",)]


def test_iterations(frame):
    df = frame([("m", 0, 0.25, 0.25), ("m", 1, 0.5, 0.5), ("m", 2, 0.75, 0.5), ("n", 0, 1.0, 1.0)],
               "model string, iteration int, diagnosis_accuracy double, fix_accuracy double")
    got = values(scoring.iteration_delta(df), "model", "iteration", "diagnosis_delta", "fix_delta")
    assert got == [("m", 0, None, None), ("m", 1, 0.25, 0.25), ("m", 2, 0.25, 0.0), ("n", 0, None, None)]


def test_evaluate_answers(frame):
    answers = frame(
        [("case_01", "m", "ROOT_CAUSE: missing column region\nFIXED_SQL:\nINSERT INTO t SELECT 1\n", 1, 3.0, ""),
         ("case_02", "m", "no idea", 2, 5.0, "")],
        "case_id string, model string, text string, steps_taken int, time_seconds double, error string",
    )
    expected = frame([("case_01", "a", "Missing column 'region'", "q", None), ("case_02", "b", "Keys differ", "q", None)], EXPECTED)
    checks = frame([("case_01", "m", None, None, 4)], CHECKS)
    result = evaluate(answers, expected, checks)
    assert values(result.means, "diagnosis_accuracy", "fix_accuracy", "mean_steps", "n_cases") == [(0.5, 0.5, 1.5, 2)]
    assert values(evaluate(answers, expected, checks, "case_02").results, "case_id", "fix_label") == [("case_02", "FAIL")]
