import pytest
from pyspark.sql import functions as F

from pipecheck.functions import text as X
from pipecheck.operators.reports import labelled_calls, parse_reports, tool_calls


@pytest.fixture
def parse(frame):
    def run(text):
        return parse_reports(frame([(1, text)], "id int, text string")).first()

    return run


@pytest.fixture
def column(frame):
    def run(text, make):
        return frame([(text,)], "text string").select(make(F.col("text")).alias("v")).first().v

    return run


INSERT = "INSERT INTO stg (parcel, mass)\nSELECT parcel, gross_mass AS mass\nFROM weighings"


def test_labelled(parse):
    row = parse(
        "Here is what I found:\n\nROOT_CAUSE: Column 'gross_mass' is not 'mass'\nFIX_TYPE: rename\n"
        f"FIX_DESCRIPTION: Use another name\nFIXED_SQL:\n{INSERT}\nVERIFICATION_QUERY:\nSELECT COUNT(*) FROM stg WHERE mass IS NOT NULL"
    )
    assert row.root_cause == "Column 'gross_mass' is not 'mass'"
    assert (row.fix_type, row.fix_description, row.status) == ("rename", "Use another name", "success")
    assert row.fixed_sql == INSERT
    assert row.verification_query == "SELECT COUNT(*) FROM stg WHERE mass IS NOT NULL"


def test_prose_is_its_own_cause(parse):
    text = "The names do not agree. " * 20
    row = parse(text)
    assert row.root_cause == text[:200]
    assert (row.fix_type, row.fixed_sql, row.verification_query) == ("", "", "")


def test_bold_label_and_unlabelled_sql(parse):
    row = parse(f"**Root Cause**: Column 'gross_mass' is absent **\n\n**Fix**:\n```sql\n{INSERT}\n```")
    assert row.root_cause == "Column 'gross_mass' is absent"
    assert row.fixed_sql == INSERT and row.fix_type == "sql_modification" and row.verification_query == ""


def test_prose_label(parse):
    row = parse(f"The root cause is: keys differ.\n\nFIXED_SQL:\n{INSERT}\nVERIFICATION_QUERY:\nSELECT COUNT(*) FROM e")
    assert row.root_cause == "keys differ." and row.fixed_sql == INSERT


def test_tilde_fences(parse):
    row = parse(f"ROOT_CAUSE: cast\nFIXED_SQL:\n~~~sql\n{INSERT}\n~~~\nVERIFICATION_QUERY:\n~~~sql\nSELECT COUNT(*) FROM f\n~~~")
    assert row.fixed_sql == INSERT and row.verification_query == "SELECT COUNT(*) FROM f"


def test_fence_on_the_line_of_the_label(parse):
    row = parse(f"ROOT_CAUSE: x\nFIXED_SQL: ```sql\n{INSERT}\n```\nVERIFICATION_QUERY: ~~~\nSELECT COUNT(*) FROM g\n~~~")
    assert row.fixed_sql == INSERT and row.verification_query == "SELECT COUNT(*) FROM g"


def test_check_after_unlabelled_sql(parse):
    row = parse(f"Alias it:\n\n```sql\nSELECT 1\n```\n```sql\n{INSERT}\n```\n\nVerify with:\n```sql\nSELECT COUNT(*) FROM stg\n```")
    assert row.fixed_sql == INSERT and row.verification_query == "SELECT COUNT(*) FROM stg"


def test_bare_insert(parse):
    row = parse(f"Problem: names\nTry\n{INSERT}\n\nSELECT COUNT(*) FROM stg\n\nDone.")
    assert row.root_cause == "names" and row.fixed_sql == INSERT
    assert row.verification_query == "SELECT COUNT(*) FROM stg"


def test_labels_in_any_case(parse):
    row = parse("root_cause: Column mismatch\nfix_type: cast\nFixed_SQL:\nINSERT INTO t (a) SELECT b FROM s\nVerification_Query:\nSELECT COUNT(*) FROM t")
    assert row.root_cause == "Column mismatch" and row.fix_type == "cast"
    assert row.fixed_sql == "INSERT INTO t (a) SELECT b FROM s" and row.verification_query == "SELECT COUNT(*) FROM t"


def test_empty_answer(parse):
    row = parse("")
    assert (row.root_cause, row.fixed_sql, row.status) == ("", "", "success")


def test_field(column):
    text = "ROOT_CAUSE: Missing column region\nFIX_TYPE: sql_modification"
    assert column(text, lambda t: X.field(t, "ROOT_CAUSE")) == "Missing column region"
    assert column(text, lambda t: X.field(t, "MISSING_FIELD")) == ""
    # White space after the label may hold line breaks: an empty label takes the next line.
    assert column("FIX_TYPE:\nnext: line", lambda t: X.field(t, "FIX_TYPE")) == "next: line"
    assert column("FIX_TYPE: a\rb\nc", lambda t: X.field(t, "FIX_TYPE")) == "a\rb"


def test_first_label_with_a_value_wins(column):
    assert column("**Root Cause**: **\nProblem: keys", X.flexible_field) == "keys"
    assert column("Issue: one\nRoot Cause: two", X.flexible_field) == "two"
    assert column("nothing", X.flexible_field) == ""


def test_block_ends_at_any_label(column):
    assert column("FIXED_SQL:\nSELECT 1\nnote: x", lambda t: X.sql_block(t, "FIXED_SQL")) == "SELECT 1"
    # An empty block takes what follows, as white space after the label may hold line breaks.
    empty = "FIXED_SQL:\n\nNOTE:\nx\nEND: y"
    assert column(empty, lambda t: X.sql_block(t, "FIXED_SQL")) == "NOTE:\nx"


@pytest.mark.parametrize(
    "text, want",
    [
        ("```sql\nSELECT 1\n```", "SELECT 1"), ("~~~sql\nSELECT 1\n~~~", "SELECT 1"), ("```SQL\nSELECT 1\n```", "SELECT 1"),
        ("```\nSELECT 1\n```", "SELECT 1"), ("SELECT 1", "SELECT 1"), ("SELECT 1\n  ~~~ \nFROM t\n```\n```", "SELECT 1\nFROM t"),
        ("SELECT '```' FROM t", "SELECT '```' FROM t"), ("", ""),
    ],
)
def test_strip_fences(column, text, want):
    assert column(text, X.strip_fences) == want


CALLS = {
    1: 'I look first.\nTOOL_CALL: {"tool": "inspect_schema", "args": {"table_name": "a}b", "q": "say \\"x\\" {"}}\nROOT_CAUSE: early',
    2: '{"name": "execute_sql", "arguments": {"query": "SELECT 1", "n": 3}} and more',
    3: '```json\n{"name": "parse_logs", "arguments": {}}\n```',
    4: 'TOOL_CALL: {"tool": "read_file", "args": {"file_path": "x"',
    5: "no call",
    6: '{"name": "", "arguments": {}}',
    7: "TOOL_CALL: nothing here",
    8: "{'name': 'execute_sql'}",
    9: 'TOOL_CALL:\n  {"tool": "t"}',
}


def test_tool_calls(frame):
    df = frame(list(CALLS.items()), "id int, text string")
    rows = {r.id: (r.tool, r.arguments, r.reasoning) for r in tool_calls(df).filter("tool IS NOT NULL").collect()}
    assert rows == {
        1: ("inspect_schema", {"table_name": "a}b", "q": 'say "x" {'}, "I look first."),
        2: ("execute_sql", {"query": "SELECT 1", "n": "3"}, ""),
        3: ("parse_logs", {}, ""),
        9: ("t", {}, ""),
    }


def test_reasoning_before_a_labelled_call(frame):
    df = frame([(i, CALLS[i]) for i in (1, 4, 5)], "id int, text string")
    rows = {r.id: r.reasoning for r in labelled_calls(df).collect()}
    assert rows == {1: "I look first.", 4: CALLS[4], 5: "no call"}


def test_null_answers_and_arguments_that_are_no_object_keep_their_rows(frame):
    df = frame(
        [(1, None), (2, 'TOOL_CALL: {"tool": "run", "args": [1, 2]}'), (3, '{"name": "run", "arguments": "all"}'), (4, "no call")],
        "id int, text string",
    )
    got = {r.id: (r.tool, r.arguments, r.reasoning) for r in tool_calls(df).collect()}
    assert got[1] == (None, None, None) and got[4] == (None, None, "no call")
    assert got[2][:2] == ("run", {"value": "[1,2]"}) and got[3][:2] == ("run", {"value": "all"})
