"""Report fields, SQL blocks and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipecheck.functions import text as X
from pipecheck.operators.reports import bare_calls, labelled_calls, parse_reports, tool_calls
from queries import inputs as I


def report_fields(spark, sf_dir):
    text = F.col("text")
    return I.answers(spark, sf_dir).select(
        "id",
        X.field(text, X.ROOT_CAUSE).alias("root_cause"),
        X.field(text, X.FIX_TYPE).alias("fix_type"),
        X.field(text, X.FIX_DESCRIPTION).alias("fix_description"),
    )


def report_flexible(spark, sf_dir):
    text = F.col("text")
    return I.answers(spark, sf_dir).select("id", X.flexible_field(text).alias("root_cause"))


def report_sql(spark, sf_dir):
    text = F.col("text")
    return I.answers(spark, sf_dir).select(
        "id",
        X.sql_block(text, X.FIXED_SQL).alias("fixed_sql"),
        X.sql_block(text, X.VERIFICATION_QUERY).alias("verification_query"),
    )


def report_fallback(spark, sf_dir):
    text = F.col("text")
    found = I.answers(spark, sf_dir).withColumn("fixed_sql", X.unlabelled_sql(text))
    check = X.unlabelled_check(text, F.col("fixed_sql"))
    return found.select("id", "fixed_sql", F.when(F.col("fixed_sql") != "", check).otherwise("").alias("check_query"))


def strip_fences(spark, sf_dir):
    """Whole documents as fenced blocks, with a stray fence line inside."""
    documents = I.texts(spark, sf_dir, "documents", "doc_id")
    fenced = F.concat(F.lit("```sql\n"), F.col("text"), F.lit("\n~~~\nSELECT "), F.col("doc_id").cast("string"), F.lit("\n```\n"))
    return documents.select("doc_id", F.md5(X.strip_fences(fenced)).alias("digest"))


def report_all(spark, sf_dir):
    return parse_reports(I.answers(spark, sf_dir)).drop("text")


def report_documents(spark, sf_dir):
    """Long free texts: none holds a report, so each is its own cause."""
    return parse_reports(I.texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")).drop("text")


def all_tool_calls(spark, sf_dir):
    found = tool_calls(I.calls(spark, sf_dir))
    return found.filter(F.col("tool").isNotNull()).select(
        "id", "tool", F.to_json("arguments").alias("arguments"), "reasoning"
    )


def labelled_tool_calls(spark, sf_dir):
    args = F.col("arguments")
    return labelled_calls(I.calls(spark, sf_dir)).select(
        "id", "tool", args["table_name"].alias("table_name"), args["engine"].alias("engine")
    )


def bare_tool_calls(spark, sf_dir):
    args = F.col("arguments")
    return bare_calls(I.calls(spark, sf_dir)).select(
        "id", "tool", args["query"].alias("query"), args["pattern"].alias("pattern")
    )


def text_before_call(spark, sf_dir):
    return labelled_calls(I.calls(spark, sf_dir)).select("id", "reasoning")


# The SQL checks read the fields back from the columns an answer was built from.
E = "event_id"
NL = "chr(10)"
CAUSE = """CASE event_id % 6 WHEN 0 THEN concat('Column ', event_type, ' of user ', user_id, ' differs')
  WHEN 3 THEN concat('mismatch in ', event_type) ELSE '' END"""
LOOSE_CAUSE = """CASE event_id % 6 WHEN 1 THEN concat('Column ', event_type, ' is absent')
  WHEN 2 THEN concat('keys of ', user_id, ' differ.') WHEN 5 THEN concat('dates of ', event_type) ELSE '' END"""
FIX_TYPE = "CASE event_id % 6 WHEN 0 THEN 'rename' WHEN 3 THEN concat('cast_', user_id) ELSE '' END"
DESCRIPTION = "CASE event_id % 6 WHEN 0 THEN concat('Use column c', user_id) ELSE '' END"
FIXED = f"""CASE event_id % 6 WHEN 0 THEN concat('INSERT INTO t (a)', {NL}, 'SELECT b', {E}, ' FROM s')
  WHEN 2 THEN concat('INSERT INTO u (a)', {NL}, 'SELECT d', {E}, ' FROM s')
  WHEN 3 THEN concat('INSERT INTO v (a) SELECT e', {E}, ' FROM s') ELSE '' END"""
CHECK = f"""CASE event_id % 6 WHEN 0 THEN concat('SELECT COUNT(*) FROM t WHERE a = ', {E})
  WHEN 2 THEN concat('SELECT COUNT(*) FROM u', user_id) WHEN 3 THEN 'SELECT COUNT(*) FROM v' ELSE '' END"""
LOOSE_FIXED = f"""CASE event_id % 6 WHEN 1 THEN concat('INSERT INTO t (a)', {NL}, 'SELECT c', user_id, {NL}, 'FROM s')
  WHEN 5 THEN concat('INSERT INTO w (a, b)', {NL}, 'SELECT f', {E}, ', g FROM s') ELSE '' END"""
LOOSE_CHECK = f"""CASE event_id % 6 WHEN 1 THEN concat('SELECT COUNT(*) FROM t', {E})
  WHEN 5 THEN concat('SELECT COUNT(*) FROM w WHERE b = ', user_id) ELSE '' END"""

LABEL = "(?:\\n|$)"


def _field_sql(label: str) -> str:
    return f"trim(regexp_extract(text, '(?i){label}:\\s*(.+?){LABEL}', 1))"


def _block_sql(label: str) -> str:
    return f"""CASE WHEN regexp_matches(text, '(?is){label}:\\s*\\n')
        THEN regexp_replace(regexp_replace(regexp_extract(text, '(?is){label}:\\s*\\n(.*?)(?:\\n[A-Z_]+:|$)', 1), '^~~~\\w*\\s*\\n?', ''), '\\n?~~~\\s*$', '')
        ELSE '' END"""


ANSWERS = f"a AS ({I.ANSWERS_SQL})"
REPORT_ALL_SQL = f"""
WITH f AS (SELECT event_id AS id, {CAUSE} AS c0, {LOOSE_CAUSE} AS c1, {FIX_TYPE} AS t0, {DESCRIPTION} AS fix_description,
  {FIXED} AS s0, {LOOSE_FIXED} AS s1, {CHECK} AS q0, {LOOSE_CHECK} AS q1 FROM events), {ANSWERS}
SELECT id, 'success' AS status,
  CASE WHEN id % 6 = 4 THEN substr(text, 1, 200) WHEN c0 <> '' THEN c0 ELSE c1 END AS root_cause,
  CASE WHEN id % 6 = 4 THEN '' WHEN t0 <> '' THEN t0 ELSE 'sql_modification' END AS fix_type, fix_description,
  CASE WHEN s0 <> '' THEN s0 ELSE s1 END AS fixed_sql, CASE WHEN q0 <> '' THEN q0 ELSE q1 END AS verification_query
FROM f JOIN a USING (id)"""

# What would give a document a field of a report: with any of it, the check below must fail and not agree by chance.
ANY_LABEL = "(?i)(root_cause|fix_type|fix_description|fixed_sql|verification_query|root\\s*cause|issue|problem)\\**\\s*:|insert\\s+into"

QUERIES = {
    "report_fields": (
        report_fields,
        f"""WITH {ANSWERS} SELECT id, {_field_sql('ROOT_CAUSE')} AS root_cause, {_field_sql('FIX_TYPE')} AS fix_type,
            {_field_sql('FIX_DESCRIPTION')} AS fix_description FROM a""",
    ),
    "report_flexible": (
        report_flexible,
        f"SELECT event_id AS id, {LOOSE_CAUSE} AS root_cause FROM events",
    ),
    "report_sql": (
        report_sql,
        f"WITH {ANSWERS} SELECT id, {_block_sql('FIXED_SQL')} AS fixed_sql, {_block_sql('VERIFICATION_QUERY')} AS verification_query FROM a",
    ),
    "report_fallback": (
        report_fallback,
        f"""SELECT event_id AS id,
            CASE event_id % 6 WHEN 0 THEN {FIXED} WHEN 2 THEN {FIXED} ELSE {LOOSE_FIXED} END AS fixed_sql,
            CASE event_id % 6 WHEN 0 THEN {CHECK} WHEN 2 THEN concat({CHECK}) ELSE {LOOSE_CHECK} END AS check_query FROM events""",
    ),
    "strip_fences": (
        strip_fences,
        """SELECT doc_id, md5(concat(regexp_replace(text, '^\\s+', ''), chr(10), 'SELECT ', doc_id)) AS digest FROM documents""",
    ),
    "report_all": (report_all, REPORT_ALL_SQL),
    "report_documents": (
        report_documents,
        f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{ANY_LABEL}') THEN 'has a label' ELSE 'success' END AS status,
            substr(text, 1, 200) AS root_cause, '' AS fix_type, '' AS fix_description, '' AS fixed_sql, '' AS verification_query FROM documents""",
    ),
    "tool_calls": (
        all_tool_calls,
        """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'inspect_schema' WHEN 1 THEN 'execute_sql' ELSE 'parse_logs' END AS tool,
           CASE event_id % 5 WHEN 0 THEN concat('{"table_name":"t{', user_id, '}","engine":"duckdb"}')
             WHEN 1 THEN concat('{"query":"SELECT ', event_id, '","engine":"sqlite"}')
             ELSE concat('{"pattern":"', event_type, '"}') END AS arguments,
           CASE event_id % 5 WHEN 0 THEN concat('I look at ', event_type, ' first.') ELSE '' END AS reasoning
           FROM events WHERE event_id % 5 < 3""",
    ),
    "labelled_tool_calls": (
        labelled_tool_calls,
        f"""WITH a AS ({I.CALLS_SQL}), j AS (SELECT id, CASE WHEN id % 5 = 0 THEN regexp_extract(text, 'TOOL_CALL: (.*)', 1) END AS j FROM a)
            SELECT id, json_extract_string(j, '$.tool') AS tool, json_extract_string(j, '$.args.table_name') AS table_name,
            json_extract_string(j, '$.args.engine') AS engine FROM j""",
    ),
    "bare_tool_calls": (
        bare_tool_calls,
        """SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN 'execute_sql' WHEN 2 THEN 'parse_logs' END AS tool,
           CASE event_id % 5 WHEN 1 THEN concat('SELECT ', event_id) END AS query,
           CASE event_id % 5 WHEN 2 THEN event_type END AS pattern FROM events""",
    ),
    "text_before_call": (
        text_before_call,
        f"WITH a AS ({I.CALLS_SQL}) SELECT id, CASE WHEN id % 5 = 0 THEN trim(string_split(text, chr(10))[1]) ELSE text END AS reasoning FROM a",
    ),
}
