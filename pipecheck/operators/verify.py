"""Check a repair before and after it is appended."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.operators.align import align_to_schema
from pipecheck.session import shared_path, staging_table, written
from pipecheck.sources.sink import append

# Outcomes of a check.
VERIFIED = "verified"
FAILED = "failed"
UNVERIFIED = "unverified"
ERROR = "error"
REFUSED = "refused"

# Column of a repaired frame with the number of values that its casts lose in a row.
LOST = "_lost_values"

# Fixed value: INSERT text with a SELECT; parts are table, columns, query.
INSERT = re.compile(r"^\s*INSERT\s+INTO\s+(?:TABLE\s+)?([\w.`]+)\s*(?:\(([^)]*)\))?\s*((?:SELECT|WITH)\b.*)$", re.IGNORECASE | re.DOTALL)

# Fixed value: functions that call any Java method from a query.
CALLS = re.compile(r"\b(?:java_method|reflect|try_reflect)\s*\(", re.IGNORECASE)

# Texts and quoted names in SQL, and comments; names in back-ticks are not among them.
QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|--[^\n]*|/\*.*?\*/"

TEXTS = ["fixed_sql", "verification_query"]
OUTCOMES = "pair string, fix_error string, check_error string, cnt bigint"

# So many repairs run at the same time, and outcomes of so many go to the shared folder as one file.
AT_ONCE = 8
OUTCOME_ROWS = 100

APPLIED = (
    "status string, staged_rows bigint, checked_rows bigint, lost_values bigint, appended_rows bigint, "
    "table_checked_rows bigint, error string"
)


def count_holds(count: Column, min_rows: Column) -> Column:
    """A count passes when it is not 0 and reaches the minimum, if there is one."""
    return (count > 0) & (min_rows.isNull() | (count >= min_rows))


def _verdict(counted: DataFrame, min_rows: int | None) -> DataFrame:
    wanted = F.lit(min_rows).cast("bigint")
    return counted.select("cnt", wanted.alias("min_rows")).withColumn(
        "ok", F.coalesce(count_holds(F.col("cnt"), F.col("min_rows")), F.lit(False))
    )


def verify(df: DataFrame, check: Column | None = None, min_rows: int | None = None) -> DataFrame:
    """Rows for which the check holds, as one row (cnt, min_rows, ok)."""
    checked = df if check is None else df.filter(check)
    return _verdict(checked.agg(F.count(F.lit(1)).alias("cnt")), min_rows)


def first_count(result: DataFrame) -> int | None:
    """Count in the first column of a check's result: 0 without rows, None if it is no integer."""
    if not isinstance(result.schema[0].dataType, T.IntegralType):
        return None
    row = result.select(F.col(f"`{result.columns[0]}`").cast("bigint")).first()
    return 0 if row is None else row[0]


def select_only(spark: SparkSession, text: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """The result of a text that must be one SELECT; ``names`` puts other tables in the place of names.

    The text is read as a subquery, where Spark's grammar takes a query and no command, so nothing but a SELECT can run. Names
    are common table expressions in front of it: they hide tables and views of that name, and no letter of the text is
    changed for them, nor anything of the session. Functions that call Java methods are refused.
    """
    text = re.sub(rf"({QUOTED})|;(?:\s|--[^\n]*|/\*.*?\*/)*\Z", lambda m: m.group(1) or "", text, flags=re.DOTALL)
    if CALLS.search(re.sub(QUOTED, " ", text, flags=re.DOTALL)):
        raise ValueError("a check may not call Java methods")
    heads = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM {table})" for name, table in (names or {}).items())
    return spark.sql(f"{'WITH ' + heads if heads else ''} SELECT * FROM (\n{text}\n)")


def verify_query(spark: SparkSession, query: str, min_rows: int | None = None) -> tuple[str, int | None]:
    """Outcome and count of a check given as one SELECT; no text means unverified, any other statement is an error and is not run."""
    if not query.strip():
        return UNVERIFIED, None
    try:
        count = first_count(select_only(spark, query))
    except (PySparkException, ValueError):
        return ERROR, None
    if count is None:
        return UNVERIFIED, None
    passed = count > 0 and (min_rows is None or count >= min_rows)
    return (VERIFIED if passed else FAILED), count


def apply_repair(
    repaired: DataFrame,
    table: str,
    check: Column | None = None,
    min_rows: int | None = None,
    most_lost: int = 0,
) -> DataFrame:
    """Dry run, append and check again; one row that says what happened.

    A repair that loses more than ``most_lost`` values (the sum of the column LOST, where
    there is one) is refused: nothing is appended.

    The repaired frame is computed once, into a staging table. The check runs on
    that, and only when it passes are the staged rows appended. Without a check
    the rows are appended and the outcome is ``unverified``. A repair that fails
    to compute leaves the destination as it was.
    """
    spark = repaired.sparkSession
    staged = staging_table(spark, "repair")
    status, error = FAILED, None
    staged_rows = checked = lost = after = None
    appended = 0
    try:
        repaired.write.format("parquet").saveAsTable(staged)
        frame = spark.table(staged)
        staged_rows = frame.count()  # from the files' footers
        if LOST in frame.columns:
            lost = frame.agg(F.coalesce(F.sum(LOST), F.lit(0))).first()[0]
            frame = frame.drop(LOST)
        verdict = verify(frame, check, min_rows).first()
        checked = verdict.cnt
        if lost and lost > most_lost:
            status = REFUSED
        elif check is None and min_rows is None:
            appended, status = append(frame, table), UNVERIFIED
        elif verdict.ok:
            appended = append(frame, table)
            final = verify(spark.table(table), check, min_rows).first()
            after, status = final.cnt, VERIFIED if final.ok else FAILED
    except (PySparkException, ValueError) as problem:
        status, error = ERROR, str(problem)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    row = (status, staged_rows, checked, lost, appended, after, error)
    return spark.createDataFrame([row], APPLIED)


def unqualified(text: str, database: str, table: str) -> str:
    """A text with the qualified name of one table cut to the table: ``db.t`` and ``spark_catalog.db.t`` become ``t``.

    Quoted texts and comments stay as they are.
    """
    word = r"(?:`{0}`|\b{0}\b)"
    name = rf"(?:{word.format('spark_catalog')}\s*\.\s*)?{word.format(re.escape(database))}\s*\.\s*({word.format(re.escape(table))})"
    return re.sub(f"(?is){QUOTED}|(?<![.`\\w]){name}", lambda m: m.group(1) or m.group(0), text)


def insert_rows(spark: SparkSession, text: str, dest: T.StructType, into: str, names: Mapping[str, str] | None = None) -> int:
    """Append the rows of INSERT ... SELECT text to the table ``into`` of schema ``dest``, whatever table the text names; their number.

    Columns go by the names in the text, or by position without them; those it does not name become NULL. The SELECT is
    read by ``select_only``.
    """
    found = INSERT.match(text.strip().rstrip(";"))
    if not found:
        raise ValueError("no INSERT with a SELECT")
    _, listed, query = found.groups()
    columns = [c.strip().strip('`"') for c in listed.split(",")] if listed else dest.names
    result = select_only(spark, query, names)
    if len(result.columns) != len(columns):
        raise ValueError(f"{len(result.columns)} values for {len(columns)} columns")
    unnamed = {f.name: None for f in dest if f.name not in columns}
    return append(align_to_schema(result.toDF(*columns), dest, defaults=unnamed), into)


def run_insert(spark: SparkSession, text: str) -> int:
    """Run INSERT ... SELECT text on the table that it names and return the number of rows it adds."""
    found = INSERT.match(text.strip().rstrip(";"))
    if not found:
        raise ValueError("no INSERT with a SELECT")
    table = found.group(1)
    return insert_rows(spark, text, spark.table(table).schema, table)


def score_fixes(
    spark: SparkSession, reports: DataFrame, table: str, dest: T.StructType, at_once: int = AT_ONCE, outcomes: str | None = None
) -> DataFrame:
    """Run the repair and the check of each report; the rows that ``case_results`` takes.

    ``reports(case_id, model, fixed_sql, verification_query)``. Each repair fills an empty table of its own in place of ``table``,
    which stays as it is; its check reads that one. A failure keeps its text. Only SELECTs run: what a text calls the destination is a
    name in front of it, so repairs do not see each other and ``at_once`` of them run at the same time.

    Equal pairs of texts run once, and their outcome goes to all reports that have them. Pairs come to the driver a partition at a time, at most
    twice ``at_once`` wait for a place. Outcomes are written as they come, under a hash of their texts: with ``outcomes``, a folder that the
    caller keeps, a later call goes on where a lost driver stopped. Neither reports nor inserted rows are collected.
    """
    path = outcomes or shared_path(spark, "fix-outcomes")
    spark.createDataFrame([], OUTCOMES).write.mode("append").parquet(path)
    hashed = F.sha2(F.concat_ws("\n", *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in TEXTS)), 256)
    rows = written(reports.select("case_id", "model", *TEXTS, hashed.alias("pair")), "fix-reports")
    done = written(spark.read.schema(OUTCOMES).parquet(path).select("pair"), "fixes-done")
    open_ = written(rows.select("pair", *TEXTS).dropDuplicates(["pair"]).join(done, "pair", "left_anti"), "fix-texts")

    def outcome(pair: Row) -> tuple:
        return (pair.pair, *_fix_outcome(spark, pair.fixed_sql, pair.verification_query, table, dest))

    batch = []
    with ThreadPoolExecutor(at_once) as pool:
        for row in _as_they_end(pool, (lambda pair=pair: outcome(pair) for pair in open_.toLocalIterator()), 2 * at_once):
            batch.append(row)
            if len(batch) == OUTCOME_ROWS:
                spark.createDataFrame(batch, OUTCOMES).coalesce(1).write.mode("append").parquet(path)
                batch = []
    if batch:
        spark.createDataFrame(batch, OUTCOMES).coalesce(1).write.mode("append").parquet(path)
    # A pair that two drivers ran at the same time has two outcomes.
    found = spark.read.schema(OUTCOMES).parquet(path).dropDuplicates(["pair"])
    return rows.join(found, "pair").select("case_id", "model", "fix_error", "check_error", "cnt")


def _as_they_end(pool: ThreadPoolExecutor, calls: Iterator[Callable[[], tuple]], waiting: int) -> Iterator[tuple]:
    """Results of calls in a pool, as they end; never more than ``waiting`` calls are under way."""
    running: set[Future] = set()
    for call in calls:
        running.add(pool.submit(call))
        if len(running) >= waiting:
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in ended)
    yield from (f.result() for f in running)


def _first_line(problem: Exception) -> str:
    return next((line for line in str(problem).splitlines() if line.strip()), type(problem).__name__)


def _fix_outcome(spark: SparkSession, fix: str | None, check: str | None, table: str, dest: T.StructType) -> tuple[str | None, str | None, int | None]:
    """fix_error, check_error, cnt of one repair and its check."""
    staged = staging_table(spark, "fix")
    fix_error = check_error = count = None
    *qualifier, name = table.replace("`", "").split(".")
    database = qualifier[-1] if qualifier else spark.catalog.currentDatabase()
    fix, check = (unqualified(text or "", database, name) for text in (fix, check))
    try:
        spark.createDataFrame([], dest).write.format("parquet").saveAsTable(staged)
        try:
            insert_rows(spark, fix, dest, staged, {name: staged})
        except (PySparkException, ValueError) as problem:
            fix_error = _first_line(problem)
        if fix_error is None and check.strip():
            try:
                count = first_count(select_only(spark, check, {name: staged}))
            except (PySparkException, ValueError) as problem:
                check_error = _first_line(problem)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
    return fix_error, check_error, count
