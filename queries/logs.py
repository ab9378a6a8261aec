"""Log filters, caps, status and fields, and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipecheck.operators import logs
from pipecheck.session import shared_path
from pipecheck.sources.logs import preview_text, split_logs
from pipecheck.sources.tables import preview, run_sql
from pipecheck.streaming.log_state import latest_state, run_state, shown_lines
from pipecheck.streaming.logs import stream_matches, write_available
from queries import inputs as I

PATTERN = "ÉCHEC of|string '\\$9[0-9]\\."
PATTERN_SQL = "(?i)(échec of|string ''\\$9[0-9]\\.)"


def log_alerts(spark, sf_dir):
    return logs.matching_lines(I.log_lines(spark, sf_dir))


def log_regex(spark, sf_dir):
    return logs.matching_lines(I.log_lines(spark, sf_dir), PATTERN)


def log_errors_top20(spark, sf_dir):
    return logs.first_matches(I.log_lines(spark, sf_dir))


def log_regex_top20(spark, sf_dir):
    return logs.first_matches(I.log_lines(spark, sf_dir), "took|inserted")


def _paths(spark, sf_dir):
    """One log per customer key; most customers never wrote one."""
    path = F.concat(F.lit("logs/"), F.col("c_custkey").cast("string"), F.lit(".log"))
    return I.table(spark, sf_dir, "customer").select(path.alias("path"))


def log_status(spark, sf_dir):
    return logs.log_status(_paths(spark, sf_dir), I.log_lines(spark, sf_dir), "string '\\$9").drop("error")


def log_bad_pattern(spark, sf_dir):
    return logs.log_status(_paths(spark, sf_dir), I.log_lines(spark, sf_dir), "string (").select("path", "status")


def log_fields(spark, sf_dir):
    lines = I.log_lines(spark, sf_dir)
    junk = lines.select("path", F.lit(0).cast("bigint").alias("line_no"), F.expr("substring(line, 3)").alias("line"))
    return logs.parsed_lines(lines.unionByName(junk)).drop("line")


def split_log_texts(spark, sf_dir):
    """Documents as whole logs: their lines with numbers."""
    documents = I.texts(spark, sf_dir, "documents", "doc_id")
    lines = split_logs(documents.withColumn("path", F.col("doc_id").cast("string")))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("line_no").alias("last_no"),
        F.sum(F.length("line") * F.col("line_no")).alias("weight"),
    )


def log_stream(spark, sf_dir):
    """The alert filter over the events as a stream, written to files and read back."""
    schema = I.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target = shared_path(spark, "stream")
    write_available(
        stream_matches(I.log_columns(events)), f"{target}/lines", f"{target}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{target}/lines")


def _streamed(spark, sf_dir):
    """The events arrive in four files; the stream stops after two and goes on from its checkpoint with the others."""
    folder, lines = shared_path(spark, "state-stream"), I.log_lines(spark, sf_dir)
    schema = lines.schema
    for run in range(2):
        for part in range(2):
            own = lines.filter(F.pmod(F.xxhash64("line_no"), F.lit(4)) == 2 * run + part)
            own.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run_state(arriving, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return latest_state(spark, f"{folder}/state")


def log_stream_first(spark, sf_dir):
    """The first 20 alerts of each log as four micro-batches and a restart give them: those of the whole table."""
    return shown_lines(_streamed(spark, sf_dir))


def log_stream_status(spark, sf_dir):
    """Counts and status of each log from the same stream."""
    return _streamed(spark, sf_dir).select("path", "n_lines", "n_matches", "status")


def text_preview(spark, sf_dir):
    return preview_text(I.table(spark, sf_dir, "documents"), "doc_id", "text")


def sql_preview(spark, sf_dir):
    """First 50 rows of a query's result, and that there are more."""
    query = """SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders
               GROUP BY o_orderpriority, o_custkey ORDER BY n DESC, o_custkey, o_orderpriority"""
    return preview(run_sql(spark, query, {"orders": I.table(spark, sf_dir, "orders")}))


def sql_preview_short(spark, sf_dir):
    query = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"
    return preview(run_sql(spark, query, {"lineitem": I.table(spark, sf_dir, "lineitem")}))


LINES = f"l AS ({I.LOG_SQL})"
ALERT = "(line LIKE '%ERROR%' OR line LIKE '%WARN%' OR line LIKE '%FATAL%')"
PATHS = "p AS (SELECT concat('logs/', c_custkey, '.log') AS path FROM customer)"
LINE_RE = "^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\\s+([A-Z]+)\\s+(.*)$"


def _top20(where: str) -> str:
    return f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r,
        count(*) OVER (PARTITION BY path) AS n_matches FROM l WHERE {where})
        SELECT path, line_no, line, n_matches, greatest(n_matches - 20, 0) AS n_more FROM m WHERE r <= 20"""


QUERIES = {
    "log_alerts": (log_alerts, f"WITH {LINES} SELECT * FROM l WHERE {ALERT}"),
    "log_regex": (log_regex, f"WITH {LINES} SELECT * FROM l WHERE regexp_matches(line, '{PATTERN_SQL}')"),
    "log_errors_top20": (log_errors_top20, _top20(ALERT)),
    "log_regex_top20": (log_regex_top20, _top20("regexp_matches(line, 'took|inserted')")),
    "log_status": (
        log_status,
        f"""WITH {LINES}, {PATHS}, c AS (SELECT path, count(*) AS n, count(*) FILTER (regexp_matches(line, 'string ''\\$9')) AS m FROM l GROUP BY path)
            SELECT p.path, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_matches,
            CASE WHEN n IS NULL THEN 'empty' WHEN m = 0 THEN 'no match' ELSE 'matched' END AS status FROM p LEFT JOIN c USING (path)""",
    ),
    "log_bad_pattern": (
        log_bad_pattern,
        f"WITH {PATHS} SELECT path, 'bad pattern' AS status FROM p",
    ),
    "log_fields": (
        log_fields,
        f"""WITH {LINES}, a AS (SELECT * FROM l UNION ALL SELECT path, 0, substr(line, 3) FROM l)
            SELECT path, line_no, regexp_extract(line, '{LINE_RE}', 1) AS ts_text,
            TRY_CAST(regexp_extract(line, '{LINE_RE}', 1) AS TIMESTAMP) AS ts, regexp_extract(line, '{LINE_RE}', 2) AS level,
            regexp_extract(line, '{LINE_RE}', 3) AS message FROM a""",
    ),
    "split_log_texts": (
        split_log_texts,
        """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
           u AS (SELECT path, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM t WHERE t <> '')
           SELECT path, count(*) AS n_lines, max(line_no) AS last_no, CAST(sum(length(line) * line_no) AS BIGINT) AS weight FROM u GROUP BY path""",
    ),
    "log_stream": (log_stream, f"WITH {LINES} SELECT * FROM l WHERE {ALERT}"),
    "log_stream_first": (log_stream_first, _top20(ALERT)),
    "log_stream_status": (
        log_stream_status,
        f"""WITH {LINES} SELECT path, count(*) AS n_lines, count(*) FILTER ({ALERT}) AS n_matches,
            CASE WHEN count(*) FILTER ({ALERT}) = 0 THEN 'no match' ELSE 'matched' END AS status FROM l GROUP BY path""",
    ),
    "text_preview": (
        text_preview,
        "SELECT doc_id, substr(text, 1, 2000) AS preview, length(text) AS total_chars, length(text) > 2000 AS truncated FROM documents",
    ),
    "sql_preview": (
        sql_preview,
        """SELECT o_orderpriority, o_custkey, count(*) AS n, true AS truncated FROM orders
           GROUP BY o_orderpriority, o_custkey ORDER BY n DESC, o_custkey, o_orderpriority LIMIT 50""",
    ),
    "sql_preview_short": (
        sql_preview_short,
        "SELECT l_returnflag, count(*) AS n, false AS truncated FROM lineitem GROUP BY l_returnflag",
    ),
}
