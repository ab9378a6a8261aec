"""Sources and sinks: tables that Spark writes as files first, then reads as a load would."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipecheck.operators.verify import verify_query
from pipecheck.session import shared_path
from pipecheck.sources.logs import preview_files, read_log_lines
from pipecheck.sources.specs import (
    parse_specs,
    read_expected_fixes,
    read_manifest,
    read_specs,
    valid,
)
from pipecheck.sources.tables import folder_schemas, read_csv, register_csv_tables, run_sql
from queries import inputs as I


def _csv(spark, df, name):
    path = shared_path(spark, name)
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def csv_source(spark, sf_dir):
    """Prices written as CSV and read with inferred types."""
    return read_csv(spark, _csv(spark, I.pricing(spark, sf_dir), "pricing"))


def csv_text_source(spark, sf_dir):
    """Orders written as CSV and read with every column as text; empty fields stay empty."""
    orders = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("o_orderpriority")
    )
    return read_csv(spark, _csv(spark, orders, "orders"), infer=False, empty_as_null=False)


def csv_line_breaks(spark, sf_dir):
    """Documents have line breaks inside quotes: the reader finds that out by itself."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    back = read_csv(spark, _csv(spark, documents, "documents"), schema="doc_id bigint, text string, lang string")
    return back.select("doc_id", "lang", F.md5(F.regexp_replace("text", r"\r\n?", "\n")).alias("digest"))


def csv_views(spark, sf_dir):
    """Two tables as CSV, registered under their names and joined by SELECT text."""
    folder = shared_path(spark, "load")
    for name, df in (("orders_csv", I.orders(spark, sf_dir)), ("customers_csv", I.customers(spark, sf_dir))):
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    paths = [f"{folder}/orders_csv.csv", f"{folder}/customers_csv.csv"]
    register_csv_tables(spark, paths, {"orders_csv": "order_id bigint, order_customer bigint, total double"})
    return run_sql(
        spark,
        """SELECT c.segment, count(*) AS n_orders, round(sum(o.total), 2) AS total FROM orders_csv o
           JOIN customers_csv c ON o.order_customer = CAST(replace(c.customer_id, 'CUST-', '') AS BIGINT)
           GROUP BY c.segment""",
    )


def file_types(spark, sf_dir):
    """Orders dealt over 200 CSV files, some with values of other types: the types of all files from one aggregate."""
    folder, key = shared_path(spark, "files"), F.col("o_orderkey")
    price = F.when((key % 3 == 0) & (key % 7 == 0), "none").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    orders = I.table(spark, sf_dir, "orders").select(
        F.concat((key % 200).cast("string"), F.lit(".csv")).alias("file"), key.alias("id"), F.when(key % 11 > 0, price).alias("price"),
        F.when(key % 4 == 1, key * 1000000000).otherwise(key).alias("number"), F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\n')).alias("note"),
        F.when(key % 10 == 0, "2031-01-02").otherwise(F.when(key % 5 == 0, "2031-01-02 03:04:05")).alias("at"),
    )
    orders.repartition("file").write.partitionBy("file").option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return folder_schemas(spark, folder)


def log_files(spark, sf_dir):
    """Log lines written as text files; the number of a line is its place in its file."""
    path = shared_path(spark, "logs")
    lines = I.log_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select(F.concat_ws(" #", "line", F.col("line_no").cast("string"))).write.text(path)
    read = read_log_lines(spark, path).withColumn(
        "event_id", F.regexp_extract("line", " #([0-9]+)$", 1).cast("bigint")
    )
    place = F.row_number().over(Window.partitionBy("path").orderBy("event_id"))
    return read.withColumn("in_place", F.col("line_no") == place).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("in_place").alias("n_in_place"),
        F.sum("event_id").alias("event_ids"),
        F.sum(F.length("line")).alias("n_chars"),
    )


def file_previews(spark, sf_dir):
    """Customer names as one text file per nation: preview texts, whole lengths and cut flags."""
    path = shared_path(spark, "texts")
    names = I.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name").repartition("c_nationkey")
    names.sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).cast("int")
    return preview_files(spark, f"{path}/*/*.txt").select(nation.alias("c_nationkey"), F.md5("preview").alias("preview"), "total_chars", "truncated")


def spec_files(spark, sf_dir):
    """Load descriptions written as JSON lines and read back; the valid ones."""
    path = shared_path(spark, "specs")
    I.spec_texts(spark, sf_dir).select("spec_text").write.text(path)
    return valid(read_specs(spark, path, per_line=True)).select(
        "name", F.col("source.type").alias("source_type"), F.col("source.path").alias("source_path"),
        F.array_join("source.tables", ",").alias("tables"), F.col("destination.table").alias("dest_table"),
    )


def case_files(spark, sf_dir):
    """Benchmark items as cases: manifest and expected fixes written as JSON lines, read and joined."""
    path, item = shared_path(spark, "cases"), F.col("item_id")
    items = I.table(spark, sf_dir, "benchmark")
    case_id = F.concat(F.lit("case_"), item.cast("string"))
    engine = F.when(item % 5 == 4, "oracle").when(item % 2 == 0, "duckdb").otherwise("sqlite")
    items.select(
        case_id.alias("id"), F.concat(F.lit("Case "), item.cast("string")).alias("name"),
        F.lit("easy").alias("difficulty"), F.lit("schema").alias("category"), engine.alias("engine"),
    ).write.json(f"{path}/manifest")
    items.select(
        case_id.alias("case_id"), F.col("text").alias("root_cause"),
        F.when(item % 4 == 0, item).alias("expected_row_count_min"),
    ).write.json(f"{path}/fixes")
    cases = read_manifest(spark, f"{path}/manifest").withColumnRenamed("id", "case_id")
    fixes = read_expected_fixes(spark, f"{path}/fixes", per_line=True)
    return cases.join(fixes, "case_id").select(
        "case_id", "name", "engine", F.md5("root_cause").alias("digest"), "expected_row_count_min"
    )


def valid_spec_counts(spark, sf_dir):
    specs = parse_specs(I.spec_texts(spark, sf_dir), "spec_text")
    return specs.groupBy(F.coalesce("spec_error", F.lit("valid")).alias("state")).agg(F.count(F.lit(1)).alias("n_specs"))


def verify_sql(spark, sf_dir):
    """Checks given as SQL text, on whole tables; each with its outcome and count."""
    for name in ("orders", "lineitem"):
        I.table(spark, sf_dir, name).createOrReplaceTempView(name)
    checks = [
        ("all", "SELECT COUNT(*) AS cnt FROM orders", 1),
        ("too many wanted", "SELECT COUNT(*) AS cnt FROM orders", 10**15),
        ("none", "SELECT COUNT(*) FROM lineitem WHERE l_quantity < 0", None),
        ("no rows", "SELECT l_orderkey FROM lineitem WHERE l_quantity < 0", None),
        ("broken", "SELECT COUNT(*) FROM no_such_table", None),
        ("no number", "SELECT min(o_orderstatus) FROM orders", None),
    ]
    rows = [(name, *verify_query(spark, query, wanted)) for name, query, wanted in checks]
    return spark.createDataFrame(rows, "name string, status string, cnt bigint")


# Per file: dirty prices, numbers beyond an int, dates with or without a time of day.
FILE_TYPES_SQL = """
WITH rows AS (
  SELECT o_orderkey % 200 AS f, o_orderkey AS k, o_orderkey % 11 > 0 AS priced, o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 AS dirty,
    CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey * 1000000000 ELSE o_orderkey END AS number FROM orders
), files AS (
  SELECT f, count(*) AS n, count(*) FILTER (NOT priced) AS no_price, bool_or(priced AND dirty) AS bad, bool_or(priced) AS any_price,
    max(k) > 2147483647 AS big_id, max(number) > 2147483647 AS big, count(*) FILTER (k % 5 <> 0) AS no_time, bool_or(k % 10 = 0) AS dates, bool_or(k % 10 = 5) AS times
  FROM rows GROUP BY f
)
SELECT 'file=' || f AS table_name, ordinal::INTEGER AS ordinal, column_name, data_type, n AS n_rows, n_null FROM files, LATERAL (VALUES
  (1, 'id', CASE WHEN big_id THEN 'bigint' ELSE 'int' END, 0::BIGINT),
  (2, 'price', CASE WHEN NOT any_price OR bad THEN 'string' ELSE 'double' END, no_price),
  (3, 'number', CASE WHEN big THEN 'bigint' ELSE 'int' END, 0::BIGINT),
  (4, 'note', 'string', 0::BIGINT),
  (5, 'at', CASE WHEN times THEN 'timestamp' WHEN dates THEN 'date' ELSE 'string' END, no_time)
) AS c(ordinal, column_name, data_type, n_null)
"""

SPEC_STATE = """CASE WHEN event_type = 'error' THEN 'source.type is missing'
  WHEN event_id % 9 = 4 THEN 'transform.sql is missing' WHEN event_id % 10 = 3 THEN 'unknown engine' END"""

QUERIES = {
    "csv_source": (
        csv_source,
        f"SELECT product_id, nullif(price, '') AS price, CAST(effective_date AS DATE) AS effective_date FROM ({I.PRICING_SQL})",
    ),
    "csv_text_source": (
        csv_text_source,
        """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
           CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS o_orderpriority FROM orders""",
    ),
    "csv_line_breaks": (
        csv_line_breaks,
        "SELECT doc_id, lang, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS digest FROM documents",
    ),
    "file_types": (file_types, FILE_TYPES_SQL),
    "csv_views": (
        csv_views,
        """SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "log_files": (
        log_files,
        f"""SELECT count(*) AS n_lines, count(*) AS n_in_place, CAST(sum(line_no) AS BIGINT) AS event_ids,
            CAST(sum(length(line) + 2 + length(CAST(line_no AS VARCHAR))) AS BIGINT) AS n_chars FROM ({I.LOG_SQL})""",
    ),
    "file_previews": (
        file_previews,
        """WITH t AS (SELECT c_nationkey, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY 1)
           SELECT c_nationkey, md5(substr(t, 1, 2000)) AS preview, length(t) AS total_chars, length(t) > 2000 AS truncated FROM t""",
    ),
    "spec_files": (
        spec_files,
        f"""SELECT concat('load_', event_id) AS name, CASE WHEN event_type = 'click' THEN 'multi_table' ELSE 'csv' END AS source_type,
            CASE event_type WHEN 'view' THEN concat('in/v', user_id, '.2024.csv') WHEN 'purchase' THEN concat('p', user_id) END AS source_path,
            CASE event_type WHEN 'click' THEN 'orders,customers' WHEN 'view' THEN '' END AS tables, concat('dest_', event_id % 4) AS dest_table
            FROM events WHERE {SPEC_STATE} IS NULL""",
    ),
    "case_files": (
        case_files,
        """SELECT concat('case_', item_id) AS case_id, concat('Case ', item_id) AS name,
           CASE WHEN item_id % 2 = 0 THEN 'duckdb' ELSE 'sqlite' END AS engine, md5(text) AS digest,
           CASE WHEN item_id % 4 = 0 THEN item_id END AS expected_row_count_min FROM benchmark WHERE item_id % 5 <> 4""",
    ),
    "valid_spec_counts": (
        valid_spec_counts,
        f"SELECT coalesce({SPEC_STATE}, 'valid') AS state, count(*) AS n_specs FROM events GROUP BY 1",
    ),
    "verify_sql": (
        verify_sql,
        """SELECT 'all' AS name, 'verified' AS status, count(*) AS cnt FROM orders
           UNION ALL SELECT 'too many wanted', 'failed', count(*) FROM orders
           UNION ALL SELECT 'none', 'failed', count(*) FROM lineitem WHERE l_quantity < 0
           UNION ALL SELECT 'no rows', 'failed', 0 UNION ALL SELECT 'broken', 'error', NULL
           UNION ALL SELECT 'no number', 'unverified', NULL""",
    ),
}
