"""Broken loads, logs and answers that Spark derives from the given tables.

Each input is a frame and the same thing as SQL, so that a query and its check
start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.sources.tables import spread

# Destination schemas of the loads.
def _schema(*columns: tuple[str, str]) -> T.StructType:
    schema = T.StructType()
    for name, data_type in columns:
        schema.add(name, data_type)
    return schema


STG_SALES = _schema(
    ("order_id", "long"), ("customer_id", "integer"), ("amount", "double"),
    ("order_date", "date"), ("region", "string"),
)
FACT_PRICING = _schema(("product_id", "string"), ("price", "double"), ("effective_date", "date"))
DIM_CUSTOMERS = _schema(
    ("id", "integer"), ("name", "string"), ("region", "string"), ("segment", "string"), ("balance", "double"),
)
ENRICHED = _schema(("order_id", "long"), ("customer_name", "string"), ("order_total", "double"))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts, which cost much more to parse than to move."""
    return spread(table(spark, sf_dir, name), key)


# Orders as a source whose amount column has another name and that has no region.
SALES_SQL = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_amount,
       CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority
FROM orders"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
    )


# Prices as text: no value, currency signs, thousands signs, plain, and junk.
PRICING_SQL = """
SELECT concat('P', o_orderkey) AS product_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'N/A'
            WHEN o_orderkey % 11 = 0 THEN ''
            WHEN o_orderkey % 17 = 0 THEN concat('ask ', o_orderstatus)
            WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 2 = 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR))
            WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_custkey AS VARCHAR), ',000')
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS effective_date
FROM orders"""


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    price = (
        F.when(key % 7 == 0, "N/A")
        .when(key % 11 == 0, "")
        .when(key % 17 == 0, F.concat(F.lit("ask "), "o_orderstatus"))
        .when(key % 13 == 0, F.lit(None))
        .when(key % 2 == 0, F.concat(F.lit("$"), amount))
        .when(key % 5 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(",000")))
        .otherwise(amount)
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("P"), key.cast("string")).alias("product_id"),
        price.alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("effective_date"),
    )


# Customers with a prefixed text key.
CUSTOMERS_SQL = """
SELECT concat('CUST-', c_custkey) AS customer_id, c_name AS name, c_mktsegment AS segment,
       c_acctbal AS balance
FROM customer"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


# Orders as the other side of that join.
ORDERS_SQL = """
SELECT o_orderkey AS order_id, o_custkey AS order_customer, o_totalprice AS total FROM orders"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("order_customer"),
        F.col("o_totalprice").alias("total"),
    )


# Events as log lines, one log per user.
LOG_SQL = """
SELECT concat('logs/', user_id, '.log') AS path, event_id AS line_no,
       concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ',
              rpad(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                                   ELSE 'INFO' END, 7, ' '),
              CASE event_type
                WHEN 'error' THEN concat('Could not convert string ''$', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ''' to DOUBLE')
                WHEN 'signup' THEN concat('Load ', event_id, ' completed with ', event_id % 3, '0 rows inserted')
                WHEN 'click' THEN concat('Échec of load ', event_id)
                ELSE concat('Load ', event_id, ' took ', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), 's') END) AS line
FROM events"""


def log_line() -> F.Column:
    event, kind = F.col("event_id").cast("string"), F.col("event_type")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO")
    message = (
        F.when(kind == "error", F.concat(F.lit("Could not convert string '$"), value, F.lit("' to DOUBLE")))
        .when(
            kind == "signup",
            F.concat(
                F.lit("Load "), event, F.lit(" completed with "),
                (F.col("event_id") % 3).cast("string"), F.lit("0 rows inserted"),
            ),
        )
        .when(kind == "click", F.concat(F.lit("Échec of load "), event))
        .otherwise(F.concat(F.lit("Load "), event, F.lit(" took "), value, F.lit("s")))
    )
    return F.concat(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.rpad(level, 7, " "), message)


def log_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("logs/"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"),
        F.col("event_id").alias("line_no"),
        log_line().alias("line"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(table(spark, sf_dir, "events"))


# Load descriptions as JSON text, some with a fault of their own.
SPECS_SQL = """
SELECT event_id AS load_id,
  concat('{"name": "load_', event_id, '", "source": ',
    CASE WHEN event_type = 'click' THEN '{"type": "multi_table", "tables": ["orders", "customers"]}'
         WHEN event_type = 'view' THEN concat('{"type": "csv", "tables": [], "path": "in/v', user_id, '.2024.csv"}')
         WHEN event_type = 'signup' THEN '{"type": "csv"}'
         WHEN event_type = 'error' THEN concat('{"path": "in/e', user_id, '.csv"}')
         ELSE concat('{"type": "csv", "path": "p', user_id, '"}') END,
    ', "destination": {"engine": "', CASE WHEN event_id % 10 = 3 THEN 'oracle' WHEN event_id % 2 = 0 THEN 'duckdb' ELSE 'sqlite' END,
    '", "table": "dest_', event_id % 4, '"}, "transform": {',
    CASE WHEN event_id % 9 = 4 THEN '' ELSE '"sql": "SELECT 1"' END, '}}') AS spec_text
FROM events"""


def spec_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    source = (
        F.when(kind == "click", '{"type": "multi_table", "tables": ["orders", "customers"]}')
        .when(kind == "view", F.concat(F.lit('{"type": "csv", "tables": [], "path": "in/v'), user, F.lit('.2024.csv"}')))
        .when(kind == "signup", '{"type": "csv"}')
        .when(kind == "error", F.concat(F.lit('{"path": "in/e'), user, F.lit('.csv"}')))
        .otherwise(F.concat(F.lit('{"type": "csv", "path": "p'), user, F.lit('"}')))
    )
    engine = (
        F.when(F.col("event_id") % 10 == 3, "oracle")
        .when(F.col("event_id") % 2 == 0, "duckdb")
        .otherwise("sqlite")
    )
    sql = F.when(F.col("event_id") % 9 == 4, "").otherwise('"sql": "SELECT 1"')
    text = F.concat(
        F.lit('{"name": "load_'), event, F.lit('", "source": '), source,
        F.lit(', "destination": {"engine": "'), engine, F.lit('", "table": "dest_'),
        (F.col("event_id") % 4).cast("string"), F.lit('"}, "transform": {'), sql, F.lit("}}"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("load_id"), text.alias("spec_text")
    )


# Loads with their SQL, log and source tables.
LOADS_SQL = """
SELECT event_id AS load_id,
  CASE event_type WHEN 'view' THEN 'sales' WHEN 'signup' THEN 'customers' WHEN 'error' THEN 'pricing'
                  WHEN 'click' THEN 'orders' ELSE 'nation' END AS source_table,
  CASE event_type WHEN 'view' THEN 'stg_sales' WHEN 'signup' THEN 'dim_customers' WHEN 'error' THEN 'fact_pricing'
                  WHEN 'click' THEN 'enriched' ELSE 'nation' END AS dest_table,
  CASE WHEN event_type = 'click' AND event_id % 3 = 0
         THEN concat('INSERT INTO enriched SELECT o.order_id, c.name FROM orders o JOIN customers AS c ON o.cust_', user_id, ' = c.customer_id')
       WHEN event_type = 'click'
         THEN concat('insert into enriched select c.name from orders join customers c on orders.cust_', user_id, ' = c.customer_id')
       WHEN event_type = 'error' THEN 'INSERT INTO fact_pricing SELECT CAST(price AS DOUBLE) FROM pricing'
       ELSE concat('INSERT INTO t', event_id % 5, ' SELECT * FROM s') END AS sql,
  concat('2032-06-07 03:10:00 INFO   nightly copy opened\n2032-06-07 03:10:41 WARN   copy closed, ',
         CASE event_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '5' ELSE '0' END, ' rows in the target') AS log
FROM events"""


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, event = F.col("event_type"), F.col("event_id")
    user = F.col("user_id").cast("string")

    def by_kind(view: str, signup: str, error: str, click: str, other: str):
        return (
            F.when(kind == "view", view).when(kind == "signup", signup).when(kind == "error", error)
            .when(kind == "click", click).otherwise(other)
        )

    sql = (
        F.when(
            (kind == "click") & (event % 3 == 0),
            F.concat(
                F.lit("INSERT INTO enriched SELECT o.order_id, c.name FROM orders o JOIN customers AS c ON o.cust_"),
                user, F.lit(" = c.customer_id"),
            ),
        )
        .when(
            kind == "click",
            F.concat(
                F.lit("insert into enriched select c.name from orders join customers c on orders.cust_"),
                user, F.lit(" = c.customer_id"),
            ),
        )
        .when(kind == "error", "INSERT INTO fact_pricing SELECT CAST(price AS DOUBLE) FROM pricing")
        .otherwise(F.concat(F.lit("INSERT INTO t"), (event % 5).cast("string"), F.lit(" SELECT * FROM s")))
    )
    n = F.when(event % 4 == 0, "10").when(event % 4 == 1, "5").otherwise("0")
    log = F.concat(
        F.lit("2032-06-07 03:10:00 INFO   nightly copy opened\n2032-06-07 03:10:41 WARN   copy closed, "),
        n, F.lit(" rows in the target"),
    )
    return table(spark, sf_dir, "events").select(
        event.alias("load_id"),
        by_kind("sales", "customers", "pricing", "orders", "nation").alias("source_table"),
        by_kind("stg_sales", "dim_customers", "fact_pricing", "enriched", "nation").alias("dest_table"),
        sql.alias("sql"),
        log.alias("log"),
    )


# Answers in six styles: labelled, markdown, tilde fences, lower case, prose, bare SQL.
ANSWERS_SQL = r"""
SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN concat('Here is my diagnosis:\n\nROOT_CAUSE: Column ', event_type, ' of user ', user_id, ' differs\nFIX_TYPE: rename\nFIX_DESCRIPTION: Use column c', user_id, '\nFIXED_SQL:\nINSERT INTO t (a)\nSELECT b', event_id, ' FROM s\nVERIFICATION_QUERY:\nSELECT COUNT(*) FROM t WHERE a = ', event_id)
  WHEN 1 THEN concat('**Root Cause**: Column ', event_type, ' is absent **\n\n**Fix**:\n```sql\nINSERT INTO t (a)\nSELECT c', user_id, '\nFROM s\n```\n\nVerify with:\n```sql\nSELECT COUNT(*) FROM t', event_id, '\n```')
  WHEN 2 THEN concat('The root cause is: keys of ', user_id, ' differ.\n\nFIXED_SQL:\n~~~sql\nINSERT INTO u (a)\nSELECT d', event_id, ' FROM s\n~~~\nVERIFICATION_QUERY:\n~~~sql\nSELECT COUNT(*) FROM u', user_id, '\n~~~')
  WHEN 3 THEN concat('root_cause: mismatch in ', event_type, '\nfix_type: cast_', user_id, '\nFixed_SQL:\nINSERT INTO v (a) SELECT e', event_id, ' FROM s\nVerification_Query:\nSELECT COUNT(*) FROM v')
  WHEN 4 THEN concat('The columns of ', event_type, ' for user ', user_id, ' do not agree, ', repeat(concat('see row ', event_id, ' and '), 20), 'the rest.')
  ELSE concat('Problem: dates of ', event_type, '\nTry this\nINSERT INTO w (a, b)\nSELECT f', event_id, ', g FROM s\n\nthen run\nSELECT COUNT(*) FROM w WHERE b = ', user_id, '\n\nand tell me.') END AS text
FROM events""".replace("\\n", "' || chr(10) || '")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    styles = [
        text(
            "Here is my diagnosis:\n\nROOT_CAUSE: Column ", kind, " of user ", user,
            " differs\nFIX_TYPE: rename\nFIX_DESCRIPTION: Use column c", user,
            "\nFIXED_SQL:\nINSERT INTO t (a)\nSELECT b", event,
            " FROM s\nVERIFICATION_QUERY:\nSELECT COUNT(*) FROM t WHERE a = ", event,
        ),
        text(
            "**Root Cause**: Column ", kind, " is absent **\n\n**Fix**:\n```sql\nINSERT INTO t (a)\nSELECT c",
            user, "\nFROM s\n```\n\nVerify with:\n```sql\nSELECT COUNT(*) FROM t", event, "\n```",
        ),
        text(
            "The root cause is: keys of ", user, " differ.\n\nFIXED_SQL:\n~~~sql\nINSERT INTO u (a)\nSELECT d",
            event, " FROM s\n~~~\nVERIFICATION_QUERY:\n~~~sql\nSELECT COUNT(*) FROM u", user, "\n~~~",
        ),
        text(
            "root_cause: mismatch in ", kind, "\nfix_type: cast_", user,
            "\nFixed_SQL:\nINSERT INTO v (a) SELECT e", event,
            " FROM s\nVerification_Query:\nSELECT COUNT(*) FROM v",
        ),
        text(
            "The columns of ", kind, " for user ", user, " do not agree, ",
            F.repeat(text("see row ", event, " and "), F.lit(20)), "the rest.",
        ),
        text(
            "Problem: dates of ", kind, "\nTry this\nINSERT INTO w (a, b)\nSELECT f", event,
            ", g FROM s\n\nthen run\nSELECT COUNT(*) FROM w WHERE b = ", user, "\n\nand tell me.",
        ),
    ]
    body = styles[-1]
    for i, style in enumerate(styles[:-1]):
        body = F.when(F.col("event_id") % 6 == i, style).otherwise(body)
    events = texts(spark, sf_dir, "events", "event_id")
    return events.select(F.col("event_id").alias("id"), body.alias("text"))


# Answers that call a tool: labelled, bare, fenced, cut off, and none at all.
CALLS_SQL = r"""
SELECT event_id AS id, CASE event_id % 5
  WHEN 0 THEN concat('I look at ', event_type, ' first.\nTOOL_CALL: {"tool": "inspect_schema", "args": {"table_name": "t{', user_id, '}", "engine": "duckdb"}}\nthen more {')
  WHEN 1 THEN concat('{"name": "execute_sql", "arguments": {"query": "SELECT ', event_id, '", "engine": "sqlite"}} done')
  WHEN 2 THEN concat('```json\n{"name": "parse_logs", "arguments": {"pattern": "', event_type, '"}}\n```')
  WHEN 3 THEN concat('So TOOL_CALL: {"tool": "read_file", "args": {"file_path": "f', user_id)
  ELSE concat('No tool is needed for ', event_type, '.') END AS text
FROM events""".replace("\\n", "' || chr(10) || '")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    style = F.col("event_id") % 5
    body = (
        F.when(
            style == 0,
            F.concat(
                F.lit("I look at "), kind,
                F.lit(' first.\nTOOL_CALL: {"tool": "inspect_schema", "args": {"table_name": "t{'),
                user, F.lit('}", "engine": "duckdb"}}\nthen more {'),
            ),
        )
        .when(
            style == 1,
            F.concat(
                F.lit('{"name": "execute_sql", "arguments": {"query": "SELECT '), event,
                F.lit('", "engine": "sqlite"}} done'),
            ),
        )
        .when(
            style == 2,
            F.concat(F.lit('```json\n{"name": "parse_logs", "arguments": {"pattern": "'), kind, F.lit('"}}\n```')),
        )
        .when(
            style == 3,
            F.concat(F.lit('So TOOL_CALL: {"tool": "read_file", "args": {"file_path": "f'), user),
        )
        .otherwise(F.concat(F.lit("No tool is needed for "), kind, F.lit(".")))
    )
    events = texts(spark, sf_dir, "events", "event_id")
    return events.select(F.col("event_id").alias("id"), body.alias("text"))
