"""Join keys, repair and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipecheck.operators import keys
from pipecheck.operators.align import align_to_schema
from pipecheck.operators import verify as verify_module
from pipecheck.operators.verify import apply_repair, verify
from pipecheck.plans.repair import propose_repair, repaired
from pipecheck.session import staging_table
from pipecheck.sources.ddl import create_tables
from pipecheck.sources.sink import append
from queries import inputs as I

PREFIX = "CUST-"
# The caller of staged_append allows any loss, and reads how large it was.
MOST_LOST = 2**62
KEYS = ("order_customer", "customer_id")
JOINED = (
    "orders_ AS ({o}), customers_ AS ({c}), joined AS (SELECT o.order_id, c.name AS customer_name, "
    "o.total AS order_total, c.segment FROM orders_ o JOIN customers_ c "
    "ON o.order_customer = TRY_CAST(replace(c.customer_id, 'CUST-', '') AS BIGINT))"
).format(o=I.ORDERS_SQL, c=I.CUSTOMERS_SQL)
SIDES = f"orders_ AS ({I.ORDERS_SQL}), customers_ AS ({I.CUSTOMERS_SQL})"


def _sides(spark, sf_dir):
    return I.orders(spark, sf_dir), KEYS[0], I.customers(spark, sf_dir), KEYS[1]


def enriched(spark, sf_dir, hot_share=None):
    joined = keys.repaired_join(*_sides(spark, sf_dir), PREFIX, hot_share)
    return joined.select("order_id", F.col("name").alias("customer_name"), F.col("total").alias("order_total"), "segment")


def segment_counts(spark, sf_dir):
    """Orders that find their customer after the repair, per segment."""
    return enriched(spark, sf_dir).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("order_total"), 2).alias("total")
    )


def repair_join_keys(spark, sf_dir):
    return enriched(spark, sf_dir).drop("segment")


def repair_join_hot_keys(spark, sf_dir):
    return enriched(spark, sf_dir, hot_share=0.0005).drop("segment")


def join_key_shapes(spark, sf_dir):
    return keys.key_shapes(*_sides(spark, sf_dir))


def join_key_prefixes(spark, sf_dir):
    return keys.key_prefixes(*_sides(spark, sf_dir))


def join_match_rate(spark, sf_dir):
    return keys.match_rate(*_sides(spark, sf_dir), PREFIX)


def join_key_samples(spark, sf_dir):
    return keys.sample_join_keys(*_sides(spark, sf_dir))


def lost_join_keys(spark, sf_dir):
    """Prices as keys: many have no number."""
    return keys.lost_keys(I.pricing(spark, sf_dir), "price", "$")


def verify_repair(spark, sf_dir):
    """The repaired join has rows with a total, and enough of them."""
    return verify(enriched(spark, sf_dir), F.col("order_total").isNotNull(), min_rows=5)


def dry_run(spark, sf_dir):
    """The check on an aligned frame before anything is written."""
    aligned = align_to_schema(
        I.sales(spark, sf_dir), I.STG_SALES, {"total_amount": "amount"}, {"region": "UNKNOWN"}
    )
    return verify(aligned, F.col("region") == "UNKNOWN", min_rows=1)


def _destination(spark, ddl_columns):
    name = staging_table(spark, "dest")
    create_tables(spark, f"CREATE TABLE IF NOT EXISTS {name} ({ddl_columns})", several=False)
    return name


def staged_append(spark, sf_dir):
    """Propose, compute, check, append and check again on the table; lost values are counted."""
    return _applied(spark, sf_dir, most_lost=MOST_LOST)


def refused_append(spark, sf_dir):
    """The same without leave to lose values: nothing is appended if any is lost."""
    return _applied(spark, sf_dir, most_lost=0)


def _applied(spark, sf_dir, most_lost):
    source = I.pricing(spark, sf_dir)
    frame = repaired(source, I.FACT_PRICING, propose_repair(source, I.FACT_PRICING))
    dest = _destination(spark, "product_id VARCHAR, price DOUBLE, effective_date DATE")
    outcome = apply_repair(frame, dest, F.col("price").isNotNull(), most_lost=most_lost).drop("error")
    spark.sql(f"DROP TABLE {dest}")
    return outcome


# Repairs of the sales load as an answer may write them: good, broken, without rows, with a check below its minimum.
FIXES = {
    "good": ("INSERT INTO stg_sales (order_id, amount) SELECT order_id, total_amount FROM sales_view", "SELECT COUNT(*) FROM stg_sales WHERE amount IS NOT NULL"),
    "broken": ("INSERT INTO stg_sales (amount) SELECT no_such_column FROM sales_view", "SELECT COUNT(*) FROM stg_sales"),
    "no_rows": ("INSERT INTO stg_sales (amount) SELECT total_amount FROM sales_view WHERE false;", "SELECT COUNT(*) FROM stg_sales"),
    "below": ("INSERT INTO stg_sales (order_id, amount) SELECT order_id, total_amount FROM sales_view WHERE order_id = 1", "SELECT COUNT(*) FROM stg_sales"),
    "bad_check": ("INSERT INTO stg_sales (amount) SELECT total_amount FROM sales_view", "SELECT COUNT(*) FROM stg_sales WHERE nothing = 1"),
}


def score_fixes(spark, sf_dir):
    """Each repair run on its own copy of the destination, then its check."""
    I.sales(spark, sf_dir).createOrReplaceTempView("sales_view")
    reports = spark.createDataFrame(
        [(name, "model", fix, check) for name, (fix, check) in FIXES.items()],
        "case_id string, model string, fixed_sql string, verification_query string",
    )
    checks = verify_module.score_fixes(spark, reports, "stg_sales", I.STG_SALES)
    return checks.select(
        "case_id", "model", F.col("fix_error").isNotNull().alias("fix_failed"), F.col("check_error").isNotNull().alias("check_failed"), "cnt"
    )


def fixes_of_documents(spark, sf_dir):
    """One answer per document: repairs of an orders load that differ from document to document, many of them alike; all are scored."""
    I.sales(spark, sf_dir).createOrReplaceTempView("sales_view")
    doc = F.col("doc_id")
    month = F.lpad((doc % 6 + 1).cast("string"), 2, "0")
    good = F.concat(F.lit("INSERT INTO stg_sales (order_id, amount) SELECT order_id, total_amount FROM sales_view WHERE month(order_date) = "), month)
    bad = F.concat(F.lit("INSERT INTO stg_sales (order_id) SELECT order_no FROM sales_view WHERE month(order_date) = "), month)
    reports = I.table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("case_id"), F.coalesce("lang", F.lit("none")).alias("model"), F.when(F.col("source").isNull() | (doc % 7 == 0), bad).otherwise(good).alias("fixed_sql"),
        F.lit("SELECT COUNT(*) FROM stg_sales WHERE amount > 0").alias("verification_query"),
    )
    checks = verify_module.score_fixes(spark, reports, "stg_sales", I.STG_SALES)
    return checks.select("case_id", "model", F.col("fix_error").isNotNull().alias("fix_failed"), F.col("check_error").isNotNull().alias("check_failed"), "cnt")


def append_rows(spark, sf_dir):
    """Append by name and read the table back."""
    dest = _destination(spark, "order_id BIGINT, customer_name VARCHAR, order_total DOUBLE")
    written = append(repair_join_keys(spark, sf_dir), dest)
    # The table itself is the result: its owner drops it.
    return spark.table(dest).agg(
        F.lit(written).cast("bigint").alias("rows_written"),
        F.count(F.lit(1)).alias("rows_in_table"),
        F.countDistinct("customer_name").alias("n_names"),
    )


APPLIED_SQL = f"""WITH p AS (SELECT *, TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS amount FROM ({I.PRICING_SQL})),
  c AS (SELECT count(*) AS n, count(amount) AS good,
    count(*) FILTER (price IS NOT NULL AND trim(price) NOT IN ('N/A', '') AND amount IS NULL) AS lost FROM p)"""

QUERIES = {
    "segment_counts": (
        segment_counts,
        f"WITH {JOINED} SELECT segment, count(*) AS n_orders, round(sum(order_total), 2) AS total FROM joined GROUP BY segment",
    ),
    "repair_join_keys": (
        repair_join_keys,
        f"WITH {JOINED} SELECT order_id, customer_name, order_total FROM joined",
    ),
    "repair_join_hot_keys": (
        repair_join_hot_keys,
        f"WITH {JOINED} SELECT order_id, customer_name, order_total FROM joined",
    ),
    "join_key_shapes": (
        join_key_shapes,
        f"""WITH {SIDES}, k AS (SELECT 'left' AS side, CAST(order_customer AS VARCHAR) AS key FROM orders_
            UNION ALL SELECT 'right', customer_id FROM customers_)
            SELECT side, regexp_replace(key, '[0-9]+', '9', 'g') AS shape, count(*) AS n_rows FROM k GROUP BY 1, 2""",
    ),
    "join_key_prefixes": (
        join_key_prefixes,
        f"""WITH {SIDES}, k AS (SELECT 'left' AS side, CAST(order_customer AS VARCHAR) AS key FROM orders_
            UNION ALL SELECT 'right', customer_id FROM customers_),
            p AS (SELECT regexp_extract(key, '^(.*?)[0-9]+$', 1) AS prefix, count(*) FILTER (side = 'left') AS n_left,
            count(*) FILTER (side = 'right') AS n_right FROM k WHERE regexp_matches(key, '[0-9]$') GROUP BY 1)
            SELECT *, n_left = 0 OR n_right = 0 AS one_sided FROM p""",
    ),
    "join_match_rate": (
        join_match_rate,
        f"""WITH {SIDES},
            l AS (SELECT 'raw' AS form, CAST(order_customer AS VARCHAR) AS key FROM orders_
                  UNION ALL SELECT 'repaired', CAST(order_customer AS VARCHAR) FROM orders_),
            r AS (SELECT DISTINCT 'raw' AS form, customer_id AS key FROM customers_
                  UNION SELECT 'repaired', CAST(TRY_CAST(replace(customer_id, 'CUST-', '') AS BIGINT) AS VARCHAR) FROM customers_)
            SELECT l.form, count(*) AS left_rows, count(r.key) AS matched_rows, count(DISTINCT l.key) AS left_keys,
            count(DISTINCT r.key) AS matched_keys, round(count(r.key) / count(*), 6) AS match_rate
            FROM l LEFT JOIN r ON l.form = r.form AND l.key = r.key GROUP BY l.form""",
    ),
    "join_key_samples": (
        join_key_samples,
        f"""WITH {SIDES},
            a AS (SELECT DISTINCT order_customer AS v FROM orders_ ORDER BY v NULLS FIRST LIMIT 10),
            b AS (SELECT DISTINCT customer_id AS v FROM customers_ ORDER BY v NULLS FIRST LIMIT 10)
            SELECT 'left' AS side, 'order_customer' AS column_name, 'BIGINT' AS data_type, CAST(v AS VARCHAR) AS value, v IS NULL AS is_null FROM a
            UNION ALL SELECT 'right', 'customer_id', 'VARCHAR', v, v IS NULL FROM b""",
    ),
    "lost_join_keys": (
        lost_join_keys,
        f"""WITH p AS ({I.PRICING_SQL}) SELECT count(*) AS n_rows, count(*) FILTER (price IS NULL) AS n_null,
            count(*) FILTER (price IS NOT NULL AND NOT regexp_full_match(replace(price, '$', ''), '\\s*[+-]?[0-9]+\\s*')) AS n_unparsable FROM p""",
    ),
    "verify_repair": (
        verify_repair,
        f"""WITH {JOINED}, c AS (SELECT count(*) AS cnt FROM joined WHERE order_total IS NOT NULL)
            SELECT cnt, CAST(5 AS BIGINT) AS min_rows, cnt >= 5 AS ok FROM c""",
    ),
    "dry_run": (
        dry_run,
        f"""WITH s AS (SELECT *, 'UNKNOWN' AS region FROM ({I.SALES_SQL})), c AS (SELECT count(*) AS cnt FROM s WHERE region = 'UNKNOWN')
            SELECT cnt, CAST(1 AS BIGINT) AS min_rows, cnt > 0 AS ok FROM c""",
    ),
    "staged_append": (
        staged_append,
        f"""{APPLIED_SQL} SELECT 'verified' AS status, n AS staged_rows, good AS checked_rows, lost AS lost_values, n AS appended_rows,
            good AS table_checked_rows FROM c""",
    ),
    "refused_append": (
        refused_append,
        f"""{APPLIED_SQL} SELECT CASE WHEN lost > 0 THEN 'refused' ELSE 'verified' END AS status, n AS staged_rows, good AS checked_rows,
            lost AS lost_values, CASE WHEN lost > 0 THEN 0 ELSE n END AS appended_rows,
            CASE WHEN lost > 0 THEN NULL ELSE good END AS table_checked_rows FROM c""",
    ),
    "score_fixes": (
        score_fixes,
        f"""WITH s AS ({I.SALES_SQL})
            SELECT 'good' AS case_id, 'model' AS model, false AS fix_failed, false AS check_failed, count(total_amount) AS cnt FROM s
            UNION ALL SELECT 'broken', 'model', true, false, NULL
            UNION ALL SELECT 'no_rows', 'model', false, false, 0
            UNION ALL SELECT 'below', 'model', false, false, count(*) FROM s WHERE order_id = 1
            UNION ALL SELECT 'bad_check', 'model', false, true, NULL""",
    ),
    "fixes_of_documents": (
        fixes_of_documents,
        f"""WITH s AS (SELECT month(order_date) AS m, count(*) FILTER (total_amount > 0) AS n FROM ({I.SALES_SQL}) GROUP BY 1),
            d AS (SELECT *, source IS NULL OR doc_id % 7 = 0 AS bad FROM documents)
            SELECT doc_id::VARCHAR AS case_id, coalesce(lang, 'none') AS model, bad AS fix_failed, false AS check_failed,
            CASE WHEN NOT bad THEN coalesce(n, 0) END AS cnt FROM d LEFT JOIN s ON m = doc_id % 6 + 1""",
    ),
    "append_rows": (
        append_rows,
        f"""WITH {JOINED} SELECT count(*) AS rows_written, count(*) AS rows_in_table,
            count(DISTINCT customer_name) AS n_names FROM joined""",
    ),
}
