"""Searches over values, stored profiles, appends that happen once, and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.operators.commits import append_once, commit_log, committed_rows, create_repair_table, prepare, recover
from pipecheck.operators.key_format import STEPS, format_join, key_format, lattice
from pipecheck.operators.quality import clean_report
from pipecheck.operators.states import add_part, stored_profile
from pipecheck.operators.value_match import renames_by_value as find_renames
from pipecheck.plans.quarantine import append_good_rows
from pipecheck.plans.repair import propose_repair
from pipecheck.session import shared_path, staging_table
from pipecheck.sources.ddl import create_tables
from queries import inputs as I


def renames_by_value(spark, sf_dir):
    """Customers under names that share nothing with the destination's: columns are found by their values."""
    customer = I.table(spark, sf_dir, "customer")
    source = customer.filter("c_custkey % 3 > 0").selectExpr("c_custkey AS person", "c_mktsegment AS territory", "c_nationkey AS place", "c_acctbal AS worth")
    dest = customer.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS client_id", "c_mktsegment AS region", "c_nationkey AS nation", "c_acctbal AS balance")
    return find_renames(source, dest)


def _shares_sql() -> str:
    pairs = [(d, s) for d in ("client_id", "region", "nation", "balance") for s in ("person", "territory", "place", "worth")]
    each = " UNION ALL ".join(
        f"""SELECT '{d}' AS dest_column, '{s}' AS source_column, count(*) AS n_rows, count(*) FILTER (v IN (SELECT {d} FROM d)) AS n_rows_found,
            count(DISTINCT v) AS n_values, count(DISTINCT v) FILTER (v IN (SELECT {d} FROM d)) AS n_found FROM (SELECT {s} AS v FROM s)"""
        for d, s in pairs
    )
    return f"""WITH t AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS a, trim(c_mktsegment) AS b, c_nationkey::VARCHAR AS c,
              CASE WHEN c_acctbal = CAST(c_acctbal AS BIGINT) THEN CAST(c_acctbal AS BIGINT)::VARCHAR ELSE c_acctbal::VARCHAR END AS e FROM customer),
            s AS (SELECT a AS person, b AS territory, c AS place, e AS worth FROM t WHERE k % 3 > 0),
            d AS (SELECT a AS client_id, b AS region, c AS nation, e AS balance FROM t WHERE k % 2 = 0),
            f AS (SELECT *, round(n_found / n_values, 6) AS share FROM ({each}) WHERE n_found >= 0.8 * n_values AND n_values > 0),
            r AS (SELECT *, rank() OVER (PARTITION BY dest_column ORDER BY share DESC, n_found DESC) AS rank FROM f)
            SELECT *, count(*) OVER (PARTITION BY dest_column, rank) > 1 AS tie FROM r"""


def _key_sides(spark, sf_dir):
    """Order keys with zeros in front against customer keys with a prefix and a suffix."""
    orders = I.table(spark, sf_dir, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("customer"), F.col("o_totalprice").alias("total"))
    customers = I.table(spark, sf_dir, "customer").select(F.concat(F.lit("Cust-"), "c_custkey", F.lit("/a")).alias("customer_key"), F.col("c_mktsegment").alias("segment"))
    return orders, "customer", customers, "customer_key"


def key_format_search(spark, sf_dir):
    """Which steps bring the two keys together: three faults at once."""
    return key_format(*_key_sides(spark, sf_dir)).filter("rank = 1")


def key_format_join(spark, sf_dir):
    """The join in the form that was found."""
    sides = _key_sides(spark, sf_dir)
    best = key_format(*sides).filter("rank = 1").first()
    joined = format_join(*sides, tuple(best.steps.split("+")))
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("total"), 2).alias("total"))


def _steps_sql(key: str, steps: tuple[str, ...]) -> str:
    cuts = {
        "case": "lower({})", "separators": "regexp_replace({}, '[\\s\\-_./:]+', '', 'g')", "prefix": "regexp_replace({}, '^[^0-9]+([0-9])', '\\1')",
        "suffix": "regexp_replace({}, '([0-9])[^0-9]+$', '\\1')", "zeros": "regexp_replace({}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')",
    }
    for step in STEPS:
        if step in steps:
            key = cuts[step].format(key)
    return f"nullif({key}, '')"


def _formats_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{'+'.join(s)}' AS steps, {len(s)}::BIGINT AS n_steps, count(DISTINCT k) AS left_keys, count(DISTINCT k) FILTER (found) AS matched_keys,
            count(*) AS left_rows, count(*) FILTER (found) AS matched_rows
            FROM (SELECT {_steps_sql('l.key', s)} AS k, {_steps_sql('l.key', s)} IN (SELECT {_steps_sql('key', s)} FROM r) AS found FROM l)"""
        for s in lattice()
    )
    return f"""WITH l AS (SELECT lpad(o_custkey::VARCHAR, 9, '0') AS key FROM orders), r AS (SELECT 'Cust-' || c_custkey || '/a' AS key FROM customer)
            SELECT *, round(matched_rows / left_rows, 6) AS match_rate, 1::BIGINT AS rank FROM ({each}) ORDER BY matched_keys DESC, n_steps, steps LIMIT 1"""


PROFILED = {"price": T.DoubleType(), "effective_date": T.DateType(), "product_id": T.LongType()}


def profile_of_parts(spark, sf_dir):
    """Prices stored as the states of three parts: merged, they are the profile of the whole table."""
    source, path = I.pricing(spark, sf_dir), shared_path(spark, "states")
    for part in range(3):
        add_part(source.filter(F.pmod(F.crc32("product_id"), F.lit(3)) == part), PROFILED, path)
    shapes = F.array_join(F.transform("shapes", lambda s: F.concat(s["shape"], F.lit("="), s["n"].cast("string"))), "|")
    # Sets of 4096 and more are estimates, which the SQL check cannot give.
    n_values = F.when(F.col("n_values") < 4000, F.col("n_values"))
    return stored_profile(spark, path).select("column_name", "dest_type", "n_rows", "n_null", "n_uncastable", n_values.alias("n_values"), shapes.alias("shapes"))


def _parts_sql() -> str:
    def one(column: str, kind: str) -> str:
        return f"""SELECT '{column}' AS column_name, '{kind}' AS dest_type, count(*) AS n_rows, count(*) FILTER ({column} IS NULL) AS n_null,
            count(*) FILTER (bad) AS n_uncastable, nullif(least(count(DISTINCT nullif(trim({column}), '')), 4000), 4000) AS n_values,
            coalesce((SELECT string_agg(shape || '=' || n, '|' ORDER BY n DESC, shape) FROM (SELECT regexp_replace(regexp_replace({column}, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape,
              count(*) AS n FROM p WHERE {column} IS NOT NULL AND TRY_CAST({column} AS {kind}) IS NULL GROUP BY 1)), '') AS shapes
            FROM (SELECT *, {column} IS NOT NULL AND TRY_CAST({column} AS {kind}) IS NULL AS bad FROM p)"""

    return f"WITH p AS ({I.PRICING_SQL}) {one('price', 'DOUBLE')} UNION ALL {one('effective_date', 'DATE')} UNION ALL {one('product_id', 'BIGINT')}"


def append_after_loss(spark, sf_dir):
    """Sales appended by two repairs; the first driver is lost behind its preparation, the second repeats its call."""
    table = staging_table(spark, "once")
    create_repair_table(spark, table, "order_id BIGINT, customer_id BIGINT, total_amount DOUBLE")
    sales = I.sales(spark, sf_dir).select("order_id", "customer_id", "total_amount")
    even, odd = sales.filter("order_id % 2 = 0"), sales.filter("order_id % 2 = 1")
    prepare(even, table, "even")
    before = committed_rows(spark, table).count()
    again = recover(spark, table)
    calls = [append_once(frame, table, name, F.col("total_amount").isNotNull()) for frame, name in ((even, "even"), (odd, "odd"), (odd, "odd"))]
    refused = append_once(odd, table, "refused", F.col("total_amount") < 0)
    states = commit_log(spark).filter(F.col("table_name") == table).groupBy("state").agg(F.countDistinct("repair_id").alias("n"))
    counts = {r.state: r.n for r in states.collect()}
    return committed_rows(spark, table).agg(
        F.lit(before).cast("bigint").alias("rows_before"), F.lit(",".join(again)).alias("recovered"), F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("order_id").alias("n_orders"), F.round(F.sum("total_amount"), 2).alias("total"), F.lit(sum(c.repeated for c in calls)).cast("bigint").alias("repeated"),
        F.lit(refused.state).alias("refused"), F.lit(counts["committed"]).cast("bigint").alias("n_committed"),
    )


STOCK = "item VARCHAR, quantity INTEGER, price DOUBLE"


def _stock(spark, sf_dir):
    key = F.col("o_orderkey")
    quantity = F.when(key % 19 == 0, "12.5").when(key % 23 == 0, "99999999999").when(key % 29 == 0, "a few").otherwise((key % 1000).cast("string"))
    return I.pricing(spark, sf_dir).select(F.substring("product_id", 2, 20).cast("bigint").alias("o_orderkey"), F.col("product_id").alias("item"), "price").select(
        "item", quantity.alias("quantity"), "price"
    )


STOCK_SQL = f"""SELECT product_id AS item, CASE WHEN k % 19 = 0 THEN '12.5' WHEN k % 23 = 0 THEN '99999999999' WHEN k % 29 = 0 THEN 'a few'
  ELSE (k % 1000)::VARCHAR END AS quantity, price FROM (SELECT *, substring(product_id, 2)::BIGINT AS k FROM ({I.PRICING_SQL}))"""


def quarantined_values(spark, sf_dir):
    """Stock rows appended but for those that would lose a value; these are counted by column and reason, beside the report's count."""
    table = staging_table(spark, "stock")
    create_tables(spark, f"CREATE TABLE {table} ({STOCK})")
    source, dest = _stock(spark, sf_dir), spark.table(table).schema
    repair = propose_repair(source, dest)
    appended, aside = append_good_rows(source, table, repair)
    lost = clean_report(source, {c: dest[c].dataType for c in repair.cleaned}).select("column_name", "n_lost")
    in_table = spark.table(table).count()
    counts = aside.groupBy("column_name", "dest_type", "reason").agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("source_row").alias("n_rows"))
    return counts.join(lost, "column_name").withColumns({"appended": F.lit(appended).cast("bigint"), "in_table": F.lit(in_table).cast("bigint")})


QUERIES = {
    "renames_by_value": (renames_by_value, _shares_sql()),
    "key_format_search": (key_format_search, _formats_sql()),
    "key_format_join": (
        key_format_join,
        """SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "profile_of_parts": (profile_of_parts, _parts_sql()),
    "append_after_loss": (
        append_after_loss,
        f"""SELECT 0::BIGINT AS rows_before, 'even' AS recovered, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders, round(sum(total_amount), 2) AS total,
            2::BIGINT AS repeated, 'refused' AS refused, 2::BIGINT AS n_committed FROM ({I.SALES_SQL})""",
    ),
    "quarantined_values": (
        quarantined_values,
        f"""WITH s AS ({STOCK_SQL}),
            v AS (SELECT item, 'quantity' AS column_name, 'INTEGER' AS dest_type, CASE quantity WHEN '12.5' THEN 'no whole number' WHEN 'a few' THEN 'no number' ELSE 'out of range' END AS reason
                FROM s WHERE quantity IN ('12.5', 'a few', '99999999999')
              UNION ALL SELECT item, 'price', 'DOUBLE', 'no number' FROM s
                WHERE price IS NOT NULL AND trim(price) NOT IN ('N/A', '') AND TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) IS NULL),
            g AS (SELECT count(*) AS n FROM s WHERE item NOT IN (SELECT item FROM v))
            SELECT column_name, dest_type, reason, count(*) AS n_values, count(DISTINCT item) AS n_rows,
              CAST(sum(count(*)) OVER (PARTITION BY column_name) AS BIGINT) AS n_lost, any_value(g.n) AS appended, any_value(g.n) AS in_table FROM v, g GROUP BY 1, 2, 3""",
    ),
}
