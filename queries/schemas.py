"""Schema profiles, comparisons, samples, dirty casts and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.operators import align, quality, schema
from pipecheck.plans.diagnose import catalog_rows, column_findings, diagnose, load_signs
from pipecheck.operators.classify import zero_row_join
from pipecheck.operators.keys import sql_join_keys
from pipecheck.sources.specs import parse_specs, valid
from pipecheck.functions.types import sql_name
from queries import inputs as I

# Targets of the dirty text columns.
PRICE = {"price": T.DoubleType(), "effective_date": T.DateType()}

# Log-like text columns and the number they are asked to be.
EVENT_TARGETS = {"props": T.DoubleType(), "event_type": T.IntegerType(), "user_id": T.IntegerType()}


def _all_tables(spark, sf_dir, operator) -> DataFrame:
    frames = [
        operator(I.table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in I.TABLES
    ]
    return reduce(DataFrame.unionByName, frames)


def table_profile(spark, sf_dir):
    return _all_tables(spark, sf_dir, schema.table_profile)


def column_typeof(spark, sf_dir):
    return _all_tables(spark, sf_dir, schema.column_types)


TABLE_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST(row_number() OVER () AS INTEGER) AS ordinal, column_name, column_type AS data_type,
        "null" = 'YES' AS nullable, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})"""
    for t in I.TABLES
)

# DuckDB has no column name as a value, so each column is written out.
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMN_TYPEOF_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, any_value(typeof({c})) AS data_type, count({c}) AS n_values FROM {t}"
    for t, columns in _COLUMNS.items()
    for c in columns.split()
)


def _dest_values(dest: T.StructType) -> str:
    rows = ", ".join(f"({i}, '{f.name}', '{sql_name(f.dataType)}')" for i, f in enumerate(dest, 1))
    return f"SELECT * FROM (VALUES {rows}) v(d_ord, d_name, d_type)"


def _compare_sql(source_sql: str, dest: T.StructType, wider: str, bad: str) -> str:
    """The comparison as a full outer join; ``wider`` and ``bad`` are CASE bodies by column."""
    return f"""
    SELECT CAST(row_number() OVER (ORDER BY d_ord NULLS LAST, s_ord) AS INTEGER) AS ordinal,
      s_name AS source_column, s_type AS source_type, d_name AS dest_column, d_type AS dest_type,
      CASE WHEN s_name IS NULL THEN 'MISSING IN SOURCE' WHEN d_name IS NULL THEN 'EXTRA IN SOURCE'
           WHEN s_type = d_type THEN 'OK' ELSE 'TYPE MISMATCH' END AS status,
      COALESCE(s_type <> d_type AND ({wider}), false) AS widening,
      (SELECT count(*) FROM ({source_sql})) AS n_rows,
      CASE WHEN s_type <> d_type THEN (CASE s_name {bad} END) END AS n_uncastable
    FROM (SELECT row_number() OVER () AS s_ord, column_name AS s_name, column_type AS s_type FROM (DESCRIBE {source_sql})) s
    FULL JOIN ({_dest_values(dest)}) d ON s.s_name = d.d_name"""


SALES_COMPARE = _compare_sql(
    I.SALES_SQL, I.STG_SALES, "false",
    f"WHEN 'customer_id' THEN (SELECT count(*) FROM ({I.SALES_SQL}) WHERE customer_id IS NOT NULL AND TRY_CAST(customer_id AS INTEGER) IS NULL)",
)
PRICING_BAD = (
    f"WHEN 'price' THEN (SELECT count(*) FROM ({I.PRICING_SQL}) WHERE price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL) "
    f"WHEN 'effective_date' THEN (SELECT count(*) FROM ({I.PRICING_SQL}) WHERE effective_date IS NOT NULL AND TRY_CAST(effective_date AS DATE) IS NULL)"
)
PRICING_COMPARE = _compare_sql(I.PRICING_SQL, I.FACT_PRICING, "false", PRICING_BAD)
LINEITEM_DEST = (
    T.StructType()
    .add("l_orderkey", "integer").add("l_partkey", "long").add("l_linenumber", "long")
    .add("l_quantity", "integer").add("l_comment", "string").add("l_returnflag", "double")
)
LINEITEM_COMPARE = _compare_sql(
    "SELECT * FROM lineitem", LINEITEM_DEST, "s_type = 'INTEGER' AND d_type IN ('BIGINT', 'DOUBLE')",
    """WHEN 'l_orderkey' THEN (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND TRY_CAST(l_orderkey AS INTEGER) IS NULL)
       WHEN 'l_linenumber' THEN 0
       WHEN 'l_quantity' THEN (SELECT count(*) FROM lineitem WHERE l_quantity IS NOT NULL AND TRY_CAST(l_quantity AS INTEGER) IS NULL)
       WHEN 'l_returnflag' THEN (SELECT count(*) FROM lineitem WHERE l_returnflag IS NOT NULL AND TRY_CAST(l_returnflag AS DOUBLE) IS NULL)""",
)


def schema_compare(spark, sf_dir):
    return schema.compare_schemas(I.table(spark, sf_dir, "lineitem"), LINEITEM_DEST)


def compare_all_sources(spark, sf_dir):
    return schema.compare_all_sources(
        {"sales": I.sales(spark, sf_dir), "lineitem": I.table(spark, sf_dir, "lineitem")}, I.STG_SALES
    )


def mismatch_samples(spark, sf_dir):
    return schema.mismatch_samples(I.pricing(spark, sf_dir), I.FACT_PRICING)


def sample_values(spark, sf_dir):
    samples = [
        schema.sample_values(I.table(spark, sf_dir, t), c)
        for t, c in (("lineitem", "l_partkey"), ("lineitem", "l_returnflag"), ("part", "p_name"))
    ]
    prices = schema.sample_values(I.pricing(spark, sf_dir), "price")
    return reduce(DataFrame.unionByName, [*samples, prices])


def _sample_sql(source: str, column: str, data_type: str) -> str:
    return f"""SELECT '{column}' AS column_name, '{data_type}' AS data_type, CAST(v AS VARCHAR) AS value, v IS NULL AS is_null
        FROM (SELECT DISTINCT {column} AS v FROM {source} ORDER BY v NULLS FIRST LIMIT 10)"""


SAMPLE_SQL = " UNION ALL ".join(
    [
        _sample_sql("lineitem", "l_partkey", "BIGINT"),
        _sample_sql("lineitem", "l_returnflag", "VARCHAR"),
        _sample_sql("part", "p_name", "VARCHAR"),
        _sample_sql(f"({I.PRICING_SQL})", "price", "VARCHAR"),
    ]
)
MISMATCH_SAMPLE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, v AS value, v IS NULL AS is_null FROM (
        SELECT DISTINCT {c} AS v FROM ({I.PRICING_SQL}) ORDER BY v NULLS FIRST LIMIT 10)"""
    for c in ("price", "effective_date")
)


def clean_cast(spark, sf_dir):
    price = quality.clean_cast(F.col("price"), T.DoubleType())
    return I.pricing(spark, sf_dir).select("product_id", price.alias("price"))


def clean_report(spark, sf_dir):
    return quality.clean_report(I.pricing(spark, sf_dir), {"price": T.DoubleType()})


def uncastable_profile(spark, sf_dir):
    prices = quality.uncastable_profile(I.pricing(spark, sf_dir), PRICE)
    return prices.unionByName(quality.uncastable_profile(I.table(spark, sf_dir, "events"), EVENT_TARGETS))


def uncastable_shapes(spark, sf_dir):
    return quality.uncastable_shapes(I.pricing(spark, sf_dir), PRICE)


def uncastable_runs(spark, sf_dir):
    return quality.uncastable_shapes(I.table(spark, sf_dir, "events"), EVENT_TARGETS, runs=True)


def _shape_sql(plus: str, value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '[A-Za-z]{plus}', 'A', 'g'), '[0-9]{plus}', '9', 'g')"


PRICE_CLEAN = "TRY_CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE)"
CLEAN_SQL = f"CASE WHEN trim(price) NOT IN ('N/A', '') THEN {PRICE_CLEAN} END"


def align_rename(spark, sf_dir):
    return align.align_to_schema(
        I.sales(spark, sf_dir), I.STG_SALES, {"total_amount": "amount"}, {"region": "UNKNOWN"}
    ).select("order_id", "amount", "order_date")


def align_default(spark, sf_dir):
    aligned = align.align_to_schema(
        I.customers(spark, sf_dir), I.DIM_CUSTOMERS, defaults={"region": "UNKNOWN"},
        values={"id": F.replace("customer_id", F.lit("CUST-"), F.lit(""))},
    )
    return aligned.filter(F.col("region") == "UNKNOWN")


def rename_candidates(spark, sf_dir):
    found = align.rename_candidates(I.sales(spark, sf_dir), I.STG_SALES)
    more = align.rename_candidates(I.table(spark, sf_dir, "documents"), _doc_dest())
    return found.unionByName(more)


def _doc_dest():
    return T.StructType().add("doc_key", "string").add("chars", "integer").add("lang", "string").add("author", "string")


RENAME_SQL = f"""
WITH pairs AS (
  SELECT d_name AS dest_column, d_type AS dest_type, s_name AS source_column, s_type AS source_type, n_rows,
    CASE WHEN d_type = s_type OR d_type = 'VARCHAR' THEN 0 ELSE bad END AS n_uncastable
  FROM (SELECT 'amount' AS d_name, 'DOUBLE' AS d_type UNION ALL SELECT 'region', 'VARCHAR') d,
       (SELECT 'total_amount' AS s_name, 'DOUBLE' AS s_type, count(*) AS n_rows, 0 AS bad FROM orders
        UNION ALL SELECT 'priority', 'VARCHAR', count(*), count(*) FROM orders) s
  UNION ALL
  SELECT d_name, d_type, s_name, s_type, n_rows, bad
  FROM (SELECT 'doc_key' AS d_name, 'VARCHAR' AS d_type, 'doc_id' AS s_name, 'BIGINT' AS s_type, count(*) AS n_rows, 0 AS bad FROM documents
        UNION ALL SELECT 'chars', 'INTEGER', 'n_chars', 'BIGINT', count(*), count(*) FILTER (n_chars IS NOT NULL AND TRY_CAST(n_chars AS INTEGER) IS NULL) FROM documents)
), scored AS (
  SELECT *, len(list_intersect(list_filter(string_split(dest_column, '_'), lambda t: length(t) > 1),
                               list_filter(string_split(source_column, '_'), lambda t: length(t) > 1))) AS shared_parts,
    n_uncastable = 0 AS all_cast, levenshtein(dest_column, source_column) AS name_distance FROM pairs
)
SELECT *, rank() OVER (PARTITION BY dest_column ORDER BY shared_parts DESC, all_cast DESC, name_distance) AS rank, false AS tie
FROM scored WHERE shared_parts > 0"""


def missing_columns(spark, sf_dir):
    found = align.missing_columns(I.sales(spark, sf_dir), I.STG_SALES)
    return found.unionByName(align.missing_columns(I.table(spark, sf_dir, "documents"), _doc_dest()))


def valid_specs(spark, sf_dir):
    return parse_specs(I.spec_texts(spark, sf_dir), "spec_text").select(
        "load_id", "spec.name", F.col("spec.destination.engine").alias("engine"), "spec_error"
    )


def resolve_sources(spark, sf_dir):
    specs = valid(parse_specs(I.spec_texts(spark, sf_dir), "spec_text"))
    return schema.resolve_sources(specs, "spec.source").select("load_id", "source_table")


SPEC_STATE = """
  CASE WHEN event_type = 'error' THEN 'source.type is missing'
       WHEN event_id % 9 = 4 THEN 'transform.sql is missing'
       WHEN event_id % 10 = 3 THEN 'unknown engine' END"""


def zero_row_joins(spark, sf_dir):
    return I.loads(spark, sf_dir).filter(zero_row_join(F.col("log"), F.col("sql"))).select("load_id", "source_table")


def load_join_keys(spark, sf_dir):
    return sql_join_keys(I.loads(spark, sf_dir)).select(
        "load_id", "left_table", "left_alias", "left_column", "right_table", "right_alias", "right_column"
    )


def _load_tables(spark, sf_dir):
    return {
        ("sales", "stg_sales"): (I.sales(spark, sf_dir), I.STG_SALES),
        ("customers", "dim_customers"): (I.customers(spark, sf_dir).drop("customer_id"), I.DIM_CUSTOMERS),
        ("pricing", "fact_pricing"): (I.pricing(spark, sf_dir), I.FACT_PRICING),
        ("nation", "nation"): (I.table(spark, sf_dir, "nation"), I.table(spark, sf_dir, "nation").schema),
    }


ENRICHED = T.StructType().add("order_id", T.LongType()).add("name", T.StringType()).add("total", T.DoubleType())


def _all_loads(spark, sf_dir):
    """One row per load and source table; a load that joins reads orders and customers."""
    loads = load_signs(I.loads(spark, sf_dir))
    other = loads.filter("dest_table = 'enriched'").withColumn("source_table", F.lit("customers"))
    return loads.unionByName(other)


def failure_kind(spark, sf_dir):
    """Kind of every load: findings per table pair from whole tables, joined to all loads."""

    tables = {
        **_load_tables(spark, sf_dir),
        ("orders", "enriched"): (I.orders(spark, sf_dir), ENRICHED),
        ("customers", "enriched"): (I.customers(spark, sf_dir), ENRICHED),
    }

    def per_pair(operator) -> DataFrame:
        frames = [
            operator(source, dest).select(
                F.lit(pair[0]).alias("source_table"), F.lit(pair[1]).alias("dest_table"), "*"
            )
            for pair, (source, dest) in tables.items()
        ]
        return reduce(DataFrame.unionByName, frames)

    findings = column_findings(per_pair(schema.compare_schemas), per_pair(align.candidate_columns))
    return diagnose(_all_loads(spark, sf_dir), findings)


def catalog_compare(spark, sf_dir):
    """Statuses for the table pairs of all loads from a column catalogue."""
    pairs = _load_tables(spark, sf_dir)
    tables = {name: df for (name, _), (df, _) in pairs.items()}
    dests = {
        name: spark.createDataFrame([], dest) for (_, name), (_, dest) in pairs.items() if name not in tables
    }
    columns = spark.createDataFrame(
        catalog_rows({**tables, **dests}), "table_name string, ordinal int, column_name string, data_type string"
    )
    loads = I.loads(spark, sf_dir)
    status = schema.compare_catalogs(columns, loads)
    uses = loads.groupBy("source_table", "dest_table").agg(F.count(F.lit(1)).alias("n_loads"))
    return status.join(uses, ["source_table", "dest_table"]).groupBy("source_table", "dest_table", "status", "n_loads").agg(
        F.count(F.lit(1)).alias("n_columns"), F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("columns")
    )


QUERIES = {
    "table_profile": (table_profile, TABLE_PROFILE_SQL),
    "column_typeof": (column_typeof, COLUMN_TYPEOF_SQL),
    "schema_compare": (schema_compare, LINEITEM_COMPARE),
    "compare_all_sources": (
        compare_all_sources,
        f"SELECT 'sales' AS source_table, * FROM ({SALES_COMPARE}) UNION ALL SELECT 'lineitem', * FROM ({_compare_sql('SELECT * FROM lineitem', I.STG_SALES, 'false', 'WHEN NULL THEN 0')})",
    ),
    "mismatch_samples": (mismatch_samples, MISMATCH_SAMPLE_SQL),
    "sample_values": (sample_values, SAMPLE_SQL),
    "clean_cast": (clean_cast, f"SELECT product_id, {CLEAN_SQL} AS price FROM ({I.PRICING_SQL})"),
    "clean_report": (
        clean_report,
        f"""WITH p AS (SELECT price, {CLEAN_SQL} AS c, price <> replace(replace(price, '$', ''), ',', '') AS t FROM ({I.PRICING_SQL}))
            SELECT 'price' AS column_name, count(*) FILTER (c IS NOT NULL AND NOT t) AS n_kept, count(*) FILTER (c IS NOT NULL AND t) AS n_cleaned,
            count(*) FILTER (trim(price) IN ('N/A', '')) AS n_nulled, count(*) FILTER (price IS NOT NULL AND trim(price) NOT IN ('N/A', '') AND c IS NULL) AS n_lost FROM p""",
    ),
    "uncastable_profile": (
        uncastable_profile,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, '{t}' AS dest_type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null,
                count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL) AS n_uncastable FROM ({s})"""
            for s, c, t in (
                (I.PRICING_SQL, "price", "DOUBLE"), (I.PRICING_SQL, "effective_date", "DATE"),
                ("SELECT * FROM events", "props", "DOUBLE"), ("SELECT * FROM events", "event_type", "INTEGER"),
                ("SELECT * FROM events", "user_id", "INTEGER"),
            )
        ),
    ),
    "uncastable_shapes": (
        uncastable_shapes,
        f"""SELECT 'price' AS column_name, {_shape_sql('', 'price')} AS shape, count(*) AS n_values, min(price) AS example
            FROM ({I.PRICING_SQL}) WHERE price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL GROUP BY 2""",
    ),
    "uncastable_runs": (
        uncastable_runs,
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, {_shape_sql('+', c)} AS shape, count(*) AS n_values, min({c}) AS example
                FROM events WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL GROUP BY 2"""
            for c in ("props", "event_type")
        ),
    ),
    "align_rename": (
        align_rename,
        f"SELECT order_id, total_amount AS amount, order_date FROM ({I.SALES_SQL})",
    ),
    "align_default": (
        align_default,
        f"SELECT CAST(replace(customer_id, 'CUST-', '') AS INTEGER) AS id, name, 'UNKNOWN' AS region, segment, balance FROM ({I.CUSTOMERS_SQL})",
    ),
    "rename_candidates": (rename_candidates, RENAME_SQL),
    "missing_columns": (
        missing_columns,
        """SELECT 'region' AS dest_column, 'VARCHAR' AS dest_type, count(*) AS n_rows FROM orders
           UNION ALL SELECT 'author', 'VARCHAR', count(*) FROM documents""",
    ),
    "valid_specs": (
        valid_specs,
        f"""SELECT event_id AS load_id, concat('load_', event_id) AS name,
            CASE WHEN event_id % 10 = 3 THEN 'oracle' WHEN event_id % 2 = 0 THEN 'duckdb' ELSE 'sqlite' END AS engine,
            {SPEC_STATE} AS spec_error FROM events""",
    ),
    "resolve_sources": (
        resolve_sources,
        f"""SELECT event_id AS load_id, unnest(CASE event_type WHEN 'click' THEN ['orders', 'customers']
              WHEN 'view' THEN [concat('v', user_id, '.2024')] WHEN 'purchase' THEN [concat('p', user_id)] ELSE [] END) AS source_table
            FROM events WHERE {SPEC_STATE} IS NULL""",
    ),
    "zero_row_joins": (
        zero_row_joins,
        f"SELECT load_id, source_table FROM ({I.LOADS_SQL}) WHERE regexp_matches(lower(log), '\\b0 rows?\\b') AND upper(sql) LIKE '%JOIN%'",
    ),
    "sql_join_keys": (
        load_join_keys,
        f"""SELECT load_id, 'orders' AS left_table, regexp_extract(sql, '(?i)ON (\\w+)\\.', 1) AS left_alias,
            regexp_extract(sql, '(?i)ON \\w+\\.(\\w+)', 1) AS left_column, 'customers' AS right_table,
            regexp_extract(sql, '(?i)= (\\w+)\\.', 1) AS right_alias, regexp_extract(sql, '(?i)= \\w+\\.(\\w+)', 1) AS right_column
            FROM ({I.LOADS_SQL}) WHERE upper(sql) LIKE '%JOIN%'""",
    ),
    "failure_kind": (
        failure_kind,
        f"""WITH columns AS (
              SELECT 'sales' AS t, column_name AS c FROM (DESCRIBE {I.SALES_SQL})
              UNION ALL SELECT 'customers', column_name FROM (DESCRIBE {I.CUSTOMERS_SQL}) WHERE column_name <> 'customer_id'
              UNION ALL SELECT 'pricing', column_name FROM (DESCRIBE {I.PRICING_SQL})
              UNION ALL SELECT 'orders', column_name FROM (DESCRIBE {I.ORDERS_SQL})
              UNION ALL SELECT 'orders', column_name FROM (DESCRIBE {I.CUSTOMERS_SQL})
              UNION ALL SELECT 'nation', column_name FROM (DESCRIBE nation)),
            dests AS (SELECT 'sales' AS t, d_name AS d FROM ({_dest_values(I.STG_SALES)})
              UNION ALL SELECT 'customers', d_name FROM ({_dest_values(I.DIM_CUSTOMERS)})
              UNION ALL SELECT 'pricing', d_name FROM ({_dest_values(I.FACT_PRICING)})
              UNION ALL SELECT 'orders', d_name FROM ({_dest_values(ENRICHED)})
              UNION ALL SELECT 'nation', column_name FROM (DESCRIBE nation)),
            absent AS (SELECT t, d, EXISTS (SELECT 1 FROM columns c WHERE c.t = dests.t AND c.c NOT IN (SELECT d FROM dests e WHERE e.t = dests.t)
                AND len(list_intersect(list_filter(string_split(lower(c.c), '_'), lambda x: length(x) > 1), string_split(lower(d), '_'))) > 0) AS named
              FROM dests WHERE NOT EXISTS (SELECT 1 FROM columns c WHERE c.t = dests.t AND c.c = dests.d)),
            l AS (SELECT *, regexp_matches(lower(log), '\\b0 rows?\\b') AND upper(sql) LIKE '%JOIN%' AS zero_rows,
              EXISTS (SELECT 1 FROM absent WHERE t = source_table AND named) AS has_renamed,
              EXISTS (SELECT 1 FROM absent WHERE t = source_table AND NOT named) AS has_missing,
              source_table = 'pricing' AND EXISTS (SELECT 1 FROM ({I.PRICING_SQL}) WHERE price IS NOT NULL AND TRY_CAST(price AS DOUBLE) IS NULL) AS has_bad_cast
              FROM ({I.LOADS_SQL}))
            SELECT load_id, zero_rows, has_renamed, has_missing, has_bad_cast,
              CASE WHEN zero_rows THEN 'join_key_format_mismatch' WHEN has_renamed THEN 'column_name_mismatch'
                   WHEN has_missing THEN 'missing_column' WHEN has_bad_cast THEN 'type_cast_error' ELSE 'unknown' END AS failure_kind FROM l""",
    ),
    "catalog_compare": (
        catalog_compare,
        f"""WITH n AS (SELECT source_table, dest_table, count(*) AS n_loads FROM ({I.LOADS_SQL}) GROUP BY 1, 2),
            s AS (SELECT 'sales' AS t, column_name AS c, column_type AS y FROM (DESCRIBE {I.SALES_SQL})
              UNION ALL SELECT 'customers', column_name, column_type FROM (DESCRIBE {I.CUSTOMERS_SQL}) WHERE column_name <> 'customer_id'
              UNION ALL SELECT 'pricing', column_name, column_type FROM (DESCRIBE {I.PRICING_SQL})
              UNION ALL SELECT 'nation', column_name, column_type FROM (DESCRIBE nation)),
            d AS (SELECT 'stg_sales' AS t, d_name AS c, d_type AS y FROM ({_dest_values(I.STG_SALES)})
              UNION ALL SELECT 'dim_customers', d_name, d_type FROM ({_dest_values(I.DIM_CUSTOMERS)})
              UNION ALL SELECT 'fact_pricing', d_name, d_type FROM ({_dest_values(I.FACT_PRICING)})
              UNION ALL SELECT 'nation', column_name, column_type FROM (DESCRIBE nation)),
            p AS (SELECT n.*, s.c, s.y AS sy, NULL AS dy FROM n JOIN s ON s.t = n.source_table WHERE dest_table <> 'enriched'
              UNION ALL SELECT n.*, d.c, NULL, d.y FROM n JOIN d ON d.t = n.dest_table WHERE dest_table <> 'enriched'),
            g AS (SELECT source_table, dest_table, n_loads, c, max(sy) AS sy, max(dy) AS dy FROM p GROUP BY 1, 2, 3, 4)
            SELECT source_table, dest_table, CASE WHEN sy IS NULL THEN 'MISSING IN SOURCE' WHEN dy IS NULL THEN 'EXTRA IN SOURCE'
              WHEN sy = dy THEN 'OK' ELSE 'TYPE MISMATCH' END AS status, n_loads, count(*) AS n_columns, string_agg(c, ',' ORDER BY c) AS columns
            FROM g GROUP BY 1, 2, 3, 4""",
    ),
}
