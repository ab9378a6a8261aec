"""From descriptions, logs and schema findings to the kind of each failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.functions.types import sql_name
from pipecheck.operators.classify import failure_kind, zero_row_join
from pipecheck.operators.schema import MISSING, TYPE_MISMATCH

FLAGS = ("has_renamed", "has_missing", "has_bad_cast")


def column_findings(comparisons: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is wrong per (source_table, dest_table, dest_column).

    ``comparisons(source_table, dest_table, dest_column, status, n_uncastable)`` and
    ``candidates(source_table, dest_table, dest_column)``.
    """
    key = ["source_table", "dest_table", "dest_column"]
    named = candidates.select(*key).distinct().withColumn("named", F.lit(True))
    bad = (F.col("status") == TYPE_MISMATCH) & (F.col("n_uncastable") > 0)
    return comparisons.filter("dest_column is not null").join(named, key, "left").select(
        *key,
        (F.col("status") == MISSING).alias("absent"),
        F.coalesce("named", F.lit(False)).alias("named"),
        F.coalesce(bad, F.lit(False)).alias("bad"),
    )


def load_signs(loads: DataFrame) -> DataFrame:
    """Loads with ``zero_rows`` in place of their ``sql`` and ``log`` texts."""
    return loads.withColumn("zero_rows", zero_row_join(F.col("log"), F.col("sql"))).drop("sql", "log")


def diagnose(loads: DataFrame, findings: DataFrame) -> DataFrame:
    """Failure kind of every load.

    ``loads(load_id, source_table, dest_table, zero_rows)`` has one row per load and
    source table. A destination column is absent from a load only if all its tables lack
    it, and renamed if then any of them has a column that may stand for it. Loads over the same
    tables share one verdict: the findings meet the different sets of tables, not the loads.
    """
    pair = F.struct("source_table", "dest_table")
    sets = loads.groupBy("load_id").agg(
        F.max("zero_rows").alias("zero_rows"), F.array_sort(F.collect_set(pair)).alias("tables")
    )
    wanted = sets.select("tables").distinct().select("tables", F.explode("tables").alias("p")).select("tables", "p.*")
    columns = (
        wanted.join(findings, ["source_table", "dest_table"])
        .groupBy("tables", "dest_table", "dest_column")
        .agg(F.min("absent").alias("absent"), F.max("named").alias("named"), F.max("bad").alias("bad"))
    )
    flags = columns.groupBy("tables").agg(
        F.max(F.col("absent") & F.col("named")).alias("has_renamed"),
        F.max(F.col("absent") & ~F.col("named")).alias("has_missing"),
        F.max("bad").alias("has_bad_cast"),
    )
    found = sets.join(flags, "tables", "left")
    one = found.select("load_id", "zero_rows", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])
    kind = failure_kind(F.col("zero_rows"), *[F.col(f) for f in FLAGS])
    return one.withColumn("failure_kind", kind)


def catalog_rows(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """Rows (table_name, ordinal, column_name, data_type) for a column catalogue."""
    return [
        (name, i, f.name, sql_name(f.dataType))
        for name, df in tables.items()
        for i, f in enumerate(df.schema, 1)
    ]
