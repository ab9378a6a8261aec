"""Profiles, comparisons and samples of table schemas."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import each, named, rows_of
from pipecheck.functions.types import is_widening, sql_name, uncastable
from pipecheck.operators.samples import SHOWN_VALUES, smallest_distinct, smallest_distinct_each

# Results of a comparison, per column.
OK = "OK"
TYPE_MISMATCH = "TYPE MISMATCH"
MISSING = "MISSING IN SOURCE"
EXTRA = "EXTRA IN SOURCE"

PROFILE = "ordinal int, column_name string, data_type string, nullable boolean, row_count bigint"
COMPARISON = (
    "ordinal int, source_column string, source_type string, dest_column string, "
    "dest_type string, status string, widening boolean, n_rows bigint, n_uncastable bigint"
)


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type and nullable flag of every column, with the row count."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    rows = [
        F.struct(F.lit(i), F.lit(f.name), F.lit(sql_name(f.dataType)), F.lit(f.nullable), F.col("n"))
        for i, f in enumerate(df.schema, 1)
    ]
    return rows_of(counted, rows, PROFILE)


def column_types(df: DataFrame) -> DataFrame:
    """Type of every column and how many values it has."""
    fields = list(df.schema)
    counted = df.agg(*[F.count(named(f.name)).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(F.lit(f.name), F.lit(sql_name(f.dataType)), F.col(f"n{i}"))
        for i, f in enumerate(fields)
    ]
    return rows_of(counted, rows, "column_name string, data_type string, n_values bigint")


def mismatched(source: DataFrame, dest: T.StructType) -> list[tuple[T.StructField, T.StructField]]:
    """Source and destination fields of the same name and different types."""
    have = {f.name: f for f in source.schema}
    return [
        (have[f.name], f)
        for f in dest
        if f.name in have and sql_name(have[f.name].dataType) != sql_name(f.dataType)
    ]


def compare_schemas(source: DataFrame, dest: T.StructType) -> DataFrame:
    """Destination columns in order with their status, then source-only columns.

    A type mismatch carries the number of values that do not cast, counted for
    all such columns in one pass that reads no other column.
    """
    have = {f.name: f for f in source.schema}
    counts = {
        s.name: F.count_if(uncastable(named(s.name), s.dataType, d.dataType)).alias(f"bad{i}")
        for i, (s, d) in enumerate(mismatched(source, dest))
    }
    bad = {name: F.col(f"bad{i}") for i, name in enumerate(counts)}
    counted = source.agg(F.count(F.lit(1)).alias("n"), *counts.values())

    def row(i: int, s: T.StructField | None, d: T.StructField | None) -> Column:
        if s is None:
            status = MISSING
        elif d is None:
            status = EXTRA
        else:
            status = TYPE_MISMATCH if s.name in bad else OK
        wider = status == TYPE_MISMATCH and is_widening(s.dataType, d.dataType)
        sides = [F.lit(v) for f in (s, d) for v in ((f.name, sql_name(f.dataType)) if f else (None, None))]
        n_bad = bad[s.name] if status == TYPE_MISMATCH else F.lit(None)
        return F.struct(F.lit(i), *sides, F.lit(status), F.lit(wider), F.col("n"), n_bad)

    pairs = [(have.get(d.name), d) for d in dest]
    pairs += [(s, None) for s in source.schema if s.name not in dest.names]
    return rows_of(counted, [row(i, s, d) for i, (s, d) in enumerate(pairs, 1)], COMPARISON)


def compare_all_sources(sources: Mapping[str, DataFrame], dest: T.StructType) -> DataFrame:
    """Comparison of each source table with the destination."""
    frames = [
        compare_schemas(df, dest).select(F.lit(name).alias("source_table"), "*")
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def compare_catalogs(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Status per column for many table pairs at once, from a column catalogue.

    ``columns(table_name, ordinal, column_name, data_type)`` and
    ``pairs(source_table, dest_table)``; pairs with an unknown table are left out.
    Asking for a pair many times costs one comparison.
    """
    wanted = pairs.select("source_table", "dest_table").distinct()
    known = columns.select("table_name").distinct()
    for side in ("source_table", "dest_table"):
        wanted = wanted.join(known.withColumnRenamed("table_name", side), side, "left_semi")

    def side(name: str, prefix: str) -> DataFrame:
        return wanted.join(columns.withColumnRenamed("table_name", name), name).select(
            "source_table",
            "dest_table",
            "column_name",
            F.col("ordinal").alias(f"{prefix}_ordinal"),
            F.col("data_type").alias(f"{prefix}_type"),
        )

    both = side("source_table", "source").join(
        side("dest_table", "dest"), ["source_table", "dest_table", "column_name"], "full"
    )
    status = (
        F.when(F.col("source_type").isNull(), MISSING)
        .when(F.col("dest_type").isNull(), EXTRA)
        .when(F.upper("source_type") == F.upper("dest_type"), OK)
        .otherwise(TYPE_MISMATCH)
    )
    return both.withColumn("status", status)


def _as_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value as text) of some columns."""
    pairs = [F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def mismatch_samples(source: DataFrame, dest: T.StructType, shown: int = SHOWN_VALUES) -> DataFrame:
    """Smallest distinct source values, as text, of every type-mismatched column."""
    columns = [s.name for s, _ in mismatched(source, dest)]
    if not columns:
        return source.sparkSession.createDataFrame(
            [], "column_name string, value string, is_null boolean"
        )
    samples = smallest_distinct_each(_as_rows(source, columns), "column_name", "value", shown)
    return samples.withColumn("is_null", F.col("value").isNull())


def sample_values(df: DataFrame, column: str, shown: int = SHOWN_VALUES) -> DataFrame:
    """Smallest distinct values of one column, in the order of its own type."""
    samples = smallest_distinct(df.select(named(column).alias("value")), "value", shown)
    return samples.select(
        F.lit(column).alias("column_name"),
        F.lit(sql_name(df.schema[column].dataType)).alias("data_type"),
        F.col("value").cast("string").alias("value"),
        F.col("value").isNull().alias("is_null"),
    )


def resolve_sources(specs: DataFrame, source: str = "source") -> DataFrame:
    """One row per source table of a description: its list, else its file's stem."""
    tables, path = F.col(f"{source}.tables"), F.col(f"{source}.path")
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?/*$", 1)
    names = F.when(F.size(tables) > 0, tables).when(
        F.coalesce(F.length(path), F.lit(0)) > 0, F.array(stem)
    )
    return each(specs.withColumn("source_tables", names), "source_tables", "source_table")
