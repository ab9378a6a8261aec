"""Profiles that add up: what is stored for each part of a table merges to the profile of the whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named, rows_of
from pipecheck.functions.shapes import value_shape
from pipecheck.functions.types import sql_name, uncastable
from pipecheck.operators.value_match import SKETCH_BITS, plain_text

# Shapes that a state keeps count of; with fewer different ones their counts are exact, beyond that the most frequent are kept.
TRACKED = 2000

TOP = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
STATE = f"column_name string, dest_type string, n_rows bigint, n_null bigint, n_uncastable bigint, distinct_values binary, shapes {TOP}"


def column_states(df: DataFrame, targets: Mapping[str, T.DataType]) -> DataFrame:
    """One state per column of ``targets`` (column to its destination type), from one pass over the part.

    A state has the counts of rows, nulls and values that do not cast, a set sketch of the values and heavy hitters of the shapes of those that do
    not cast. Its size does not depend on the number of rows or of different values, and no value is shuffled.
    """
    counts, rows = [F.count(F.lit(1)).alias("n")], []
    for i, (column, dest_type) in enumerate(targets.items()):
        kind = df.schema[column].dataType
        bad = uncastable(named(column), kind, dest_type)
        shape = F.when(bad, value_shape(named(column), runs=True))
        counts += [
            F.count(named(column)).alias(f"present{i}"),
            F.count_if(bad).alias(f"bad{i}"),
            F.theta_sketch_agg(plain_text(named(column), kind), F.lit(SKETCH_BITS)).alias(f"set{i}"),
            F.call_function("approx_top_k_accumulate", shape, F.lit(TRACKED)).alias(f"top{i}"),
        ]
        rows.append(F.struct(F.lit(column), F.lit(sql_name(dest_type)), F.col("n"), F.col("n") - F.col(f"present{i}"), F.col(f"bad{i}"), F.col(f"set{i}"), F.col(f"top{i}")))
    return rows_of(df.agg(*counts), rows, STATE)


def merged_states(states: DataFrame) -> DataFrame:
    """The states of several parts as one per column; merging merged states is the same as merging all."""
    return states.groupBy("column_name", "dest_type").agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_uncastable")),
        F.theta_union_agg("distinct_values", F.lit(SKETCH_BITS)).alias("distinct_values"),
        F.call_function("approx_top_k_combine", F.col("shapes"), F.lit(TRACKED)).alias("shapes"),
    )


def profile(states: DataFrame, shown: int = 20) -> DataFrame:
    """column_name, dest_type, n_rows, n_null, n_uncastable, n_values and the ``shown`` most frequent shapes (shape, n) of merged states.

    ``n_values`` is exact below 2^SKETCH_BITS different values and an estimate beyond.
    """
    top = F.call_function("approx_top_k_estimate", F.col("shapes"), F.lit(shown + 1))
    known = F.filter(top, lambda s: s["item"].isNotNull())
    ordered = F.array_sort(F.transform(known, lambda s: F.struct((-s["count"]).alias("less"), s["item"].alias("shape"))))
    shapes = F.slice(F.transform(ordered, lambda s: F.struct(s["shape"].alias("shape"), (-s["less"]).alias("n"))), 1, shown)
    return states.select(
        "column_name", "dest_type", "n_rows", "n_null", "n_uncastable", F.theta_sketch_estimate("distinct_values").alias("n_values"), shapes.alias("shapes")
    )


def add_part(df: DataFrame, targets: Mapping[str, T.DataType], path: str) -> None:
    """Store the states of one more part; the parts before are not read."""
    column_states(df, targets).coalesce(1).write.mode("append").parquet(path)


def stored_profile(spark: SparkSession, path: str, shown: int = 20) -> DataFrame:
    """The profile of all parts stored so far, from their states alone."""
    return profile(merged_states(spark.read.schema(STATE).parquet(path)), shown)
