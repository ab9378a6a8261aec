"""Places of rows in large sorted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipecheck.session import written


def group_key(value: Column) -> Column:
    """A value as a key that is never null and sorts alike: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit(":"), value.cast("string")), F.lit(""))


def placed(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with ``place`` (from 0, in their group) and ``size`` (of the group), as a plan over a written table.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks and none is held by one.
    A written row knows its task (run) and its number there; what goes before comes from one small row for each group
    and run. ``group`` must not be null. Rows that agree in group and order take neighbouring places. Hand in a
    written table: Spark reads it twice, once for the bounds of the ranges. Clashing columns run, at, place, size are replaced.
    """
    rows = df.drop("run", "at", "place", "size")
    keys = [F.col(group), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = written(dealt.withColumn("run", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    runs = held.groupBy(group, "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col(group).alias("_group"), F.col("run").alias("_run"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("n").over(Window.partitionBy(group)).alias("size"),
    )
    met = held.join(starts, (F.col(group) == F.col("_group")) & (F.col("run") == F.col("_run")))
    return met.select(*rows.columns, (F.col("at") + F.col("_shift")).alias("place"), "size")
