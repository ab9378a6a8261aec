"""Column references by exact name and rows out of one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def rows_of(aggregate: DataFrame, rows: Sequence[Column], schema: str) -> DataFrame:
    """Turn a one-row aggregate into one row per struct, in one pass over the data."""
    if not rows:
        # A filter that is never true lets Spark drop whatever builds on this.
        none = F.lit(None).cast(f"struct<{schema}>").alias("row")
        return aggregate.sparkSession.range(1).filter(F.lit(False)).select(none).select("row.*")
    return aggregate.select(F.inline(F.array(*[r.cast(f"struct<{schema}>") for r in rows])))


def each(df: DataFrame, array: str, element: str) -> DataFrame:
    """One row per array element, the array itself dropped.

    The outer form, because for the inner one Spark adds a filter on the array's
    size under the scan, and an array from a pattern would be worked out twice.
    """
    rest = [named(c) for c in df.columns if c != array]
    rows = df.select(*rest, F.explode_outer(array).alias(element))
    return rows.filter(named(element).isNotNull())
