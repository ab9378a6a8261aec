"""Smallest distinct values without a shuffle of all distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: distinct values shown per column.
SHOWN_VALUES = 10

BUCKETS = 1024


# Bytes at the start of a text that its code holds.
CODE_BYTES = 7


def _code(values: DataFrame, value: str) -> Column:
    """The value, or for a text the number that its first bytes stand for: it never falls as texts rise.

    Spark finds the smallest number per bucket in a hash table, but would sort all texts for the smallest text.
    """
    if not isinstance(values.schema[value].dataType, T.StringType):
        return F.col(value)
    start = F.hex(F.substring(F.encode(F.col(value), "utf-8"), 1, CODE_BYTES))
    return F.conv(F.rpad(start, 2 * CODE_BYTES, "0"), 16, 10).cast("bigint")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("_code"), F.lit(BUCKETS)).alias("bucket")


def smallest_distinct(values: DataFrame, value: str, shown: int = SHOWN_VALUES) -> DataFrame:
    """The ``shown`` smallest distinct values of a column, NULL first.

    A DISTINCT would shuffle every distinct value of the column. The smallest
    code per hash bucket takes a small shuffle, and the ``shown``-th of these is never below
    the code of the ``shown``-th smallest distinct value. So a second scan keeps the values
    up to that bound, and the result is exact. Texts that all begin alike are
    all kept and made distinct per task first.
    """
    coded = values.select(value, _code(values, value).alias("_code"))
    lowest = coded.filter("_code is not null").groupBy(_bucket()).agg(F.min("_code").alias("low"))
    head = lowest.select("low").orderBy("low").limit(shown)
    bound = head.agg(F.when(F.count("low") == shown, F.max("low"))).scalar()
    # NULL on either side keeps the row.
    kept = coded.filter(F.coalesce(F.col("_code") <= bound, F.lit(True))).select(value)
    return kept.distinct().orderBy(F.asc_nulls_first(value)).limit(shown)


def smallest_distinct_each(
    values: DataFrame, key: str, value: str, shown: int = SHOWN_VALUES
) -> DataFrame:
    """The same per key, for all keys in two scans; columns (key, value).

    ``key`` is the name of a table's column, so it has few values.
    """
    coded = values.select(key, value, _code(values, value).alias("_code"))
    lowest = coded.filter("_code is not null").groupBy(key, _bucket()).agg(F.min("_code").alias("bound"))
    order = Window.partitionBy(key).orderBy("bound")
    bounds = (
        lowest.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") == shown)
        .select(key, "bound")
    )
    # One row per column of a table at most.
    kept = coded.join(F.broadcast(bounds), key, "left").filter(
        F.coalesce(F.col("_code") <= F.col("bound"), F.lit(True))
    )
    ranked = Window.partitionBy(key).orderBy(F.asc_nulls_first(value))
    return (
        kept.select(key, value)
        .distinct()
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= shown)
        .select(key, value)
    )
