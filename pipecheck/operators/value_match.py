"""Renamed columns found by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named, rows_of
from pipecheck.functions.types import sql_name
from pipecheck.operators.align import absent_columns, extra_columns

# A sketch keeps 2^SKETCH_BITS hashes of a column; a set below that size is counted exactly.
SKETCH_BITS = 12
# An estimated share may be wrong by so much before its pair is dropped: five standard errors.
MARGIN = 5 / (1 << SKETCH_BITS) ** 0.5

# Fixed value: share of a column's values that must be known to the other.
LEAST_SHARE = 0.8


def plain_text(column: Column, data_type: T.DataType) -> Column:
    """A value as text, the same for equal values of different types: whole numbers without a point, texts trimmed."""
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = column.try_cast("bigint")
        return F.when(whole.cast(data_type) == column, whole.cast("string")).otherwise(column.cast("string"))
    if isinstance(data_type, T.StringType):
        return F.nullif(F.trim(column), F.lit(""))
    return column.cast("string")


def comparable(left: T.DataType, right: T.DataType) -> bool:
    """Whether two columns may hold the same values: numbers with numbers, texts with all, else equal types."""
    numbers = (T.IntegralType, T.FractionalType)
    if isinstance(left, numbers) and isinstance(right, numbers):
        return True
    return isinstance(left, T.StringType) or isinstance(right, T.StringType) or left == right


def column_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a set sketch per column (s0, s1, ...), from one pass that reads these columns only.

    Sketches are merged from those of the tasks: no distinct value is shuffled. Sketches of parts of a table,
    stored earlier, merge to that of the whole by ``theta_union``.
    """
    sketches = [
        F.theta_sketch_agg(plain_text(named(c), df.schema[c].dataType), F.lit(SKETCH_BITS)).alias(f"s{i}") for i, c in enumerate(columns)
    ]
    return df.agg(*sketches)


def value_candidates(source: DataFrame, dest_rows: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """dest_column, source_column, share: source-only columns whose values mostly stand in an absent column of the destination.

    ``dest_rows`` are rows that the destination has already. ``share`` is estimated from sketches; pairs that are below ``least``
    by more than the sketches' error are left out, no other pair is. One pass over each table, then rows about columns only.
    """
    extra, absent = extra_columns(source, dest_rows.schema), absent_columns(source, dest_rows.schema)
    pairs = [(i, j) for i, s in enumerate(extra) for j, d in enumerate(absent) if comparable(s.dataType, d.dataType)]
    key = F.lit(1).alias("one")
    left = column_sketches(source, [f.name for f in extra]).select(key, "*") if pairs else source.sparkSession.range(1).select(key)
    right = column_sketches(dest_rows, [f.name for f in absent]) if pairs else source.sparkSession.range(1).select()
    right = right.select(key, *(F.col(c).alias(f"d{c}") for c in right.columns))
    rows = []
    for i, j in pairs:
        shared = F.theta_sketch_estimate(F.theta_intersection(f"s{i}", f"ds{j}"))
        rows.append(F.struct(F.lit(absent[j].name), F.lit(extra[i].name), shared / F.nullif(F.theta_sketch_estimate(f"s{i}"), F.lit(0))))
    found = rows_of(left.join(right, "one"), rows, "dest_column string, source_column string, share double")
    return found.filter(F.col("share") >= least - MARGIN)


def exact_shares(source: DataFrame, dest_rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """dest_column, source_column, n_rows, n_rows_found, n_values, n_found of pairs (destination column, source column), counted exactly.

    All pairs are counted in one pass over each table and one aggregation per value, so a value with most of the rows is combined before
    the shuffle.
    """
    if not pairs:
        return rows_of(source, [], "dest_column string, source_column string, n_rows bigint, n_rows_found bigint, n_values bigint, n_found bigint")

    def sided(df: DataFrame, of: int, here: int) -> DataFrame:
        values = [
            F.struct(F.lit(n).alias("pair"), plain_text(named(p[of]), df.schema[p[of]].dataType).alias("value")) for n, p in enumerate(pairs)
        ]
        marks = [F.lit(v).cast("bigint").alias(c) for c, v in (("l", here), ("r", 1 - here))]
        return df.select(F.inline(F.array(*values)), *marks).filter("value is not null")

    per_value = sided(source, 1, 1).unionByName(sided(dest_rows, 0, 0)).groupBy("pair", "value").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    met = (F.col("l") > 0) & (F.col("r") > 0)
    counted = per_value.groupBy("pair").agg(
        F.sum("l").alias("n_rows"), F.coalesce(F.sum(F.when(met, F.col("l"))), F.lit(0)).alias("n_rows_found"),
        F.count_if(F.col("l") > 0).alias("n_values"), F.count_if(met).alias("n_found"),
    )
    names = F.array(*(F.struct(F.lit(d).alias("dest_column"), F.lit(s).alias("source_column")) for d, s in pairs))
    return counted.withColumn("names", F.get(names, F.col("pair"))).select("names.*", "n_rows", "n_rows_found", "n_values", "n_found")


def renames_by_value(source: DataFrame, dest_rows: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Source-only columns that may be an absent destination column by their values, ranked, with exact counts.

    Names say nothing here: ``territory`` is found for ``region``. A pair holds if at least ``least`` of the different source
    values stand in the destination's column. A larger share wins, then more values; equal firsts are a tie. Columns without values
    and destinations without rows give none. Only names of columns come to the driver.
    """
    sure = value_candidates(source, dest_rows, least).select("dest_column", "source_column").collect()
    counted = exact_shares(source, dest_rows, [(r.dest_column, r.source_column) for r in sure])
    share = F.round(F.col("n_found") / F.col("n_values"), 6)
    kept = counted.filter(F.col("n_found") >= least * F.col("n_values")).withColumn("share", share)
    best = Window.partitionBy("dest_column").orderBy(F.desc("share"), F.desc("n_found"))
    ranked = kept.withColumn("rank", F.rank().over(best).cast("bigint"))
    return ranked.withColumn("tie", F.count(F.lit(1)).over(Window.partitionBy("dest_column", "rank")) > 1)
