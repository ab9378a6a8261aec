"""Values that do not cast, and their repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named, rows_of
from pipecheck.functions.shapes import value_shape
from pipecheck.functions.types import safe_cast, sql_name, uncastable

# Texts that stand for no value, and signs inside amounts.
NULL_TOKENS = ("N/A", "")
SYMBOLS = ("$", ",")

Targets = Mapping[str, T.DataType]


def _uncastable(df: DataFrame, column: str, dest_type: T.DataType) -> Column:
    return uncastable(named(column), df.schema[column].dataType, dest_type)


def uncastable_profile(df: DataFrame, targets: Targets) -> DataFrame:
    """Rows, NULLs and values that do not cast, for all columns in one pass."""
    counts = [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, (column, dest_type) in enumerate(targets.items()):
        counts.append(F.count(named(column)).alias(f"present{i}"))
        counts.append(F.count_if(_uncastable(df, column, dest_type)).alias(f"bad{i}"))
        rows.append(
            F.struct(
                F.lit(column),
                F.lit(sql_name(dest_type)),
                F.col("n"),
                F.col("n") - F.col(f"present{i}"),
                F.col(f"bad{i}"),
            )
        )
    schema = "column_name string, dest_type string, n_rows bigint, n_null bigint, n_uncastable bigint"
    return rows_of(df.agg(*counts), rows, schema)


def uncastable_shapes(df: DataFrame, targets: Targets, runs: bool = False) -> DataFrame:
    """Every pattern of values that do not cast, with its count and an example.

    Only offending values leave the scan; counts are combined before the shuffle.
    """
    offenders = [
        F.when(
            _uncastable(df, column, dest_type),
            F.struct(F.lit(column).alias("column_name"), named(column).cast("string").alias("value")),
        )
        for column, dest_type in targets.items()
    ]
    values = df.select(F.inline(F.array(*offenders))).filter(F.col("column_name").isNotNull())
    # Spark sorts for a minimum of texts: it is taken of the few different values of a shape and column only.
    shaped = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "shape", value_shape(F.col("value"), runs)
    )
    return shaped.groupBy("column_name", "shape").agg(
        F.sum("n").alias("n_values"), F.min("value").alias("example")
    )


def without_symbols(column: Column, symbols: Sequence[str] = SYMBOLS) -> Column:
    for symbol in symbols:
        column = F.replace(column, F.lit(symbol), F.lit(""))
    return column


def clean_cast(
    column: Column,
    dest_type: T.DataType,
    null_tokens: Sequence[str] = NULL_TOKENS,
    symbols: Sequence[str] = SYMBOLS,
    strict: bool = False,
) -> Column:
    """Null tokens become NULL, signs are cut, the rest is cast.

    What still does not cast becomes NULL, or fails the query when ``strict``.
    """
    text = without_symbols(column, symbols)
    cast = text.cast(dest_type) if strict else safe_cast(text, T.StringType(), dest_type)
    return F.when(~F.trim(column).isin(*null_tokens), cast)


def loses_value(
    column: Column,
    dest_type: T.DataType,
    null_tokens: Sequence[str] = NULL_TOKENS,
    symbols: Sequence[str] = SYMBOLS,
) -> Column:
    """Whether a clean cast makes NULL of a value that is no null token; never NULL itself."""
    clean = clean_cast(column, dest_type, null_tokens, symbols)
    return column.isNotNull() & ~F.coalesce(F.trim(column).isin(*null_tokens), F.lit(True)) & clean.isNull()


def clean_report(
    df: DataFrame,
    targets: Targets,
    null_tokens: Sequence[str] = NULL_TOKENS,
    symbols: Sequence[str] = SYMBOLS,
) -> DataFrame:
    """What the repair does to each column: kept, cleaned, nulled by token, lost."""
    counts, rows = [], []
    for i, (column, dest_type) in enumerate(targets.items()):
        value = named(column)
        token = F.trim(value).isin(*null_tokens)
        clean = clean_cast(value, dest_type, null_tokens, symbols)
        touched = without_symbols(value, symbols) != value
        parts = {
            "kept": clean.isNotNull() & ~touched,
            "cleaned": clean.isNotNull() & touched,
            "nulled": token,
            "lost": loses_value(value, dest_type, null_tokens, symbols),
        }
        counts += [F.count_if(c).alias(f"{name}{i}") for name, c in parts.items()]
        rows.append(F.struct(F.lit(column), *[F.col(f"{name}{i}") for name in parts]))
    schema = "column_name string, n_kept bigint, n_cleaned bigint, n_nulled bigint, n_lost bigint"
    return rows_of(df.agg(*counts), rows, schema)
