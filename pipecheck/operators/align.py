"""Renamed and missing columns, and frames in the shape of a destination."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named, rows_of
from pipecheck.functions.types import sql_name, uncastable

PAIR = (
    "dest_column string, dest_type string, source_column string, source_type string, "
    "n_rows bigint, n_uncastable bigint, shared_parts bigint"
)


def absent_columns(source: DataFrame, dest: T.StructType) -> list[T.StructField]:
    return [f for f in dest if f.name not in source.columns]


def extra_columns(source: DataFrame, dest: T.StructType) -> list[T.StructField]:
    return [f for f in source.schema if f.name not in dest.names]


def _tokens(name: str) -> set[str]:
    """Parts of a column name; single letters say nothing."""
    return {t for t in name.lower().split("_") if len(t) > 1}


def _named_alike(source: DataFrame, dest: T.StructType) -> list[tuple[T.StructField, T.StructField]]:
    """Absent destination columns and source-only columns that share a part of their names."""
    return [
        (d, s)
        for d in absent_columns(source, dest)
        for s in extra_columns(source, dest)
        if _tokens(d.name) & _tokens(s.name)
    ]


def candidate_columns(source: DataFrame, dest: T.StructType) -> DataFrame:
    """dest_column, source_column of the candidates of ``rename_candidates``, from the names alone: no table is read."""
    pairs = [(d.name, s.name) for d, s in _named_alike(source, dest)]
    return source.sparkSession.createDataFrame(pairs, "dest_column string, source_column string")


def rename_candidates(source: DataFrame, dest: T.StructType) -> DataFrame:
    """Source-only columns that may be an absent destination column, ranked.

    A candidate shares a part of its name; other pairs are left out before anything is
    counted. More shared parts win, then values that all cast, then the closer name. Equal
    firsts are marked as a tie.
    """
    pairs = _named_alike(source, dest)
    bad = [
        F.count_if(uncastable(named(s.name), s.dataType, d.dataType)).alias(f"bad{i}")
        for i, (d, s) in enumerate(pairs)
    ]
    rows = [
        F.struct(
            F.lit(d.name),
            F.lit(sql_name(d.dataType)),
            F.lit(s.name),
            F.lit(sql_name(s.dataType)),
            F.col("n"),
            F.col(f"bad{i}"),
            F.lit(len(_tokens(d.name) & _tokens(s.name))),
        )
        for i, (d, s) in enumerate(pairs)
    ]
    counted = source.agg(F.count(F.lit(1)).alias("n"), *bad)
    best = Window.partitionBy("dest_column").orderBy(
        F.desc("shared_parts"), F.desc("all_cast"), F.asc("name_distance")
    )
    same = Window.partitionBy("dest_column", "rank")
    return (
        rows_of(counted, rows, PAIR)
        .withColumn("all_cast", F.col("n_uncastable") == 0)
        .withColumn("name_distance", F.levenshtein("dest_column", "source_column").cast("bigint"))
        .withColumn("rank", F.rank().over(best).cast("bigint"))
        .withColumn("tie", F.count(F.lit(1)).over(same) > 1)
    )


def missing_columns(source: DataFrame, dest: T.StructType) -> DataFrame:
    """Absent destination columns that no source column can stand for."""
    known = {d.name for d, _ in _named_alike(source, dest)}
    rows = [
        F.struct(F.lit(f.name), F.lit(sql_name(f.dataType)), F.col("n"))
        for f in absent_columns(source, dest)
        if f.name not in known
    ]
    counted = source.agg(F.count(F.lit(1)).alias("n"))
    return rows_of(counted, rows, "dest_column string, dest_type string, n_rows bigint")


def align_to_schema(
    df: DataFrame,
    dest: T.StructType,
    renames: Mapping[str, str] | None = None,
    defaults: Mapping[str, object] | None = None,
    values: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The frame in the columns, order and types of a destination, in one projection.

    ``renames`` maps source to destination names, ``defaults`` gives a constant and
    ``values`` an expression for a destination column. A column with none of these
    and no source is an error, and so is a value that does not cast.
    """
    source_of = {new: old for old, new in (renames or {}).items()}
    columns, absent = [], []
    for f in dest:
        if f.name in (values or {}):
            column = values[f.name]
        elif source_of.get(f.name, f.name) in df.columns:
            column = named(source_of.get(f.name, f.name))
        elif f.name in (defaults or {}):
            column = F.lit(defaults[f.name])
        else:
            absent.append(f.name)
            continue
        columns.append(column.cast(f.dataType).alias(f.name))
    if absent:
        raise ValueError(f"neither source nor default for {absent}")
    return df.select(*columns)
