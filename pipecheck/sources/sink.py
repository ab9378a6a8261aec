"""Append to a destination table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def append(df: DataFrame, table: str) -> int:
    """Append by column name and return the number of rows written.

    The count is observed on the written frame, in the writing stage, so nothing
    is read a second time.
    """
    wanted = df.sparkSession.table(table).columns
    absent = [c for c in wanted if c not in df.columns]
    unknown = [c for c in df.columns if c not in wanted]
    if absent or unknown:
        raise ValueError(f"{table}: no value for {absent}, no place for {unknown}")
    written = Observation()
    ordered = df.select(*[F.col(f"`{c}`") for c in wanted])
    ordered.observe(written, F.count(F.lit(1)).alias("rows")).write.insertInto(table)
    return written.get["rows"]
