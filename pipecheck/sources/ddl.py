"""Destination tables from DDL text."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from pipecheck.functions.types import spark_ddl

# Names of the DDL files of a load, the first that exists is used.
SCRIPT = "schema.sql"
SINGLE = "dest_schema.sql"

_CREATE = re.compile(r"^\s*CREATE\s+TABLE\b", re.IGNORECASE)


def create_tables(spark: SparkSession, ddl: str, several: bool = True) -> None:
    """Run CREATE TABLE text as parquet tables; IF NOT EXISTS keeps what is there."""
    statements = ddl.split(";") if several else [ddl.rstrip().rstrip(";")]
    for statement in filter(str.strip, statements):
        if _CREATE.match(statement):
            statement = spark_ddl(statement).rstrip() + " USING parquet"
        spark.sql(statement)


def _small_file(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return rows[0].value if rows else ""


def create_destination(spark: SparkSession, folder: str) -> bool:
    """Tables of a load's folder: its script if there is one, else its single DDL."""
    folder = folder.rstrip("/")
    script = _small_file(spark, f"{folder}/{SCRIPT}")
    if script is not None:
        create_tables(spark, script)
        return True
    single = _small_file(spark, f"{folder}/{SINGLE}")
    if single is not None:
        create_tables(spark, single, several=False)
    return single is not None
