"""Shared folder for staged tables and stream state."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession

STAGING_DATABASE = "pipecheck_staging"


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; its folder is then in its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/pipecheck/{name}-{uuid.uuid4().hex}"


def staging_database(spark: SparkSession) -> str:
    """Database of the staged tables: one for each shared folder, as its location never changes."""
    return f"{STAGING_DATABASE}_{zlib.crc32(shared_folder(spark).encode()):08x}"


def staging_table(spark: SparkSession, name: str) -> str:
    """Name for a new managed table whose files live in the shared folder.

    DROP TABLE removes the files again.
    """
    database = staging_database(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_folder(spark)}/pipecheck/staging'")
    return f"{database}.{name}_{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a parquet table in the shared folder: computed once, read often."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
