"""Appends that happen once, whatever is lost on the way."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pipecheck.functions.types import spark_ddl
from pipecheck.operators.verify import verify
from pipecheck.session import shared_folder, shared_path

# Column that a table of repairs is partitioned by.
REPAIR = "_repair"

# What the log says of a repair.
PREPARED, COMMITTED, REFUSED = "prepared", "committed", "refused"

ID = re.compile(r"[A-Za-z0-9._-]+")

LOG = "table_name string, repair_id string, state string, staged string, n_rows bigint, at timestamp"


class Commit(NamedTuple):
    state: str
    n_rows: int
    repeated: bool = False


def create_repair_table(spark: SparkSession, table: str, columns: str) -> None:
    """A table that takes each repair into a partition of its own; ``columns`` is DDL of any database."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({spark_ddl(columns)}, {REPAIR} STRING) USING parquet PARTITIONED BY ({REPAIR})")


def log_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pipecheck/commits"


def commit_log(spark: SparkSession) -> DataFrame:
    """All entries: one row for every state that a repair has reached."""
    spark.createDataFrame([], LOG).write.mode("append").parquet(log_folder(spark))
    return spark.read.schema(LOG).parquet(log_folder(spark))


def _say(spark: SparkSession, table: str, repair_id: str, state: str, staged: str | None, n_rows: int) -> None:
    """One entry is one file, which appears whole or not at all."""
    row = spark.createDataFrame([(table, repair_id, state, staged, n_rows)], "table_name string, repair_id string, state string, staged string, n_rows bigint")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(log_folder(spark))


def _entries(spark: SparkSession, table: str, repair_id: str) -> dict[str, tuple]:
    """The first entry of each state of one repair."""
    rows = commit_log(spark).filter((F.col("table_name") == table) & (F.col("repair_id") == repair_id)).orderBy(F.desc("at")).collect()
    return {r.state: r for r in rows}


def prepare(df: DataFrame, table: str, repair_id: str, check: Column | None = None, min_rows: int | None = None) -> Commit:
    """Compute a repair into the shared folder and log it; the table is not touched.

    A repair whose check does not hold on the staged rows is logged as refused. A repair that is logged already is not computed again.
    """
    spark = df.sparkSession
    if not ID.fullmatch(repair_id):
        raise ValueError(f"a repair id has letters, digits and ._- only: {repair_id!r}")
    known = _entries(spark, table, repair_id)
    for state in (COMMITTED, REFUSED, PREPARED):
        if state in known:
            return Commit(state, known[state].n_rows, True)
    wanted = [c for c in spark.table(table).columns if c != REPAIR]
    if set(wanted) != set(df.columns):
        raise ValueError(f"{table} has the columns {wanted}")
    staged, counted = shared_path(spark, "prepared"), Observation()
    df.select(*(F.col(f"`{c}`") for c in wanted)).observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(staged)
    n_rows = counted.get["rows"]
    fine = check is None and min_rows is None or verify(spark.read.schema(df.select(*wanted).schema).parquet(staged), check, min_rows).first().ok
    state = PREPARED if fine else REFUSED
    _say(spark, table, repair_id, state, staged if fine else None, n_rows)
    return Commit(state, n_rows)


def commit(spark: SparkSession, table: str, repair_id: str) -> Commit:
    """Bring a prepared repair into its partition of the table and log it.

    The partition is overwritten as a whole, so doing it again changes nothing: a driver lost before, in or behind the write leaves
    a repair that only has to be committed again.
    """
    known = _entries(spark, table, repair_id)
    if PREPARED not in known:
        raise ValueError(f"{repair_id} is not prepared for {table}")
    entry = known[PREPARED]
    if COMMITTED in known:
        return Commit(COMMITTED, entry.n_rows, True)
    _publish(spark, table, repair_id, entry.staged)
    _say(spark, table, repair_id, COMMITTED, entry.staged, entry.n_rows)
    return Commit(COMMITTED, entry.n_rows)


def _publish(spark: SparkSession, table: str, repair_id: str, staged: str) -> None:
    target = spark.table(table)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in target.schema if f.name != REPAIR]
    rows = spark.read.schema(", ".join(schema)).parquet(staged)
    # A named partition: no other one is touched, whatever the session's overwrite mode.
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({REPAIR} = '{repair_id}') SELECT * FROM {{rows}}", rows=rows)


def append_once(df: DataFrame, table: str, repair_id: str, check: Column | None = None, min_rows: int | None = None) -> Commit:
    """Prepare and commit: however often it is called with one id, and wherever it stops, the rows are in the table once."""
    prepared = prepare(df, table, repair_id, check, min_rows)
    return prepared if prepared.state == REFUSED else commit(df.sparkSession, table, repair_id)


def recover(spark: SparkSession, table: str) -> list[str]:
    """Commit the repairs of a table that are prepared and not yet committed; their ids."""
    log = commit_log(spark).filter(F.col("table_name") == table)
    states = log.groupBy("repair_id").agg(F.bool_or(F.col("state") == COMMITTED).alias("done"), F.bool_or(F.col("state") == PREPARED).alias("ready"))
    # One id for each repair that was under way when a driver was lost.
    ids = sorted(r.repair_id for r in states.filter("ready AND NOT done").collect())
    for repair_id in ids:
        commit(spark, table, repair_id)
    return ids


def committed_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the committed repairs of a table; those of one that is half written are not among them."""
    done = commit_log(spark).filter((F.col("table_name") == table) & (F.col("state") == COMMITTED)).select(F.col("repair_id").alias(REPAIR)).distinct()
    return spark.table(table).join(done, REPAIR, "left_semi").drop(REPAIR)
