"""First matches and status of each log on a stream, kept as state from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipecheck.functions.loglines import SHOWN_LINES, matches
from pipecheck.operators.logs import MATCHED, NO_MATCH, first_matches

# A log without new lines for so many seconds is closed.
IDLE_SECONDS = 3600

FIRST = "array<struct<line_no: bigint, line: string>>"
STATE = f"path string, n_lines bigint, n_matches bigint, first {FIRST}, seen timestamp, closed boolean"


def batch_state(lines: DataFrame, pattern: str = "", shown: int = SHOWN_LINES) -> DataFrame:
    """path, n_lines, n_matches, first, seen of the lines (path, line_no, line) of one micro-batch.

    Counts are combined and first matches cut per task before the shuffle, so a log with most of the lines sends a few rows.
    """
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(matches(F.col("line"), pattern)).alias("n_matches"))
    heads = first_matches(lines.select("path", "line_no", "line"), pattern, shown)
    first = heads.groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct("line_no", "line")).alias("first"))
    met = counts.join(first, F.col("path").eqNullSafe(F.col("_path")), "left")
    return met.select("path", "n_lines", "n_matches", F.coalesce("first", F.array().cast(FIRST)).alias("first"), F.current_timestamp().alias("seen"))


def merged(state: DataFrame, batch: DataFrame, shown: int = SHOWN_LINES, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The state after one more micro-batch: counts add up, and the matches of the smallest numbers stay.

    A closed log leaves the state with the batch after that which closed it. Lines that come later open it anew, from zero.
    """
    rows = state.filter("not closed").select(*batch.columns).unionByName(batch)
    after = rows.groupBy("path").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_matches").alias("n_matches"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, shown).alias("first"), F.max("seen").alias("seen"),
    )
    idle = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("seen") >= idle_seconds
    return after.withColumn("closed", idle)


def state_after(target: str, pattern: str = "", shown: int = SHOWN_LINES, idle_seconds: int = IDLE_SECONDS) -> Callable[[DataFrame, int], None]:
    """What a stream does with each micro-batch: the state before it and the batch make the state after it, a folder of its number.

    A batch that is repeated after a loss reads the same state before it and overwrites its own folder, so each line counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{target}/v={number - 1}") if number else spark.createDataFrame([], STATE)
        after = merged(before, batch_state(batch, pattern, shown), shown, idle_seconds)
        after.write.mode("overwrite").parquet(f"{target}/v={number}")

    return step


def run_state(lines: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Bring the lines that have arrived into the state below ``target`` and stop; the next run goes on from there."""
    writer = lines.writeStream.foreachBatch(state_after(target, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """path, n_lines, n_matches, status, closed, first after the last micro-batch."""
    rows = spark.read.schema(f"{STATE}, v int").parquet(target)
    last = rows.select(F.max("v")).first()[0]
    status = F.when(F.col("n_matches") > 0, MATCHED).otherwise(NO_MATCH)
    return rows.filter(F.col("v") == last).select("path", "n_lines", "n_matches", status.alias("status"), "closed", "first")


def shown_lines(state: DataFrame, shown: int = SHOWN_LINES) -> DataFrame:
    """path, line_no, line, n_matches, n_more as ``first_matches`` gives them for a table."""
    lines = state.select("path", "n_matches", F.explode("first").alias("f"))
    return lines.select("path", "f.line_no", "f.line", "n_matches", F.greatest(F.col("n_matches") - shown, F.lit(0)).alias("n_more"))
