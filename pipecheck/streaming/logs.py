"""Log lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipecheck.functions.loglines import matches


def stream_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the log files that arrive in a folder."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def stream_matches(lines: DataFrame, pattern: str = "") -> DataFrame:
    """The batch filter on a stream; it keeps no state."""
    return lines.filter(matches(F.col("line"), pattern))


def write_available(lines: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to parquet, each input file once, and stop."""
    return (
        lines.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
