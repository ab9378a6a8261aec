"""Matching lines and status per log."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipecheck.functions.loglines import SHOWN_LINES, line_fields, matches
from pipecheck.sources.logs import without_scheme

# Status of a log.
EMPTY = "empty"
NO_MATCH = "no match"
MATCHED = "matched"
BAD_PATTERN = "bad pattern"


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern cannot be used, None when it can; asked once, before any scan."""
    try:
        spark.range(1).select(F.regexp_extract(F.lit(""), f"(?iud){pattern}", 0)).first()
    except PySparkException as problem:
        if problem.getCondition() != "INVALID_PARAMETER_VALUE.PATTERN":
            raise
        return str(problem).splitlines()[0]
    return None


def matching_lines(lines: DataFrame, pattern: str = "") -> DataFrame:
    """Lines that match a pattern, or have a reported level; works on streams too."""
    return lines.filter(matches(F.col("line"), pattern))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their time, level and message."""
    return lines.withColumn("fields", line_fields(F.col("line"))).select("*", "fields.*").drop("fields")


def first_matches(lines: DataFrame, pattern: str = "", shown: int = SHOWN_LINES) -> DataFrame:
    """First matching lines of each log and the number left out.

    Spark cuts each task's lines per log before the shuffle, so a log with most
    of the lines sends only a few of them.
    """
    found = matching_lines(lines, pattern)
    order = Window.partitionBy("path").orderBy("line_no")
    head = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown)
    counts = found.groupBy("path").agg(F.count(F.lit(1)).alias("n_matches"))
    return head.drop("rank").join(counts, "path").withColumn(
        "n_more", F.greatest(F.col("n_matches") - shown, F.lit(0))
    )


def log_status(paths: DataFrame, lines: DataFrame, pattern: str = "") -> DataFrame:
    """Status of every log in ``paths``; a log without lines appears as empty.

    Paths meet those of the lines without scheme and host, as file scans report both.
    """
    logs = paths.select("path").distinct()
    if pattern:
        problem = pattern_error(lines.sparkSession, pattern)
        if problem is not None:
            none = F.lit(None).cast("bigint")
            return logs.select(
                "path", none.alias("n_lines"), none.alias("n_matches"),
                F.lit(BAD_PATTERN).alias("status"), F.lit(problem).alias("error"),
            )
    counts = lines.groupBy(without_scheme(F.col("path")).alias("_file")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(matches(F.col("line"), pattern)).alias("n_matches"),
    )
    met = logs.join(counts, without_scheme(F.col("path")) == F.col("_file"), "left").drop("_file")
    filled = met.na.fill(0, ["n_lines", "n_matches"])
    status = (
        F.when(F.col("n_lines") == 0, EMPTY).when(F.col("n_matches") == 0, NO_MATCH).otherwise(MATCHED)
    )
    return filled.withColumn("status", status).withColumn("error", F.lit(None).cast("string"))
