"""Predicates and fields of log lines; the same for batch and streaming frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels that are reported, the cap per log, and the line format.
LEVELS = ("ERROR", "WARN", "FATAL")
SHOWN_LINES = 20
LINE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\s+([A-Z]+)\s+(.*)$"


def is_alert(line: Column) -> Column:
    """Line has a reported level anywhere, in capitals."""
    return reduce(lambda a, b: a | b, [F.contains(line, F.lit(level)) for level in LEVELS])


def matches(line: Column, pattern: str = "") -> Column:
    """Case-insensitive search; without a pattern, the reported levels."""
    return line.rlike(f"(?iud){pattern}") if pattern else is_alert(line)


def line_fields(line: Column) -> Column:
    """struct(ts_text, ts, level, message); ts is NULL on junk."""
    part = [F.regexp_extract(line, LINE, i) for i in (1, 2, 3)]
    return F.struct(
        part[0].alias("ts_text"),
        part[0].try_cast("timestamp_ntz").alias("ts"),
        part[1].alias("level"),
        part[2].alias("message"),
    )


def says_zero_rows(log: Column) -> Column:
    """Log reports zero rows; '10 rows' does not count."""
    return F.lower(log).rlike(r"\b0 rows?\b")
