"""Name the kind of a failed load."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipecheck.functions.loglines import says_zero_rows

# Kinds of failure.
JOIN_KEYS = "join_key_format_mismatch"
RENAMED = "column_name_mismatch"
MISSING = "missing_column"
BAD_CAST = "type_cast_error"
UNKNOWN = "unknown"


def zero_row_join(log: Column, sql: Column) -> Column:
    """The log reports zero rows and the SQL joins: the keys do not meet."""
    return says_zero_rows(log) & F.contains(F.upper(sql), F.lit("JOIN"))


def failure_kind(zero_rows: Column, renamed: Column, missing: Column, bad_cast: Column) -> Column:
    """First kind that applies. Missing goes before cast, because a load that reads
    everything as text has a type mismatch in every number column."""
    return (
        F.when(zero_rows, JOIN_KEYS)
        .when(renamed, RENAMED)
        .when(missing, MISSING)
        .when(bad_cast, BAD_CAST)
        .otherwise(UNKNOWN)
    )
