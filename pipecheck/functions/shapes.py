"""Value shapes and join-key formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_shape(column: Column, runs: bool = False) -> Column:
    """Digits become 9 and letters A: ``'$12.50' -> '$99.99'``.

    ``runs=True`` writes a run of equal classes once (``'$9.9'``), which keeps
    the number of shapes small whatever the length of the values.
    """
    plus = "+" if runs else ""
    text = column.cast("string")
    letters = F.regexp_replace(text, f"[A-Za-z]{plus}", "A")
    return F.regexp_replace(letters, f"[0-9]{plus}", "9")


def key_shape(column: Column) -> Column:
    """Prefix kept, digit runs as one 9: ``'CUST-101' -> 'CUST-9'``."""
    return F.regexp_replace(column.cast("string"), "[0-9]+", "9")


def key_prefix(column: Column) -> Column:
    """Text before a trailing number: ``'CUST-101' -> 'CUST-'``, ``'101' -> ''``."""
    return F.regexp_extract(column.cast("string"), r"^(.*?)[0-9]+$", 1)


def text_key(column: Column, prefix: str) -> Column:
    """Key as text without its prefix and white space; numbers without leading zeros.

    A double is a key only if it is a whole number that a bigint holds.
    """
    text = F.trim(F.replace(column.cast("string"), F.lit(prefix), F.lit("")))
    number = text.try_cast("bigint").cast("string")
    return F.when(text.rlike("^[+-]?[0-9]+$"), F.coalesce(number, text)).when(text != "", text)


def strip_prefix(column: Column, prefix: str, data_type: str = "bigint") -> Column:
    """Key without its prefix as a number; NULL where no number is left."""
    text = F.replace(column.cast("string"), F.lit(prefix), F.lit(""))
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast(data_type))
