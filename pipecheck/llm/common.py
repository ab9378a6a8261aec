"""Columns and table helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The ASCII letters and the six white-space characters of the contracts.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    ascii_only = F.length(value) == F.octet_length(value)
    return F.when(ascii_only, F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def hash128(value: Column) -> list[Column]:
    """Two 64-bit hashes of different seeds: together 128 bits, enough for 10^12 values."""
    return [F.xxhash64(value), F.xxhash64(F.lit(7), value)]


def hash_cut(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """About eight times ``most`` of the ``rows`` rows of a frame, by the hash of ``key``; all if there are fewer.

    So what then looks for the rows of the smallest hash gets few rows from each task, however many tasks there are.
    """
    share = min(1.0, 8 * most / max(rows, 1))
    return df.filter(hash_order(key) <= int(share * (1 << 40))) if share < 1 else df


def hash_order(key: str) -> Column:
    """Order of a sample: the rows that hash_cut leaves come first."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40))


def pieces(texts: pa.Array, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """UTF-8 bytes of neighbouring texts, about ``size`` at a time, and where each text ends in them. Null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield data[int(at[lo]) : int(at[hi])].to_pybytes() if data else b"", at[lo + 1 : hi + 1] - at[lo]
        lo = hi


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns that clash with the names of a result."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """Schema of the frame with the fields of ``ddl`` behind it."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def sql_lower(value: str) -> str:
    """ascii_lower in SQL."""
    return f"translate({value}, '{UPPER}', '{LOWER}')"


SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL: byte by byte, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295::BIGINT)"
