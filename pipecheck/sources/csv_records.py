"""Records and schemas of CSV files that stay split over tasks, line breaks inside quotes included."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.types import FLOAT_TEXT, INTEGER_TEXT
from pipecheck.session import written

# Kinds of a piece of a record: all of it, its end, its beginning, or a block from inside of it.
WHOLE, END, BEGINNING, INSIDE = 0, 1, 2, 3

# A field from the line's start or a comma on; possessive, so that no long value is tried twice.
FIELD = r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'

# How a CSV value of each type is written.
DATE_VALUE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_VALUE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}.*$"
KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean", "text")


def csv_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, block, value, odd: the lines of the files, and whether they hold an odd number of quotes."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", (quotes % 2 == 1).alias("odd")
    )


def block_states(lines: DataFrame) -> DataFrame:
    """path, block, inside of each file block: whether an open quote reaches into it. One written row per block.

    Quotes come in pairs, an escaped one as two. So a block begins inside of quotes if the blocks before it
    hold an odd number of lines with an odd number of quotes.
    """
    blocks = lines.groupBy("path", "block").agg(F.count_if("odd").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return written(blocks.select("path", "block", F.coalesce(F.sum("n").over(before) % 2, F.lit(0)).alias("inside"), "n"), "csv-blocks")


def csv_records(spark: SparkSession, paths: list[str] | str, lines: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """path, first, n_lines, record of all records of CSV files; ``first`` marks a file's header.

    Two scans, however many files there are: one counts quotes per file block, one cuts each block into records from the state in
    which it begins. Blocks are read by different tasks. Only the pieces of records that cross a block's end, at most two per block,
    are shuffled and joined. The result is written to the shared folder. A carriage return before a record's line end is cut, those
    inside quotes stay. Empty lines are no records; quotes that never close make the rest of a file one record.
    """
    lines = csv_lines(spark, paths) if lines is None else lines
    states = block_states(lines) if states is None else states
    # One row per block: the driver holds a larger one of each, as it plans the scan by them.
    started = lines.join(F.broadcast(states.select("path", "block", "inside")), ["path", "block"], "left")
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the files were cut in another way between two scans"))).otherwise(F.col("inside"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, inside, held, opened, first = None, 0, [], False, False
        for batch in batches:
            out: list[tuple] = []
            path, block, values, odd, begun = (batch[c].to_numpy() for c in ("path", "block", "value", "odd", "inside"))
            breaks = [0, *(np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1), len(path)]
            for low, high in zip(breaks, breaks[1:], strict=False):
                if low == high:
                    continue
                if (path[low], block[low]) != at:
                    if held:
                        out.append((*at, INSIDE if opened else BEGINNING, first, len(held), "\n".join(held)))
                    at, inside, held, opened, first = (path[low], block[low]), int(begun[low]), [], bool(begun[low]), block[low] == 0
                ended = (inside + np.cumsum(odd[low:high])) % 2 == 0
                place = low
                for end in np.flatnonzero(ended) + low + 1:
                    record = values[place] if end == place + 1 and not held else "\n".join([*held, *values[place:end]])
                    if record.strip(" \t\r") or opened:
                        out.append((*at, END if opened else WHOLE, first, len(held) + end - place, record.removesuffix("\r")))
                        first = False
                    held, opened, place = [], False, end
                held += list(values[place:high])
                inside = int(not ended[-1])
            yield pd.DataFrame(out, columns=["path", "block", "kind", "first", "n_lines", "record"])
        if held:
            last = [(*at, INSIDE if opened else BEGINNING, first, len(held), "\n".join(held))]
            yield pd.DataFrame(last, columns=["path", "block", "kind", "first", "n_lines", "record"])

    schema = "path string, block bigint, kind int, first boolean, n_lines bigint, record string"
    pieces = written(started.select("path", "block", "value", "odd", known.alias("inside")).mapInPandas(cut, schema), "csv-pieces")
    parts = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("path").orderBy("block", "kind")
    numbered = parts.withColumn("number", F.sum((F.col("kind") == BEGINNING).cast("int")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"])
    joined = numbered.groupBy("path", "number").agg(
        F.bool_or("first").alias("first"), F.sum("n_lines").alias("n_lines"), F.regexp_replace(F.array_join(texts, "\n"), "\r$", "").alias("record")
    )
    columns = ["path", "first", "n_lines", "record"]
    return pieces.filter(F.col("kind") == WHOLE).select(*columns).union(joined.select(*columns))


def parsed_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The records of files with one header as columns of a schema."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return records.filter(~F.col("first")).select(F.from_csv("record", schema.toDDL(), options).alias("r")).select("r.*")


def headers(records: DataFrame) -> list[list[str]]:
    """The different headers of the files, each as its names."""
    return [next(csv.reader([row.record])) for row in records.filter("first").select("record").distinct().collect()]


def fields(record: Column) -> Column:
    """The values of a record: null where nothing stands, else without their quotes."""
    quoted = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(F.regexp_extract_all(record, F.lit(FIELD), F.lit(1)), lambda f: F.when(F.startswith(f, F.lit('"')), quoted(f)).when(f != "", f))


def value_kind(value: Column) -> Column:
    """The narrowest type that a text can be read as: one of KINDS, null for null."""
    return (
        F.when(value.isNull(), F.lit(None))
        .when(value.rlike(INTEGER_TEXT), F.when(value.try_cast("int").isNotNull(), "int").when(value.try_cast("bigint").isNotNull(), "bigint").otherwise("double"))
        .when(value.rlike(FLOAT_TEXT) & value.try_cast("double").isNotNull(), "double")
        .when(value.rlike(DATE_VALUE) & value.try_cast("date").isNotNull(), "date")
        .when(value.rlike(TIME_VALUE) & value.try_cast("timestamp").isNotNull(), "timestamp")
        .when(F.lower(value).isin("true", "false"), "boolean")
        .otherwise("text")
    )


def file_schemas(records: DataFrame) -> DataFrame:
    """path, ordinal, column_name, data_type, n_rows, n_null of every column of every file of ``records``, from one aggregate.

    A column has the narrowest type of the lattice int < bigint < double, date < timestamp, boolean that holds all its values, and is a
    string where two of them have none in common, or where it has no values. What a file's rows have beyond its header is left out.
    """
    values = records.select("path", "first", F.posexplode(fields(F.col("record"))).alias("at", "value"))
    kind = F.when(~F.col("first"), value_kind(F.col("value")))
    counted = values.groupBy("path", "at").agg(
        # A set of one name: Spark gathers it in a hash table, while it would sort all values for a first or largest text.
        F.get(F.collect_set(F.when(F.col("first"), F.coalesce("value", F.lit("")))), F.lit(0)).alias("column_name"),
        F.count_if(~F.col("first")).alias("seen"), *(F.count_if(kind == k).alias(f"n_{k}") for k in KINDS),
    )
    rows = Window.partitionBy("path")
    whole = counted.withColumn("n_rows", F.max("seen").over(rows)).filter("column_name is not null")
    present = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    numbers = F.col("n_int") + F.col("n_bigint") + F.col("n_double")
    kind = (
        F.when(present == 0, "string")
        .when(F.col("n_int") == present, "int")
        .when(F.col("n_int") + F.col("n_bigint") == present, "bigint")
        .when(numbers == present, "double")
        .when(F.col("n_date") == present, "date")
        .when(F.col("n_date") + F.col("n_timestamp") == present, "timestamp")
        .when(F.col("n_boolean") == present, "boolean")
        .otherwise("string")
    )
    return whole.select("path", (F.col("at") + 1).alias("ordinal"), "column_name", kind.alias("data_type"), "n_rows", (F.col("n_rows") - present).alias("n_null"))
