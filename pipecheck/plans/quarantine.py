"""Good rows go to the destination, rows that would lose values are kept aside with the reason."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named
from pipecheck.functions.types import DATE_TEXT, FLOAT_TEXT, sql_name
from pipecheck.operators.align import align_to_schema
from pipecheck.operators.quality import clean_cast, loses_value, without_symbols
from pipecheck.plans.repair import Repair
from pipecheck.session import shared_path
from pipecheck.sources.sink import append

# Where a row goes, and why a value is lost.
GOOD, KEPT_ASIDE = "good", "lost"
OUT_OF_RANGE, NO_WHOLE_NUMBER, NO_NUMBER, NO_DATE, OTHER = "out of range", "no whole number", "no number", "no date", "not readable"

LOSSES = "array<struct<column_name: string, dest_type: string, value: string, reason: string>>"


class Split(NamedTuple):
    """Rows appended, and the table of the others: every lost value with its row."""

    appended: int
    quarantine: DataFrame


def loss_reason(column: Column, dest_type: T.DataType) -> Column:
    """Why a text is no value of a type."""
    text = without_symbols(column)
    if isinstance(dest_type, T.IntegralType):
        whole = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
        return F.when(whole, OUT_OF_RANGE).when(text.rlike(FLOAT_TEXT), NO_WHOLE_NUMBER).otherwise(NO_NUMBER)
    if isinstance(dest_type, T.NumericType):
        return F.when(text.rlike(FLOAT_TEXT), OUT_OF_RANGE).otherwise(NO_NUMBER)
    if isinstance(dest_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(text.rlike(DATE_TEXT), OUT_OF_RANGE).otherwise(NO_DATE)
    return F.lit(OTHER)


def losses(repair: Repair, dest: T.StructType) -> Column:
    """The values of a source row that the repair's casts lose, with column, type and reason."""
    each = [
        F.when(
            loses_value(named(c), dest[c].dataType),
            F.struct(F.lit(c).alias("column_name"), F.lit(sql_name(dest[c].dataType)).alias("dest_type"), named(c).alias("value"), loss_reason(named(c), dest[c].dataType).alias("reason")),
        )
        for c in repair.cleaned
    ]
    return F.filter(F.array(*each), lambda v: v.isNotNull()).cast(LOSSES) if each else F.array().cast(LOSSES)


def append_good_rows(source: DataFrame, table: str, repair: Repair) -> Split:
    """Append the rows that the repair keeps whole, and keep the others aside with what they would lose.

    The repaired rows are computed and written once, into a folder of the shared store that is partitioned by outcome: the good part is
    appended from there, the other part is the quarantine. It has the source row as JSON and one row for each lost value.
    """
    spark = source.sparkSession
    dest = spark.table(table).schema
    values = {c: clean_cast(named(c), dest[c].dataType) for c in repair.cleaned}
    marks = {"_losses": losses(repair, dest), "_source": F.to_json(F.struct(*(named(c) for c in source.columns)))}
    lost = F.size(marks["_losses"]) > 0
    extra = [T.StructField("_losses", T._parse_datatype_string(LOSSES)), T.StructField("_source", T.StringType()), T.StructField("_outcome", T.StringType())]
    values |= {"_losses": marks["_losses"], "_source": F.when(lost, marks["_source"]), "_outcome": F.when(lost, KEPT_ASIDE).otherwise(GOOD)}
    staged = align_to_schema(source, T.StructType([*dest.fields, *extra]), repair.renames, repair.defaults, values)
    path = shared_path(spark, "outcomes")
    staged.write.partitionBy("_outcome").parquet(path)
    read = spark.read.schema(T.StructType([*staged.schema.fields])).parquet(path)
    appended = append(read.filter(F.col("_outcome") == GOOD).drop("_losses", "_source", "_outcome"), table)
    aside = read.filter(F.col("_outcome") == KEPT_ASIDE)
    return Split(appended, aside.select(F.explode("_losses").alias("v"), F.col("_source").alias("source_row")).select("v.*", "source_row"))
