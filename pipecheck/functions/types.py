"""Type names, DDL words and casts that do not raise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL names of Spark types, as a destination's DESCRIBE prints them.
SQL_NAMES = {
    "boolean": "BOOLEAN",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "binary": "BLOB",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
}

# Type words of other databases that Spark DDL does not take.
DDL_WORDS = {
    "TEXT": "STRING",
    "VARCHAR": "STRING",
    "CHAR": "STRING",
    "CHARACTER VARYING": "STRING",
    "INTEGER": "INT",
    "INT2": "SMALLINT",
    "INT4": "INT",
    "INT8": "BIGINT",
    "REAL": "DOUBLE",
    "FLOAT4": "FLOAT",
    "FLOAT8": "DOUBLE",
    "DOUBLE PRECISION": "DOUBLE",
    "BOOL": "BOOLEAN",
    "BLOB": "BINARY",
    "DATETIME": "TIMESTAMP_NTZ",
    "TIMESTAMP": "TIMESTAMP_NTZ",
    "TIMESTAMPTZ": "TIMESTAMP",
}

# Types that hold every value of the type on the left.
WIDER = {
    "TINYINT": {"SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE"},
    "SMALLINT": {"INTEGER", "BIGINT", "FLOAT", "DOUBLE"},
    "INTEGER": {"BIGINT", "DOUBLE"},
    "FLOAT": {"DOUBLE"},
    "DATE": {"TIMESTAMP"},
}

# Text that a SQL database reads as a number or a date. Spark alone also takes
# Java suffixes ('1.5f') and bare years, which a SQL destination refuses.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
FLOAT_TEXT = (
    r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    r"|(?i:inf|infinity|nan))\s*$"
)
DATE_TEXT = r"^\s*[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?\s*$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def sql_name(data_type: T.DataType) -> str:
    """``IntegerType() -> 'INTEGER'``; nested types keep their element names."""
    if isinstance(data_type, T.ArrayType):
        return sql_name(data_type.elementType) + "[]"
    if isinstance(data_type, T.MapType):
        return f"MAP({sql_name(data_type.keyType)}, {sql_name(data_type.valueType)})"
    if isinstance(data_type, T.StructType):
        inner = ", ".join(f"{f.name} {sql_name(f.dataType)}" for f in data_type)
        return f"STRUCT({inner})"
    name = data_type.simpleString()
    return SQL_NAMES.get(name, name.upper())


def is_widening(source_type: T.DataType, dest_type: T.DataType) -> bool:
    """Whether every source value fits into the destination type unchanged."""
    return sql_name(dest_type) in WIDER.get(sql_name(source_type), set())


def spark_ddl(ddl: str) -> str:
    """Rewrite foreign type words; a type word always follows a column name.

    Keys are left out, as a parquet table does not enforce them.
    """
    ddl = re.sub(r",\s*(?:PRIMARY\s+KEY|UNIQUE)\s*\([^)]*\)", "", ddl, flags=re.IGNORECASE)
    ddl = re.sub(r"\s+(?:PRIMARY\s+KEY|UNIQUE)\b", "", ddl, flags=re.IGNORECASE)
    words = "|".join(w.replace(" ", r"\s+") for w in sorted(DDL_WORDS, key=len, reverse=True))
    pattern = re.compile(
        rf"(?<=[\w`\"])(\s+)({words})\b(?:\s*\(\s*\d+\s*\))?(?=\s*(?:,|\)|;|$|NOT\b|NULL\b|DEFAULT\b|COMMENT\b))",
        re.IGNORECASE,
    )
    return pattern.sub(
        lambda m: m.group(1) + DDL_WORDS[re.sub(r"\s+", " ", m.group(2)).upper()], ddl
    ).replace('"', "`")


def schema_from_ddl(columns: str) -> T.StructType:
    """``'id INTEGER, name TEXT'`` as a StructType."""
    return T.StructType.fromDDL(spark_ddl(columns))


def can_cast(source_type: T.DataType, dest_type: T.DataType) -> bool:
    """Whether a cast between the two types exists at all."""
    if source_type == dest_type:
        return True
    if isinstance(source_type, T.StringType):
        return not isinstance(dest_type, (T.ArrayType, T.MapType, T.StructType))
    if isinstance(dest_type, T.StringType):
        return True
    numeric = (T.NumericType, T.BooleanType)
    if isinstance(source_type, numeric) and isinstance(dest_type, numeric):
        return True
    return isinstance(source_type, _TEMPORAL) and isinstance(dest_type, _TEMPORAL)


def safe_cast(column: Column, source_type: T.DataType, dest_type: T.DataType) -> Column:
    """Cast that gives NULL for what a SQL destination would refuse."""
    if not can_cast(source_type, dest_type):
        return F.lit(None).cast(dest_type)
    if not isinstance(source_type, T.StringType):
        return column.try_cast(dest_type)
    if isinstance(dest_type, _INTEGRAL):
        guard = INTEGER_TEXT
    elif isinstance(dest_type, _FLOATING):
        guard = FLOAT_TEXT
    elif isinstance(dest_type, T.DecimalType):
        guard = DECIMAL_TEXT
    elif isinstance(dest_type, _TEMPORAL):
        guard = DATE_TEXT
    else:
        return column.try_cast(dest_type)
    return F.when(column.rlike(guard), column.try_cast(dest_type))


def uncastable(column: Column, source_type: T.DataType, dest_type: T.DataType) -> Column:
    """True for a value that is present but lost by the cast."""
    same = sql_name(source_type) == sql_name(dest_type) or isinstance(dest_type, T.StringType)
    if same or is_widening(source_type, dest_type):
        return F.lit(False)
    return column.isNotNull() & safe_cast(column, source_type, dest_type).isNull()
