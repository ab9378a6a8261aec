"""Load descriptions, case manifests and expected fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the metadata records and the allowed engines.
SPEC = (
    "name string, source struct<type: string, path: string, tables: array<string>>, "
    "destination struct<engine: string, table: string>, transform struct<sql: string>"
)
MANIFEST = "id string, name string, difficulty string, category string, engine string"
EXPECTED_FIX = (
    "root_cause string, fix_type string, fix_description string, fixed_sql string, "
    "verification_query string, expected_row_count_min bigint"
)
ENGINES = ("sqlite", "duckdb")
REQUIRED = (
    "name",
    "source.type",
    "destination.engine",
    "destination.table",
    "transform.sql",
)


def spec_error(spec: str = "") -> Column:
    """What is wrong with a description, NULL when it is valid."""
    prefix = f"{spec}." if spec else ""
    result = F.lit(None).cast("string")
    engine = F.col(f"{prefix}destination.engine")
    result = F.when(~engine.isin(*ENGINES), F.lit("unknown engine")).otherwise(result)
    for name in reversed(REQUIRED):
        result = F.when(F.col(prefix + name).isNull(), F.lit(f"{name} is missing")).otherwise(result)
    return result


def parse_specs(df: DataFrame, text: str) -> DataFrame:
    """Descriptions from a column of JSON text, with ``spec_error`` beside them."""
    parsed = df.withColumn("spec", F.from_json(text, SPEC))
    return parsed.withColumn("spec_error", spec_error("spec"))


def read_specs(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Descriptions from JSON files, valid or not; ``spec_error`` tells.

    One description per file, or one per line, which also splits large files.
    """
    specs = spark.read.schema(SPEC).json(path, multiLine=not per_line)
    return specs.withColumn("spec_error", spec_error())


def valid(specs: DataFrame) -> DataFrame:
    return specs.filter(F.col("spec_error").isNull()).drop("spec_error")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases, one per record, of a known engine."""
    cases = spark.read.schema(MANIFEST).json(path)
    return cases.filter(F.col("engine").isin(*ENGINES))


def read_expected_fixes(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Expected fixes: one file per case in a folder named after it, or one per line
    with its ``case_id``."""
    if per_line:
        return spark.read.schema(f"case_id string, {EXPECTED_FIX}").json(path)
    fixes = spark.read.schema(EXPECTED_FIX).json(path, multiLine=True)
    case_id = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return fixes.select(case_id.alias("case_id"), "*")
