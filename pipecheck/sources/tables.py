"""CSV tables, view registration and SELECT text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.session import written
from pipecheck.sources.csv_records import block_states, csv_lines, csv_records, file_schemas, headers, parsed_records

# Fixed value: rows shown of a query result.
SHOWN_ROWS = 50


def file_stem(path: str) -> str:
    """Table name of a file: its last path part without the last suffix."""
    return re.sub(r"(?<=.)\.[^./]+$", "", path.rstrip("/").rsplit("/", 1)[-1])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    infer: bool = True,
    line_breaks: bool | None = None,
    empty_as_null: bool = True,
) -> DataFrame:
    """CSV with a header. With a schema, or with ``infer=False`` (all text), the
    data is read once; inference is one more pass.

    Files without line breaks inside quotes are read by Spark's own reader. Others are cut into records by ``csv_records``, block by
    block, so a large file is read by many tasks too. ``line_breaks`` says which, where it is known; else quotes are counted first.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    states = None
    if line_breaks is None:
        states = block_states(csv_lines(spark, path))
        line_breaks = not states.filter("n > 0").isEmpty()
    if line_breaks:
        df = _read_records(written(csv_records(spark, path, states=states), "csv-records"), wanted, infer)
    else:
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        if wanted is not None:
            # Columns go by the header's names; a header in another order is an error.
            df = reader.option("enforceSchema", False).schema(wanted).csv(path)
        else:
            df = reader.option("inferSchema", infer).csv(path)
    if empty_as_null:
        return df
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", text)


def _read_records(records: DataFrame, schema: T.StructType | None, infer: bool) -> DataFrame:
    """Written records as a table; the files must agree in their header, and the header with the schema."""
    found = headers(records)
    if len(found) != 1 or (schema is not None and schema.names != found[0]):
        raise ValueError(f"headers {found} of {'one table' if schema is None else schema.names}")
    if schema is None:
        names = found[0]
        kinds = {}
        if infer:
            # The files of one table are one file to the lattice.
            kinds = {r.column_name: r.data_type for r in file_schemas(records.withColumn("path", F.lit(""))).collect()}
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(kinds.get(n, "string"))) for n in names])
    return parsed_records(records, schema)


def register_csv_tables(
    spark: SparkSession, paths: list[str], schemas: Mapping[str, T.StructType] | None = None, **options
) -> dict[str, DataFrame]:
    """One temp view per CSV file, named after it; a file without header is left out.

    Registering a name again replaces the view.
    """
    tables = {}
    for path in paths:
        name = file_stem(path)
        df = read_csv(spark, path, schema=(schemas or {}).get(name), **options)
        if df.columns:
            _register(name, df)
            tables[name] = df
    return tables


def _register(name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")


def folder_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, ordinal, column_name, data_type, n_rows, n_null of all columns of all CSV files below a folder.

    All files are read together: one scan counts quotes, one cuts records, and one aggregate finds the types, however many files there are.
    """
    found = file_schemas(csv_records(spark, f"{folder}/*.csv"))
    return found.withColumn("table_name", _stem(F.col("path"))).select("table_name", *found.columns[1:])


def _stem(path: Column) -> Column:
    """file_stem of a file, or of the folder ``name.csv`` that it is a part of."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"([^/]+)\.csv/[^/]*$", 1), F.lit("")), F.regexp_extract(plain, r"([^/]+?)(?:\.[^./]*)?$", 1))


def register_csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One temp view per CSV file of a folder, with inferred types, by three jobs for all files together.

    Only the rows about columns come to the driver. A file with line breaks inside quotes becomes a view over its records, any
    other one a view over the file.
    """
    records = written(csv_records(spark, f"{folder}/*.csv"), "csv-folder")
    broken = {r.path for r in records.filter("n_lines > 1").select("path").distinct().collect()}
    columns: dict[str, list] = {}
    for row in file_schemas(records).collect():
        columns.setdefault(row.path, []).append(row)
    tables = {}
    for path in sorted(columns):
        rows = sorted(columns[path], key=lambda r: r.ordinal)
        schema = T.StructType([T.StructField(r.column_name, T._parse_datatype_string(r.data_type)) for r in rows])
        if path in broken:
            df = parsed_records(records.filter(F.col("path") == path), schema)
        else:
            df = read_csv(spark, unquote(path), schema, line_breaks=False)
        name = file_stem(unquote(path))
        _register(name, df)
        tables[name] = df
    return tables


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files of a folder, from the file listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return sorted(row.path for row in files.select("path").collect())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for costly work per row on a table with few pieces.

    A table with at least as many pieces as there are cores is left as it is, so
    nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def run_sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SELECT text over temp views (or over the given frames)."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def preview(df: DataFrame, rows: int = SHOWN_ROWS) -> DataFrame:
    """First rows of a result and whether there are more.

    One row more than shown is fetched, from as few partitions as it takes; the
    rest of the result is never computed.
    """
    head = df.limit(rows + 1).collect()
    shown = df.sparkSession.createDataFrame(head[:rows], df.schema)
    return shown.withColumn("truncated", F.lit(len(head) > rows))
