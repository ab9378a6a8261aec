"""One failed load from its folder: description, log, CSV tables and DDL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named
from pipecheck.functions.loglines import says_zero_rows
from pipecheck.operators.align import align_to_schema, rename_candidates
from pipecheck.operators.classify import JOIN_KEYS
from pipecheck.operators.keys import NOT_AN_ALIAS, key_prefixes, plain_key, sample_join_keys, sql_join_keys
from pipecheck.operators.logs import first_matches
from pipecheck.operators.schema import compare_all_sources, mismatch_samples, resolve_sources
from pipecheck.operators.verify import LOST, apply_repair
from pipecheck.plans.diagnose import column_findings, diagnose
from pipecheck.plans.repair import propose_repair, repaired
from pipecheck.sources.ddl import create_destination
from pipecheck.sources.logs import existing, read_log_lines
from pipecheck.sources.specs import read_specs, valid
from pipecheck.sources.tables import csv_files, file_stem, register_csv_tables

# Files of a load, and the engine that reads CSV with types.
DESCRIPTION = "load.json"
LOG = "error.log"
TYPED_ENGINE = "duckdb"

INSERT = re.compile(r"^\s*INSERT\s+INTO\s+\w+\s*\(([^)]*)\)\s*(SELECT\b.*)$", re.IGNORECASE | re.DOTALL)


# Fixed value: a table and its alias behind FROM or JOIN.
TABLE_ALIAS = rf"\b(?:FROM|JOIN)\s+(\w+)(?:\s+(?:AS\s+)?(?!(?:{NOT_AN_ALIAS})\b)(\w+))?"


class Load(NamedTuple):
    spec: Row
    sources: dict[str, DataFrame]
    dest: T.StructType
    log: DataFrame
    missing: list[str] = []


class Diagnosis(NamedTuple):
    kind: str
    comparisons: DataFrame
    candidates: DataFrame
    alerts: DataFrame
    samples: DataFrame
    key_samples: DataFrame | None = None


def open_load(spark: SparkSession, folder: str) -> Load:
    """Read a load's files and register its tables as views.

    Every CSV of the folder becomes a view, as SQL may read more than the sources named. A
    source without a file is listed in ``missing`` and the others are taken.
    """
    folder = folder.rstrip("/")
    specs = valid(read_specs(spark, f"{folder}/{DESCRIPTION}")).limit(1)
    spec = specs.first()
    if spec is None:
        raise ValueError(f"no valid description in {folder}")
    names = [row.source_table for row in resolve_sources(specs).select("source_table").collect()]
    typed = spec.destination.engine == TYPED_ENGINE
    found = existing(spark, [f"{folder}/{name}.csv" for name in names])
    register_csv_tables(
        spark, [p for p in csv_files(spark, folder) if file_stem(p) not in names], infer=typed, empty_as_null=typed
    )
    sources = register_csv_tables(spark, found, infer=typed, empty_as_null=typed)
    if not sources:
        raise ValueError(f"no source of {names} in {folder}")
    create_destination(spark, folder)
    dest = spark.table(spec.destination.table).schema
    missing = [name for name in names if name not in sources]
    return Load(spec, sources, dest, read_log_lines(spark, f"{folder}/{LOG}"), missing)


def diagnose_load(spark: SparkSession, load: Load) -> Diagnosis:
    """Kind of the failure, with the rows that say why and samples of the columns in question."""
    table = load.spec.destination.table
    comparisons = compare_all_sources(load.sources, load.dest)
    candidates = reduce(
        DataFrame.unionByName,
        [
            rename_candidates(df, load.dest).select(F.lit(name).alias("source_table"), "*")
            for name, df in load.sources.items()
        ],
    )
    dest_table = F.lit(table).alias("dest_table")
    findings = column_findings(comparisons.select(dest_table, "*"), candidates.select(dest_table, "*"))
    joins = "JOIN" in load.spec.transform.sql.upper()
    zero_rows = joins and not load.log.filter(says_zero_rows(F.col("line"))).isEmpty()
    rows = [(load.spec.name, name, table, zero_rows) for name in load.sources]
    loads = spark.createDataFrame(
        rows, "load_id string, source_table string, dest_table string, zero_rows boolean"
    )
    kind = diagnose(loads, findings).first().failure_kind
    samples = reduce(
        DataFrame.unionByName,
        [mismatch_samples(df, load.dest).select(F.lit(name).alias("source_table"), "*") for name, df in load.sources.items()],
    )
    return Diagnosis(kind, comparisons, candidates, first_matches(load.log), samples, _key_samples(spark, load))


def _key_samples(spark: SparkSession, load: Load) -> DataFrame | None:
    """Samples of both join columns, where the load's SQL joins two of its sources on columns."""
    keys = sql_join_keys(spark.createDataFrame([(load.spec.transform.sql,)], "sql string")).first()
    if keys is None:
        return None
    sides = [(load.sources.get(keys.left_table), keys.left_column), (load.sources.get(keys.right_table), keys.right_column)]
    if any(df is None or column not in df.columns for df, column in sides):
        return None
    (left, left_key), (right, right_key) = sides
    return sample_join_keys(left, left_key, right, right_key)


def repaired_join_load(spark: SparkSession, load: Load) -> DataFrame:
    """The load's own SELECT over tables whose join keys have lost their prefix."""
    text = load.spec.transform.sql
    sql = spark.createDataFrame([(text,)], "sql string")
    keys = sql_join_keys(sql).first()
    insert = INSERT.match(text)
    if keys is None or insert is None:
        raise ValueError("no plain join condition or no INSERT with a column list")
    sides = [(keys.left_table, keys.left_column), (keys.right_table, keys.right_column)]
    (left, left_key), (right, right_key) = [(load.sources[t], c) for t, c in sides]
    found = key_prefixes(left, left_key, right, right_key).filter("one_sided AND prefix <> ''").take(2)
    if len(found) != 1:
        raise ValueError("the keys do not differ by one prefix")
    for table, column in sides:
        df = load.sources[table]
        fixed = df.withColumn(column, plain_key(df, column, found[0].prefix))
        fixed.createOrReplaceTempView("`" + table + "`")
    try:
        columns = [c.strip() for c in insert.group(1).split(",")]
        return align_to_schema(spark.sql(insert.group(2)).toDF(*columns), load.dest)
    finally:
        for table, _ in sides:
            load.sources[table].createOrReplaceTempView("`" + table + "`")


def _aliases(text: str) -> dict[str, str]:
    """Table of every alias, and of every table's own name, in the FROM and JOIN parts of a SELECT."""
    found = {}
    for table, alias in re.findall(TABLE_ALIAS, text, re.IGNORECASE):
        found[table] = table
        if alias:
            found[alias] = table
    return found


def _references(text: str, aliases: dict[str, str]) -> dict[str, list[str]]:
    """Columns that a SELECT reads of each table, by ``alias.column``."""
    out: dict[str, list[str]] = {}
    for alias, column in re.findall(r"\b(\w+)\.(\w+)\b", text):
        table = aliases.get(alias)
        if table and column not in out.setdefault(table, []):
            out[table].append(column)
    return out


def column_sources(spark: SparkSession, load: Load) -> dict[str, tuple[str, str]]:
    """Destination column to (source table, column) for all that the load's SELECT takes from a table as they are.

    Each table is seen with its name and column in the columns' metadata, which the analysed SELECT carries to its result. Columns that the
    SELECT names and a table lacks stand there as null. Nothing is run.
    """
    insert = INSERT.match(load.spec.transform.sql)
    if insert is None:
        raise ValueError("no INSERT with a column list")
    wanted = [c.strip() for c in insert.group(1).split(",")]
    used = _references(insert.group(2), _aliases(insert.group(2)))

    def marked(name: str, df: DataFrame) -> DataFrame:
        lacking = [F.lit(None).cast("string").alias(c, metadata={"from": [name, c]}) for c in used.get(name, []) if c not in df.columns]
        # No rows: a cast of the SELECT is looked at, not carried out.
        return df.filter(F.lit(False)).select(*(named(c).alias(c, metadata={"from": [name, c]}) for c in df.columns), *lacking)

    with _views(load, {name: marked(name, df) for name, df in load.sources.items()}):
        fields = spark.sql(insert.group(2)).schema.fields
    if len(fields) != len(wanted):
        raise ValueError(f"{len(fields)} values for {len(wanted)} columns")
    return {c: tuple(f.metadata["from"]) for c, f in zip(wanted, fields, strict=True) if "from" in f.metadata}


@contextmanager
def _views(load: Load, frames: dict[str, DataFrame]) -> Iterator[None]:
    """Other frames under the names of a load's tables, for a while."""
    for name, df in frames.items():
        df.createOrReplaceTempView("`" + name + "`")
    try:
        yield
    finally:
        for name in frames:
            load.sources[name].createOrReplaceTempView("`" + name + "`")


def repaired_tables_load(spark: SparkSession, load: Load, defaults: dict[str, object] | None = None) -> DataFrame:
    """The load's own SELECT over tables that are each repaired for what it reads of them.

    What the SELECT takes from a table into a destination column must cast to that column's type; what else it reads of the table, such as join keys,
    keeps its own. Against this schema each table is repaired like a load of its own: renamed columns, defaults, cleaned values. The
    column LOST of a row counts the values that the tables' rows behind it lose. An ambiguous table is refused by its columns' names.
    """
    insert = INSERT.match(load.spec.transform.sql)
    sources = column_sources(spark, load)
    text = insert.group(2)
    used = _references(text, _aliases(text))
    types = {source: load.dest[column].dataType for column, source in sources.items()}
    frames, lost = {}, []
    for name, df in load.sources.items():
        fields = []
        for column in used.get(name, []):
            own = df.schema[column].dataType if column in df.columns else T.StringType()
            fields.append(T.StructField(column, types.get((name, column), own)))
        needed = T.StructType(fields)
        repair = propose_repair(df, needed, {c: v for c, v in (defaults or {}).items() if c in needed.names})
        if repair.unresolved:
            raise ValueError(f"{name}: no sure source for {repair.unresolved}")
        fixed = repaired(df, needed, repair)
        if LOST in fixed.columns:
            lost.append(f"{LOST}_{len(lost)}")
            fixed = fixed.withColumnRenamed(LOST, lost[-1])
        frames[name] = fixed
    # The counts of lost values ride along behind the SELECT's own values.
    head, rest = re.match(r"(?is)(SELECT\b.*?)(\bFROM\b.*)$", text.strip().rstrip(";")).groups()
    with _views(load, frames):
        rows = spark.sql(f"{head.rstrip()}{''.join(', ' + c for c in lost)} {rest}")
    wanted = [c.strip() for c in insert.group(1).split(",")]
    rows = rows.toDF(*wanted, *lost)
    aligned = T.StructType([*load.dest.fields, *([T.StructField(LOST, T.LongType())] if lost else [])])
    total = {LOST: reduce(lambda a, b: a + b, [F.col(c) for c in lost])} if lost else {}
    return align_to_schema(rows, aligned, None, defaults, total)


def repair_load(
    spark: SparkSession,
    load: Load,
    kind: str,
    check: Column | None = None,
    min_rows: int | None = None,
    defaults: dict[str, object] | None = None,
    most_lost: int = 0,
) -> DataFrame:
    """Build the repair for a kind of failure, check it and append it; a load over several tables has each of them repaired."""
    if kind == JOIN_KEYS:
        frame = repaired_join_load(spark, load)
    elif len(load.sources) == 1:
        (source,) = load.sources.values()
        frame = repaired(source, load.dest, propose_repair(source, load.dest, defaults))
    else:
        frame = repaired_tables_load(spark, load, defaults)
    return apply_repair(frame, load.spec.destination.table, check, min_rows, most_lost)
