"""Log lines and text previews from files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipecheck.functions.text import strip
from pipecheck.session import written

# Fixed value: characters of a file that a preview shows.
SHOWN_CHARACTERS = 2000

LINES = "path string, line_no bigint, line string"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that a scan finds; a missing log is not an error.

    All are asked for at once. Only if some are missing is the list halved to find them.
    """
    if not paths:
        return []
    try:
        spark.read.text(paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        half = len(paths) // 2
        return existing(spark, paths[:half]) + existing(spark, paths[half:]) if half else []
    return paths


def without_scheme(path: Column) -> Column:
    """An address without its scheme and host: the path in its file system."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


def plain_path(reported: Column) -> Column:
    """The path of a file from the encoded address that a scan reports."""
    return F.url_decode(F.replace(without_scheme(reported), F.lit("+"), F.lit("%2B")))


def read_log_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of log files with their numbers, blank ends of each file cut.

    ``path`` is the path without scheme and host. Large files stay split over tasks. The
    files are scanned once, into a table in the shared folder that says where each line
    stands in its file block; what numbers the lines is then counted from that table, so no
    second scan has to cut the files alike.
    """
    paths = existing(spark, [paths] if isinstance(paths, str) else list(paths))
    if not paths:
        return spark.createDataFrame([], LINES)
    scan = written(
        spark.read.text(paths).select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
            F.col("value").alias("line"),
        ),
        "log-lines",
    )
    filled = strip(F.col("line")) != ""
    blocks = scan.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("position").alias("start"),
        F.min(F.when(filled, F.col("position"))).alias("first"),
        F.max(F.when(filled, F.col("position"))).alias("last"),
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    offset = F.coalesce(F.sum("lines").over(before), F.lit(0))
    blocks = (
        blocks.withColumn("offset", offset)
        .withColumn("first_no", F.min(F.col("first") - F.col("start") + F.col("offset")).over(whole))
        .withColumn("last_no", F.max(F.col("last") - F.col("start") + F.col("offset")).over(whole))
        .select("path", "block", "start", "offset", "first_no", "last_no")
    )
    numbered = scan.join(blocks, ["path", "block"]).withColumn(
        "number", F.col("position") - F.col("start") + F.col("offset")
    )
    line = F.col("line")
    line = F.when(F.col("number") == F.col("first_no"), F.regexp_replace(line, r"(?U)^\s+", "")).otherwise(line)
    line = F.when(F.col("number") == F.col("last_no"), F.regexp_replace(line, r"(?U)\s+$", "")).otherwise(line)
    return numbered.filter(F.col("number").between(F.col("first_no"), F.col("last_no"))).select(
        "path", (F.col("number") - F.col("first_no") + 1).alias("line_no"), line.alias("line")
    )


def split_logs(logs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Lines of a table that holds one whole log per row."""
    lines = F.split(strip(F.col(text)), "\r\n|\n|\r")
    return (
        logs.filter(strip(F.col(text)) != "")
        .select(F.col(path).alias("path"), F.posexplode(lines).alias("pos", "line"))
        .select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    )


def preview_text(df: DataFrame, key: str, text: str, shown: int = SHOWN_CHARACTERS) -> DataFrame:
    """First characters of each text, its whole length, and whether it was cut."""
    length = F.length(text).cast("bigint")
    return df.select(
        key,
        F.substring(text, 1, shown).alias("preview"),
        length.alias("total_chars"),
        (length > shown).alias("truncated"),
    )


def preview_files(
    spark: SparkSession, paths: list[str] | str, shown: int = SHOWN_CHARACTERS
) -> DataFrame:
    """Preview of every text file, with line ends of any system read as newlines.

    Large files stay split over tasks. The length is summed over lines; the first
    characters can only be in lines that start in the first bytes of a file. An empty file
    has no lines and comes from the list of files that the driver holds.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
            F.octet_length("value").alias("bytes"),
            F.regexp_replace(F.regexp_replace("value", "\r$", ""), "\r", "\n").alias("line"),
        )
    )
    totals = lines.groupBy("path").agg(
        F.max("size").alias("size"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("line")).alias("chars"),
    )
    # The last line has a newline too if the bytes of the file say so.
    newlines = F.col("lines") - F.when(F.col("size") == F.col("bytes") + F.col("lines"), 0).otherwise(1)
    totals = totals.select("path", (F.col("chars") + newlines).alias("total_chars"))
    order = Window.partitionBy("path").orderBy("block", "position")
    first = (
        lines.filter(F.col("block") <= 4 * shown)
        .select("path", "block", "position", F.substring("line", 1, shown).alias("line"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= shown)
    )
    # At most ``shown`` lines of ``shown`` characters per file.
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    head = first.groupBy("path").agg(F.array_join(ordered["line"], "\n").alias("head"))
    whole = F.when(F.length("head") < F.col("total_chars"), F.concat("head", F.lit("\n"))).otherwise(F.col("head"))
    # The driver's own list of files: a scan never reports an empty one.
    listed = [(p,) for p in spark.read.text(paths).inputFiles()]
    files = spark.createDataFrame(listed, "listed string")
    found = totals.join(head, "path")
    met = files.join(found, without_scheme(F.col("listed")) == without_scheme(F.col("path")), "left")
    return met.select(
        F.coalesce("path", "listed").alias("path"),
        F.coalesce(F.substring(whole, 1, shown), F.lit("")).alias("preview"),
        F.coalesce("total_chars", F.lit(0)).cast("bigint").alias("total_chars"),
        F.coalesce(F.col("total_chars") > shown, F.lit(False)).alias("truncated"),
    )
