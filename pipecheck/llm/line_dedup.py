"""Lines that several documents share are kept in one of them (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import SPACES, SQL_SPACES, ascii_lower, hash128, sql_lower, table, without
from pipecheck.session import written


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, pos, k1, k2 of every line whose key has at least ``min_chars`` code points.

    The key is the line without white space at its ends and with A-Z lower-cased;
    only its 128-bit hash goes on, so no text is shuffled for the counts.
    """
    lines = docs.select(F.col("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACES)))
    k1, k2 = hash128(F.col("key"))
    return (
        lines.select("doc_id", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "pos", k1.alias("k1"), k2.alias("k2"))
    )


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the smallest doc_id.

    Returns the columns of ``docs`` (doc_id and text needed) with the new text, and
    n_lines, n_dropped. The lines' hashes are written once. Counting shuffles hashes only, combined per task, so a line of
    a third of the documents sends one row per task and document; documents meet
    their dropped positions on doc_id, one row each.

    A null or empty text is one empty line and becomes an empty text. A row without doc_id
    neither counts as a document nor loses lines. Rows that repeat a doc_id are one
    document: each of them loses the same positions. Columns named n_lines or n_dropped
    are replaced. No rows give no rows.
    """
    keys = written(line_keys(docs, min_chars), "line-keys")
    shared = (
        keys.groupBy("k1", "k2")
        .agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first"))
        .filter(F.col("n") >= min_docs)
        .select("k1", "k2", "first")
    )
    dropped = (
        keys.join(shared, ["k1", "k2"])
        .filter(F.col("doc_id") != F.col("first"))
        .groupBy(F.col("doc_id").alias("of_doc"))
        .agg(F.collect_set("pos").alias("dropped_pos"))
    )
    rest = without(docs, ["n_lines", "n_dropped", "of_doc", "dropped_pos", "lines_in"])
    kept_columns = [c for c in rest.columns]
    split = rest.withColumn("lines_in", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    met = split.join(dropped, F.col("doc_id") == F.col("of_doc"), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines_in") - 1), F.col("dropped_pos"))
    text = F.when(F.col("dropped_pos").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(keep, lambda p: F.get("lines_in", p)), "\n")
    )
    return met.select(
        *(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in kept_columns),
        F.size("lines_in").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped_pos"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, {sql_lower(f"trim(line, {SQL_SPACES})")} AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
  FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op8_line_dedup": (op8_line_dedup, SQL)}
