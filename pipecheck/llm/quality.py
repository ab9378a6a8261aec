"""Quality rules with the frequency of lines across documents (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import SPACES, SQL_SPACES, sql_lower, table, with_fields
from pipecheck.session import written

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
# A line in more documents of a host than this is removed; a document that keeps a smaller share of its words is rejected.
MOST_DOCUMENTS = 50
LEAST_KEPT_PERCENT = 50

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Number of words that lie in a window of WINDOW words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) == len(words):
        return 0
    own = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    own ^= own >> np.uint64(32)
    n = len(words) - WINDOW + 1
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        keys += own[k : k + n] * _ODD[k]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_facts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (k1, k2, words) of the different lines.

    The key of a line is the line without white space at its ends, A-Z lower-cased, hashed to 128 bits.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    with_words, seen, lines = 0, set(), {}
    for line in text.split("\n"):
        bare = line.strip(SPACES)
        if bare:
            with_words += 1
            seen.add(line)
            raw = bare.encode("utf-8", "surrogatepass").lower()
            key = xxhash.xxh3_128_digest(raw)
            lines[key] = lines.get(key, 0) + len(raw.split())
    keys = np.frombuffer(b"".join(lines), dtype=np.int64).reshape(-1, 2)
    counts = np.fromiter(lines.values(), dtype=np.int64, count=len(lines))
    return len(words), word_chars, symbols, with_words - len(seen), repeated_words(words), keys[:, 0], keys[:, 1], counts


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def quality(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, least_kept_percent: int = LEAST_KEPT_PERCENT) -> DataFrame:
    """doc_id, host, the base counts, base_failed, n_lost, kept of every document of ``docs`` (doc_id, host, text).

    Each text is read once. Its different lines go on as 128-bit keys with their words. A line in more than
    ``most_documents`` different documents of a host is removed from all of them but the one of the smallest doc_id; n_lost is
    the number of words removed. A document is kept if it passes the base rules and keeps ``least_kept_percent`` of
    its words. Keys are counted per task before the shuffle, so a line that a third of the documents share sends one row
    per task and document; Spark splits such a key when rows meet their counts.

    Null and empty texts have no words and fail. A null host is a host of its own. A null doc_id counts for no line and
    loses none. Rows that repeat a doc_id are one document for the counts; each loses what all of them lose together, at most all its words. Other columns are not read.
    """

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "k1", "k2", "n"]
        for batch in batches:
            rows = [text_facts(t) for t in batch["text"]]
            yield batch[["doc_id", "host"]].assign(**{c: [r[i] for r in rows] for i, c in enumerate(names)})

    given = docs.select("doc_id", F.col("host").cast("string").alias("host"), "text")
    schema = with_fields(given.drop("text"), FACTS + ", k1 array<long>, k2 array<long>, n array<long>")
    base = written(given.mapInPandas(facts, schema), "quality-facts")
    lines = base.select("doc_id", "host", F.explode(F.arrays_zip("k1", "k2", "n")).alias("l")).select("doc_id", "host", "l.*")
    known = lines.filter("doc_id is not null").withColumn("host", F.struct("host"))  # a null host joins too
    common = (
        known.groupBy("host", "k1", "k2")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first"))
        .filter(F.col("n_docs") > most_documents)
        .drop("n_docs")
    )
    lost = (
        known.join(common, ["host", "k1", "k2"])
        .filter(F.col("doc_id") != F.col("first"))
        .groupBy(F.col("doc_id").alias("of_doc"))
        .agg(F.sum("n").alias("lost"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    n_lost = F.least(F.coalesce("lost", F.lit(0)), F.col("n_words"))
    return (
        base.drop("k1", "k2", "n")
        .join(lost, F.col("doc_id") == F.col("of_doc"), "left")
        .withColumn("n_lost", n_lost)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * (F.col("n_words") - F.col("n_lost")) >= least_kept_percent * F.col("n_words")))
        .drop("of_doc", "lost")
    )


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The source of a document stands for its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    return quality(docs).drop("host", "n_lost")


SQL = rf"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS key
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM words WHERE len(w) > {WINDOW})
), repeated AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS pos FROM windows
    WHERE (doc_id, key) IN (SELECT (doc_id, key) FROM windows GROUP BY doc_id, key HAVING count(*) > 1)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, line, {sql_lower(f"trim(line, {SQL_SPACES})")} AS key,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM words)
), duplicates AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY doc_id
), common AS (
  SELECT source, key, min(doc_id) AS first FROM lines WHERE n > 0 GROUP BY source, key HAVING count(DISTINCT doc_id) > {MOST_DOCUMENTS}
), lost AS (
  SELECT l.doc_id, sum(l.n) AS n_lost FROM lines l JOIN common c ON l.key = c.key AND l.source IS NOT DISTINCT FROM c.source
  WHERE l.doc_id <> c.first GROUP BY l.doc_id
), facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lost, 0) AS n_lost
  FROM words LEFT JOIN duplicates USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)
    AND 100 * (n_words - n_lost) >= {LEAST_KEPT_PERCENT} * n_words AS kept
FROM facts
"""

QUERIES = {"op5_quality": (op5_quality, SQL)}
