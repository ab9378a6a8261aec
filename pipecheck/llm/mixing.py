"""Documents are repeated or left out until each source has its share (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipecheck.llm.common import SPACES, table, without
from pipecheck.session import written

# Documents of one source and size are ranked in so many independent bins.
BINS = 65536


def n_words(text: Column) -> Column:
    """Number of runs without the six ASCII white-space characters; null has none."""
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1))
    # White space at either end has an empty piece outside of it.
    outside = [F.substring(text, place, 1).isin(*SPACES).cast("int") for place in (1, -1)]
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - outside[0] - outside[1]).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target of frame source, source_size (one row per source).

    Sources weigh ``weights``, repeating, in code-point order with null last. A target stops
    at ``most`` times the source's size; the sources that stop are those with the smallest
    size per weight, so one pass in that order finds them all: the rest shares what is left
    by weight. One row per source goes through the window, never a document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in weights)), (place + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shares = weighed.select(
        "source",
        "source_size",
        "w",
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left_size"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    # In this order, once a source is under its limit, so are all that follow.
    share = (F.col("w") * F.col("left_size")).cast("double") / F.col("left_w")
    limit = (most * F.col("source_size")).cast("double")
    fits = share <= limit
    first_fit = F.min_by("fit", "left_w_order").over(whole)
    marked = shares.withColumn("fit", F.when(fits, F.struct("left_size", "left_w"))).withColumn(
        "left_w_order", F.when(fits, -F.col("left_w"))
    )
    rest = marked.withColumn("rest", first_fit)
    shared = (F.col("w") * F.col("rest.left_size")).cast("double") / F.col("rest.left_w")
    target = F.when(fits, shared).otherwise(limit)
    return rest.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def start_of(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): the same in every run."""
    text = F.concat(F.lit(f"{seed}"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").cast("double") / float(2**32)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """Copies of each document, by systematic sampling within its source.

    Returns the columns of ``docs`` (doc_id, source, text needed) and size, source_size,
    target, copies, taken. Every document of a source expects target / source_size copies.
    Documents stand in order of size, doc_id mod BINS, doc_id; the running sum of expected
    copies plus the source's offset crosses as many whole numbers in a document as it gets copies.
    Sorted by size, the words taken stay within about one document of the target.

    The rank of a document is the count of documents in earlier sizes, plus that in
    earlier bins of its size, plus its place in the bin: three small windows, so no task
    holds a whole source. Texts are counted where they are read and stay there until the
    copies join them by doc_id.

    Null or empty texts have size 0 and take 0 words. Null sources are one source, the last.
    Rows with the same doc_id, source and size rank side by side and all get the copies of the luckiest of them.
    Clashing columns are replaced. No rows give no rows.
    """
    outputs = ["size", "source_size", "target", "copies", "taken"]
    rest = without(docs, [*outputs, "of_doc", "of_source", "of_size"])
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    right = (
        document_copies(sized, weights, most, seed)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("source").alias("of_source"), F.col("size").alias("of_size"), "source_size", "target")
        .agg(F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    )
    left = rest.withColumn("size", n_words(F.col("text")))
    met = left.join(
        right,
        F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")),
    )
    return met.select(*(F.col(f"`{c}`") for c in rest.columns), *outputs)


def emitted(mix: DataFrame) -> DataFrame:
    """The corpus that ``mix`` (mix_sources) plans: each row ``copies`` times, none for 0, with copy from 1 on. A clashing copy is replaced."""
    return without(mix, ["copy"]).filter("copies > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def document_copies(sized: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of frame doc_id, source, size.

    ``sized`` is read three times; hand in a written table.
    """
    bin_no = F.coalesce(F.pmod(F.col("doc_id"), F.lit(BINS)), F.lit(-1))
    binned = sized.withColumn("bin", bin_no)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    counts = binned.groupBy("source", "size", "bin").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    size_starts = (
        sized.groupBy("source", "size")
        .agg(F.count("*").alias("n"))
        .select("source", "size", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("size_start"))
    )
    bin_starts = counts.select("source", "size", "bin", F.coalesce(F.sum("n").over(in_size), F.lit(0)).alias("bin_start"))
    place = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("doc_id"))
    ranked = binned.withColumn("place", place)
    met = (
        _join(_join(_join(ranked, bin_starts, ["source", "size", "bin"]), size_starts, ["source", "size"]), targets, ["source"])
        .withColumn("rank", F.col("size_start") + F.col("bin_start") + F.col("place"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    start = start_of(F.col("source"), seed)
    crossed = F.floor(start + F.col("rank") * F.col("rate")) - F.floor(start + (F.col("rank") - 1) * F.col("rate"))
    copies = F.least(crossed.cast("long"), F.lit(most).cast("long"))
    return met.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null is a value."""
    renamed = right.select(*(F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return left.join(renamed, condition).drop(*(f"r_{k}" for k in keys))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return document_copies(sized, (5, 2, 1), 3, 1).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), shares AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS left_size,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS left_w
  FROM sources WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fitted AS (
  SELECT *, (w * left_size)::DOUBLE / left_w <= (3 * source_size)::DOUBLE AS fits FROM shares
), rest AS (
  SELECT left_size AS rest_size, left_w AS rest_w FROM fitted WHERE fits ORDER BY left_w DESC LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(CASE WHEN fits THEN (w * rest_size)::DOUBLE / rest_w ELSE (3 * source_size)::DOUBLE END, 0) AS target
  FROM fitted LEFT JOIN rest ON true
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, ((s.doc_id % 65536) + 65536) % 65536, s.doc_id) AS rank,
    CAST('0x' || substr(md5('1' || coalesce('s' || s.source, 'n')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(start + rank * rate) - floor(start + (rank - 1) * rate), 3) * size)::BIGINT AS taken
FROM ranked
"""

QUERIES = {"op3_mixing": (op3_mixing, SQL)}
