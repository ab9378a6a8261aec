"""Test passages are looked up in an inverted index of the training texts (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipecheck.llm.common import ascii_lower, table, without
from pipecheck.session import written

# Fixed value: what stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = 10
# Neighbouring words of test windows are marked in a table of 2^PAIR_BITS bits.
PAIR_BITS = 23


def words(text: Column) -> Column:
    """Lower-cased words of a text in order; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def test_windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """first, terms, items of every different window of ``items`` (item_id, text), as a written table.

    A window is ``n`` consecutive words; an item of fewer, but not none, is one window.
    ``first`` names the window: its smallest (item_id, pos). ``items`` lists the items it occurs in.
    """
    split = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    windows = split.select("item_id", "words", F.explode(starts).alias("pos")).select(
        "item_id", "pos", F.slice("words", F.col("pos") + 1, F.lit(n)).alias("terms")
    )
    return written(
        windows.groupBy("terms").agg(
            F.min(F.struct("item_id", "pos")).alias("first"), F.sort_array(F.collect_set("item_id")).alias("items")
        ),
        "test-windows",
    )


def _cell(*words: Column) -> Column:
    """The bit of neighbouring words; a null word counts as none."""
    return F.shiftrightunsigned(F.xxhash64(*words), 64 - PAIR_BITS)


def neighbour_marks(windows: DataFrame) -> DataFrame:
    """word, bits: the cells of all neighbours in ``windows`` (terms), and of the words of one-word windows, 64 a row, as a written table.

    It has at most 2^PAIR_BITS bits, whatever the input.
    """
    places = F.sequence(F.lit(1), F.greatest(F.size("terms") - 1, F.lit(1)))
    pairs = windows.select("terms", F.explode(places).alias("k")).select(F.slice("terms", F.col("k"), F.lit(2)).alias("pair"))
    cells = pairs.select(_cell(F.get("pair", F.lit(0)), F.get("pair", F.lit(1))).alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    return written(cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "test-neighbours")


def build_index(docs: DataFrame, terms: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """The stored postings term, doc_id, pos of ``docs`` (doc_id, text) for the given ``terms``.

    Each task writes the posting lists of its own documents, sorted by term, so nothing is shuffled and a
    frequent term is spread over all files; a reader skips the row groups of other terms. Postings are kept for every
    term that some test window needs; other words can be in no match. A row with a null term holds a
    document's number of words in pos. ``terms`` (one column, term) comes from a written table: Spark broadcasts it
    where its files are below the session's limit and shuffles otherwise.

    With ``marks`` (neighbour_marks) the index serves phrases only: a posting is kept where the word stands beside a neighbour that it has in
    some window, or is a window alone. All words of an occurrence do; hashes that agree by chance keep a few postings more.
    """
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    # A second element of each document: its length, under no term.
    listed = F.posexplode(F.concat(F.col("words"), F.array(F.lit(None).cast("string")))).alias("pos", "term")
    if marks is None:
        tokens = split.select("doc_id", listed)
    else:
        beside = {
            "alone": _cell(F.col("term")),
            "next": _cell(F.col("term"), F.get("words", F.col("pos") + 1)),
            "prior": _cell(F.get("words", F.col("pos") - 1), F.col("term")),
        }
        tokens = split.select("doc_id", "words", listed).select("doc_id", "pos", "term", *(c.alias(n) for n, c in beside.items()))
        held = F.col("term").isNull()
        for n in beside:
            own = marks.select(F.col("word").alias(f"{n}_word"), F.col("bits").alias(f"{n}_bits"))
            tokens = tokens.join(F.broadcast(own), F.shiftright(n, 6) == F.col(f"{n}_word"), "left")
            held = held | (F.getbit(f"{n}_bits", F.col(n).bitwiseAND(F.lit(63))) == 1)
        tokens = tokens.filter(held).select("doc_id", "pos", "term")
    wanted = terms.select(F.col("term").alias("wanted"))
    kept = tokens.join(wanted, F.col("term") == F.col("wanted"), "left").filter("wanted is not null or term is null")
    return written(kept.select("term", "doc_id", "pos").sortWithinPartitions("term", "doc_id", "pos"), "postings")


def ranked_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """first, size, ranked of each window: its terms as structs (n, off, term), rarest first, as a written table.

    ``n`` is how often a term is in the index. Windows with a term that no document has are left out.
    """
    counts = index.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    parts = windows.select("first", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    ranked = (
        parts.join(counts, "term")
        .groupBy("first", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("ranked"))
        .filter(F.size("ranked") == F.col("size"))
    )
    return written(ranked, "ranked-windows")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, first, start, size of every occurrence of a window in a document.

    The list of the rarest term gives where a window could start: pos - off. The list of the next rarest, shifted by
    its own offset, leaves the starts that both agree on. What remains must be in the lists of all other terms.
    Frequent terms are only read for starts that two rare ones have confirmed.
    """
    lists = index.filter("term is not null")
    rare = ranked.select(
        "first", "size", F.col("ranked")[0].alias("a"), F.get("ranked", F.lit(1)).alias("b"), F.slice("ranked", 3, 1 << 20).alias("rest")
    )
    anchors = rare.select(F.col("a.term").alias("term"), F.col("a.off").alias("off"), "first")
    starts = lists.join(anchors, "term").select("doc_id", "first", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")
    # The second list: all (doc_id, pos) of terms that are second rarest somewhere.
    seconds = rare.filter("b is not null").select(F.col("first").alias("w"), F.col("b.term").alias("term"), F.col("b.off").alias("off"))
    second_lists = lists.join(seconds.select("term").distinct(), "term", "left_semi")
    need = starts.join(rare.select(F.col("first").alias("w"), "b"), F.col("first") == F.col("w")).select("doc_id", "first", "start", "b")
    alone = need.filter("b is null").select("doc_id", "first", "start")
    paired = need.filter("b is not null").select(
        "doc_id", "first", "start", (F.col("start") + F.col("b.off")).alias("pos"), F.col("b.term").alias("term")
    )
    agreed = paired.join(second_lists, ["doc_id", "pos", "term"], "left_semi").select("doc_id", "first", "start")
    candidates = written(alone.unionByName(agreed), "window-starts")
    # All other lists, for the starts that are left.
    known = candidates.join(rare.select(F.col("first").alias("w"), "size", "rest"), F.col("first") == F.col("w")).drop("w")
    done = known.filter(F.size("rest") == 0).select("doc_id", "first", "start", "size")
    open_ = known.filter(F.size("rest") > 0).select("doc_id", "first", "start", "size", F.explode("rest").alias("t"))
    wanted = open_.select("doc_id", "first", "start", "size", (F.col("start") + F.col("t.off")).alias("pos"), F.col("t.term").alias("term"))
    met = wanted.join(lists, ["doc_id", "pos", "term"], "left_semi")
    whole = met.groupBy("doc_id", "first", "start", "size").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("size") - 2)
    return done.unionByName(whole.drop("n"))


def proximity_matches(index: DataFrame, ranked: DataFrame, slack: int) -> DataFrame:
    """doc_id, first, start, size of every place that has all terms of a window close together.

    A match has all different terms of the window within ``size + slack`` positions around an occurrence of its rarest term, in any
    order. ``start`` is the first of these positions. Postings near an anchor are found by blocks of positions: each anchor
    looks into its own block and the two beside it.
    """
    lists = index.filter("term is not null")
    parts = ranked.select("first", "size", F.col("ranked")[0].alias("a"), F.array_distinct(F.transform("ranked", lambda r: r["term"])).alias("terms"))
    anchors = parts.select(F.col("a.term").alias("term"), "first", "size", "terms")
    span = int(ranked.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]) + slack  # one number
    at = lists.join(anchors, "term").select("doc_id", "first", "size", "terms", F.col("pos").alias("at"))
    blocks_near = F.array(*(F.floor(F.col("at") / span) + d for d in (-1, 0, 1)))
    near = at.select("*", F.explode(blocks_near).alias("block")).select("*", F.explode("terms").alias("term"))
    blocks = lists.select("doc_id", "term", "pos", F.floor(F.col("pos") / span).alias("block"))
    hits = near.join(blocks, ["doc_id", "term", "block"]).filter(F.abs(F.col("pos") - F.col("at")) < F.col("size") + slack)
    by_anchor = hits.groupBy("doc_id", "first", "size", "at", F.size("terms").alias("n_terms")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("found")
    )
    # Windows of positions that begin at a found posting and reach size + slack.
    each = by_anchor.select("*", F.explode(F.transform("found", lambda f: f["pos"])).alias("start"))
    inside = F.filter("found", lambda f: (f["pos"] >= F.col("start")) & (f["pos"] < F.col("start") + F.col("size") + slack))
    held = each.withColumn("n_found", F.size(F.array_distinct(F.transform(inside, lambda f: f["term"]))))
    full = held.filter((F.col("n_found") == F.col("n_terms")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("size") + slack))
    return full.select("doc_id", "first", "start", "size").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = WORDS, slack: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated of every document of ``docs`` (doc_id, text).

    A word is hit if it lies in an occurrence of a window of ``items`` (item_id, text). ``item_ids`` are sorted as strings.
    A null or empty text has no words; a text without hits has an empty list. Rows that repeat a doc_id are read as one
    document with the positions of all of them, and give one row each; a null doc_id gives a row without hits.
    Null item ids are left out of lists, their windows still hit. No items: nothing is hit. Other columns of
    the inputs are not read.

    With ``slack``, n_near follows: the number of places that have all words of a window within its size + slack positions
    (proximity_matches), phrases included. It changes no other column.
    """
    windows = test_windows(items, n)
    terms = written(windows.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    index = build_index(docs, terms, neighbour_marks(windows) if slack is None else None)
    ranked = ranked_terms(windows, index)
    matches = written(phrase_matches(index, ranked), "phrase-matches")
    # Words covered by overlapping occurrences, counted once: each adds what lies past all earlier ends.
    ends = matches.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    earlier = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    past = ends.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    hits = past.groupBy(F.col("doc_id").alias("h_doc")).agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    of_window = windows.select(F.col("first").alias("w"), "items")
    found = (
        matches.select("doc_id", "first").distinct().join(of_window, F.col("first") == F.col("w"))
        .select("doc_id", F.explode("items").alias("item")).distinct()
        .groupBy(F.col("doc_id").alias("i_doc"))
        .agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("found_items"))
    )
    lengths = index.filter("term is null").select("doc_id", F.col("pos").cast("long").alias("n_words"))
    exact = (
        lengths.join(hits, F.col("doc_id") == F.col("h_doc"), "left")
        .join(found, F.col("doc_id") == F.col("i_doc"), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("found_items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("found_items", F.array().cast("array<string>")).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
    if slack is None:
        return exact
    near = proximity_matches(index, ranked, slack).groupBy(F.col("doc_id").alias("p_doc")).agg(F.count("*").alias("near"))
    met = exact.join(near, F.col("doc_id") == F.col("p_doc"), "left")
    return met.select(*exact.columns, F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    sha = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


SQL = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {WORDS}) AS size, array_to_string(w[i:i + {WORDS - 1}], ' ') AS key
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), starts AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM doc_words WHERE len(w) > 0
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM starts, sizes WHERE i + size - 1 <= len(w)
), found AS (
  SELECT d.doc_id, d.i, d.size, b.item_id FROM doc_windows d JOIN item_windows b USING (size, key)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op1_decontamination": (op1_decontamination, SQL)}
