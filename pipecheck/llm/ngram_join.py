"""Documents with nearly the same word n-grams, found by their rarest ones (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import pieces, table
from pipecheck.llm.components import components
from pipecheck.session import written

WORDS = 5
# Similarity in percent: linked where 100 * shared >= PERCENT * union.
PERCENT = 80
# Frequencies are counted in 2^BITS hashed cells.
BITS = 18
# Documents in pairs are looked up by a table of 2^MARK_BITS bits before their texts go on.
MARK_BITS = 23
# The suffix filter compares how many n-grams of each text fall into so many hashed parts.
PARTS = 32

# Bytes of texts that are cut into n-grams together.
PIECE = 1 << 20
# Words of more bytes are hashed one by one.
LONG_WORD = 64

_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
# Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hash of a word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = own = xxhash.xxh3_64_intdigest(word)
        return own


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD[1]
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    return h ^ (h >> np.uint64(29))


def _word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[start:end], eight bytes of all words at a time. Eight more bytes stand behind the last word."""
    size = end - start
    own = size.astype(np.uint64) * _ODD[0]
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each place on
    rows, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(rows):
        left = size[rows] - done
        own[rows] = _mixed(own[rows] ^ (eights[start[rows] + done] & _FIRST[np.minimum(left, 8)]))
        rows, done = rows[left > 8], done + 8
    for k in np.flatnonzero(size > LONG_WORD):
        own[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return own


def _sets(raw: bytes, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sets of texts that stand one behind the other in ``raw``, up to ``ends``, and eight more bytes."""
    # bytes.translate knows A-Z and the six kinds of white space of the contract only.
    raw = raw.translate(_FOLDED)
    inside = np.frombuffer(raw, dtype=np.uint8)[: ends[-1]] != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(inside))]  # a word also ends with its text
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    start = np.flatnonzero(first)
    own = _word_hashes(raw, start, np.flatnonzero(last) + 1)
    whole = np.full(max(len(own) - WORDS + 1, 0), WORDS, dtype=np.uint64)
    for k in range(WORDS):
        whole += own[k : k + len(whole)] * _ODD[k]
    lo = 0
    for hi in np.searchsorted(start, ends).tolist():
        if hi - lo >= WORDS:
            keys = np.sort(whole[lo : hi - WORDS + 1])
            yield keys[np.append(True, keys[1:] != keys[:-1])]
        else:
            size = hi - lo
            yield np.array([size], dtype=np.uint64) + (own[lo:hi] * _ODD[:size]).sum(dtype=np.uint64) if size else own[:0]
        lo = hi


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text's word n-grams as sorted 64-bit hashes; fewer words than n are one n-gram, null has none.

    The UTF-8 bytes of some hundred texts go through each step together.
    """
    return [keys for raw, ends in pieces(texts, PIECE) for keys in _sets(raw + bytes(8), ends)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one column of array<long>."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, dtype=np.int64), *(a.view(np.int64) for a in arrays)]))


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def shingle_facts(docs: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2 of each document (doc_id, text) and cells, counts of each task, as one written table.

    n is the size of a document's set and d1, d2 a 128-bit digest of it. A task also adds up how often each hashed cell of
    n-grams occurs in its documents; that row has no digest.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names = np.zeros(1 << BITS, dtype=np.int64), ["doc_id", "n", "d1", "d2", "cells", "counts"]
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            if sets:
                cells += np.bincount(_cells(np.concatenate(sets)), minlength=1 << BITS)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), dtype=np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.list_(pa.int32())), pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(digests[::2]), pa.array(digests[1::2]), *none], names)
        used = np.flatnonzero(cells)
        own = pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([cells[used]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.nulls(1, pa.int64()) for _ in range(3)), *own], names)

    schema = "doc_id string, n long, d1 long, d2 long, cells array<int>, counts array<long>"
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = ids.mapInArrow(facts, schema)
    return written(made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "shingle-facts")


def cell_counts(facts: DataFrame) -> np.ndarray:
    """How often each cell occurs, over all documents: an array of fixed size, whatever the input."""
    pairs = facts.filter("cells is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).select("c.*")
    sums = pairs.groupBy("cells").agg(F.sum("counts").alias("n")).toArrow()
    counts = np.zeros(1 << BITS, dtype=np.int64)
    counts[sums["cells"].to_numpy()] = sums["n"].to_numpy()
    return counts


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of a set's n-grams, the rarest, hold one of every set that is similar enough."""
    return n - -(-n * percent // 100) + 1


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n, prefix, parts of each document with words: its rarest n-grams in order, and how many fall into each part.

    The order is the frequency of the cell, then the hash: the same in all documents.
    """

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            found = [k for k, keys in enumerate(sets) if len(keys)]
            prefix, parts = [], []
            for keys in map(sets.__getitem__, found):
                prefix.append(keys[np.argsort(counts[_cells(keys)], kind="stable")[: prefix_length(len(keys))]])
                parts.append(np.bincount((keys & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS))
            n = pa.array([len(sets[k]) for k in found], pa.int32())
            ids = batch.column("doc_id").take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, n, _lists(prefix), _lists(parts)], ["doc_id", "n", "prefix", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return rows.mapInArrow(rarest, "doc_id long, n int, prefix array<long>, parts array<long>")


def _least_shared(n: Column, m: Column) -> Column:
    """Smallest number of shared n-grams with which sets of sizes n and m are similar enough."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def _could(a: str, b: str) -> Column:
    """Length and positional filter of two entries (n, pos from 0) of one n-gram.

    Similar sets meet in the first n-gram, in the common order, that they share. All they share stands there or
    behind it in both, so it must leave enough room in both. A later common n-gram need not bring the pair again.
    """
    n, m, p, q = (F.col(f"{e}.{f}") for f in ("n", "pos") for e in (a, b))
    length = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    return length & (F.least(n - p, m - q) >= _least_shared(n, m))


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may be in ``wanted`` (doc_id): all that are, and few others.

    The wanted ids are marked in a table of at most 2^MARK_BITS bits, 64 a row: the bound of the broadcast, whatever the input. So the
    texts of other documents are dropped where they are read.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS))
    bit = F.expr("shiftleft(1L, cast(pmod(cell, 64) as int))")
    marks = wanted.select(cell.alias("cell")).groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    placed = docs.withColumn("cell", cell).withColumn("of_word", F.expr("cell div 64"))
    met = placed.join(F.broadcast(marks), F.col("of_word") == F.col("word")).filter(F.col("bits").bitwiseAND(bit) != 0)
    return met.select(*docs.columns)


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough. ``sizes`` has doc_id, n, parts.

    The suffix filter goes first: two sets share at most the smaller count of each part. Then each pair's sets
    are made from the texts, for documents in pairs only, and compared once.
    """
    counted = sizes.select("doc_id", "n", "parts")
    a, b = (counted.select(*(F.col(c).alias(f"{s}_{c}") for c in counted.columns)) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_doc_id")).join(b, F.col("b") == F.col("b_doc_id"))
    bound = F.aggregate(F.zip_with("a_parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    left = written(both.filter(bound >= _least_shared(F.col("a_n"), F.col("b_n"))).select("a", "b"), "pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(shingle_sets(batch.column("text")))], ["doc_id", "keys"])

    wanted = left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct()
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted)
    keys = texts.mapInArrow(sets, "doc_id long, keys array<long>").dropDuplicates(["doc_id"])
    keys = written(keys, "shingle-sets")
    met = left.join(keys.select(F.col("doc_id").alias("a"), F.col("keys").alias("a_keys")), "a").join(
        keys.select(F.col("doc_id").alias("b"), F.col("keys").alias("b_keys")), "b"
    )
    shared = met.select("a", "b", F.size("a_keys").alias("n"), F.size("b_keys").alias("m"), F.size(F.array_intersect("a_keys", "b_keys")).alias("s"))
    return shared.filter(100 * F.col("s") >= PERCENT * (F.col("n") + F.col("m") - F.col("s"))).select("a", "b")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document of ``docs`` (doc_id, text).

    Documents with equal sets become one, the smallest doc_id, however many they are. The rest join on their rarest n-grams,
    in two rounds. First, every document that shares a rare n-gram is compared with the smallest document that has it: as
    many pairs as entries, so thousands of near copies of one text meet their centre, not each other. Then pairs
    are only needed between different components: the members of an n-gram outside its centre's component
    meet those of other components. What is left out joins documents already known to be connected, so no component loses a link.

    A text of one to four words is one n-gram of all its words; null texts and texts without words have none and stay
    alone. A null doc_id has a null component_id and joins nothing. Rows that repeat a doc_id are in the component of one of them if their texts
    differ. Other columns are not read. N-grams are compared by 64-bit hashes.
    """
    facts = shingle_facts(docs)
    counts = cell_counts(facts)
    known = facts.filter("cells is null").select("doc_id", "n", "d1", "d2")
    classes = written(
        known.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "shingle-classes"
    )
    rare = written(
        prefixes(docs, counts).dropDuplicates(["doc_id"]).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "prefixes"
    )
    # An entry's place and document as one number: the smallest is the centre, the document with the fewest rarer n-grams.
    entries = rare.select("doc_id", "n", F.posexplode("prefix").alias("pos", "key")).select(
        "key", F.struct("doc_id", "n", "pos").alias("e"),
        (F.shiftleft(F.col("pos").cast("long"), 40) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).alias("place"),
    )
    centres = entries.groupBy("key").agg(F.min("place").alias("least"), F.count("*").alias("size")).filter("size > 1").select("key", "least")
    members = written(entries.join(centres, "key").select("key", "e", (F.col("place") == F.col("least")).alias("central")), "shared-prefixes")
    met = members.join(members.filter("central").select("key", F.col("e").alias("c")), "key").select("key", "e", "c")
    first = written(
        met.filter("e.doc_id <> c.doc_id")
        .filter(_could("e", "c"))
        .select(F.least("c.doc_id", "e.doc_id").alias("a"), F.greatest("c.doc_id", "e.doc_id").alias("b"))
        .distinct(),
        "pairs-with-centres",
    )
    first_links = written(verified(first, docs, rare), "links-to-centres")
    own = components(first_links)
    # Second round: entries with their component and that of a centre of theirs.
    placed = members.select("key", "e", "central", F.col("e.doc_id").alias("of_doc")).join(own, F.col("of_doc") == F.col("node"), "left")
    placed = placed.select("key", "e", "central", F.coalesce("component", "of_doc").alias("part"))
    mains = placed.groupBy("key").agg(
        F.min(F.when(F.col("central"), F.col("part"))).alias("main"), F.min("part").alias("low"), F.max("part").alias("high")
    ).filter("low < high").select("key", "main")
    mixed = written(placed.join(mains, "key").select("key", "e", "part", "main"), "mixed-entries")
    outside = mixed.filter("part <> main").select("key", F.col("e").alias("x"), F.col("part").alias("x_part"))
    others = mixed.select("key", F.col("e").alias("y"), F.col("part").alias("y_part"), "main")
    second = (
        outside.join(others, "key")
        .filter("x_part <> y_part and (y_part = main or x.doc_id < y.doc_id)")
        .filter(_could("x", "y"))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    second_links = verified(second, docs, rare)
    parts = components(first_links.union(second_links))
    of_rep = classes.join(parts, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = known.join(of_rep, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_ngram_join": (op9_ngram_join, None)}
