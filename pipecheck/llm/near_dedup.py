"""Near copies found in a forest of sorted MinHash signatures (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipecheck.llm.common import table
from pipecheck.llm.components import components
from pipecheck.llm.ngram_join import _WordHashes, marked
from pipecheck.session import written

WORDS = 2
# Similarity in percent: linked where 100 * shared >= PERCENT * union.
PERCENT = 80
# Signature orders, and the 8-bit MinHash values that each of them sorts by.
TREES, DEPTH = 32, 8
# Neighbours in an order have at least so many of its values in common, and stand at most so many rows apart.
LEAST_DEPTH, REACH = 3, 8
# So many closest neighbours of a document are compared before all others.
CLOSEST = 3
# Bits of a sketch, each of a further MinHash. Similar sets agree in 90 % of them and more; five standard deviations of this are allowed for.
SKETCH = 128
AGREE = int(SKETCH * (0.5 + PERCENT / 200) - 5 * (SKETCH * 0.25 * (1 - (PERCENT / 100) ** 2)) ** 0.5)

_LEAD = np.uint64(0x9E3779B97F4A7C15)


class Signer:
    """Sets of word n-grams as sorted 64-bit hashes, and their MinHash signatures."""

    def __init__(self):
        self.words = _WordHashes()
        fixed = np.random.default_rng(11)
        count = TREES * DEPTH
        self.mask = fixed.integers(0, 1 << 32, (count, 1), dtype=np.uint32)
        self.factor = fixed.integers(0, 1 << 32, (count, 1), dtype=np.uint32) | np.uint32(1)

    def shingles(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII only, as the contract's A-Z and white space.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        own = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(WORDS, len(own))
        n = len(own) - size + 1
        keys = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            keys = (keys + own[k : k + n]) * _LEAD
            keys ^= keys >> np.uint64(29)
        return np.unique(keys)

    def least(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each of TREES * DEPTH hash functions over a set."""
        low = np.full(len(self.mask), 0xFFFFFFFF, dtype=np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), 1024):
            low = np.minimum(low, ((short[k : k + 1024] ^ self.mask) * self.factor).min(axis=1))
        return low

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TREES keys of DEPTH bytes, the first value in front, and the sketch of SKETCH bits as longs."""
        low = self.least(shingles)
        keys = low.astype(np.uint8).reshape(TREES, DEPTH).view(">u8").ravel().astype(np.uint64).view(np.int64)
        bits = ((low[:SKETCH] >> np.uint32(8)) & np.uint32(1)).astype(np.uint8)
        return keys, np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2, keys, s1, s2 of each row of ``docs`` (doc_id, text), as a written table.

    n is the size of the document's set, d1 and d2 a 128-bit digest of it, keys its place in each signature order, s1 and s2 its
    sketch. A set without n-grams has zeros.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            count = batch.num_rows
            n, digests = np.zeros(count, dtype=np.int64), np.zeros((count, 2), dtype=np.int64)
            keys, sketches = np.zeros((count, TREES), dtype=np.int64), np.zeros((count, 2), dtype=np.int64)
            for k, text in enumerate(batch.column("text")):
                own = signer.shingles(text.as_py())
                if len(own):
                    n[k] = len(own)
                    digests[k] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
                    keys[k], sketches[k] = signer.signature(own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * TREES, TREES, dtype=np.int32)), pa.array(keys.ravel()))
            columns = [batch.column("doc_id"), pa.array(n), *map(pa.array, digests.T), lists, *map(pa.array, sketches.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "keys", "s1", "s2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, d1 bigint, d2 bigint, keys array<bigint>, s1 bigint, s2 bigint"
    return written(docs.select("doc_id", "text").mapInArrow(made, schema), "signatures")


def forest(sets: DataFrame) -> DataFrame:
    """tree, key and the other columns of ``sets``: each set once in every signature order."""
    return sets.select(F.posexplode("keys").alias("tree", "key"), *(c for c in sets.columns if c != "keys"))


def _agreement(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Equal bits of two sketches."""
    differ = np.bitwise_count((a1 ^ b1).view(np.uint64)).astype(np.int64) + np.bitwise_count((a2 ^ b2).view(np.uint64))
    return SKETCH - differ


def _near_rows(rows: pd.DataFrame, reach: int, closest: bool) -> pd.DataFrame:
    """Pairs (a, b, agree) of sorted forest rows that are neighbours of different components and may be similar.

    ``closest`` keeps for each row the pair of the closest sketches alone.
    """
    tree, key, n, s1, s2, of = (rows[c].to_numpy() for c in ("tree", "key", "n", "s1", "s2", "component"))
    found = [(np.empty(0, dtype=np.int64),) * 3]
    for apart in range(1, min(reach, len(rows) - 1) + 1):
        x, y = slice(None, -apart), slice(apart, None)
        common = ((key[x] ^ key[y]).view(np.uint64) >> np.uint64(64 - 8 * LEAST_DEPTH)) == 0
        sized = 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
        at = np.flatnonzero((tree[x] == tree[y]) & common & sized & (of[x] != of[y]))
        agree = _agreement(s1[at], s2[at], s1[at + apart], s2[at + apart])
        at, agree = at[agree >= AGREE], agree[agree >= AGREE]
        found.append((at, at + apart, agree))
    at, other, agree = (np.concatenate(parts) for parts in zip(*found, strict=True))
    if closest:
        order = np.argsort(-agree, kind="stable")
        at, other, agree = at[order], other[order], agree[order]
        firsts = np.unique(np.concatenate([np.unique(ends, return_index=True)[1] for ends in (at, other)]))
        at, other, agree = at[firsts], other[firsts], agree[firsts]
    ids = rows["doc_id"].to_numpy()
    return pd.DataFrame({"a": ids[at], "b": ids[other], "agree": agree})


def neighbour_pairs(sets: DataFrame, reach: int = REACH, closest: bool = False) -> DataFrame:
    """a, b, agree of documents of different components that stand close together in some signature order, as a written table.

    ``sets`` has doc_id, n, keys, s1, s2, component. All orders are dealt by ranges of (tree, key, doc_id) and sorted, so an order is spread over
    tasks, and a region of equal keys too. A row meets the next ``reach`` rows of its order as long as they share the first LEAST_DEPTH
    values. So the depth adapts to the region: where it is sparse the neighbours share these few values, where it is dense they share most of
    them. Pairs whose sizes or sketches exclude the wanted similarity go at once, and with ``closest`` all but each row's closest one. The
    first and last rows of each task meet those of the next in one small task more: at most 2 * reach rows of each.
    """
    rows = forest(sets)
    keys = ["tree", "key", "doc_id"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id())

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, head = ["a", "b", "agree", *columns], None, 0

        def shaped(part: pd.DataFrame) -> pd.DataFrame:
            return part.assign(**{c: None for c in names if c not in part.columns})[names]

        for batch in batches:
            if not len(batch):
                continue
            first = batch.head(max(0, reach - head))
            head += len(first)
            yield shaped(first)
            joined = batch if held is None else pd.concat([held, batch], ignore_index=True)
            yield shaped(_near_rows(joined, reach, closest))
            held = joined.tail(reach).reset_index(drop=True)
        if held is not None:
            yield shaped(held)

    columns, kind = [*rows.columns, "task"], sets.schema["doc_id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, agree bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    met = written(dealt.mapInPandas(scanned, schema), "forest-neighbours")
    edges = met.filter("task is not null").select(*rows.columns).distinct()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if whole:
            yield _near_rows(pd.concat(whole, ignore_index=True), reach, closest)

    between = edges.repartition(1).sortWithinPartitions(*keys).mapInPandas(across, f"a {kind}, b {kind}, agree bigint")
    pairs = met.filter("task is null").select("a", "b", "agree").union(between)
    return written(_ordered(pairs), "neighbour-pairs")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller document first."""
    return pairs.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree"))


def hub_pairs(sets: DataFrame, links: DataFrame) -> DataFrame:
    """a, b of the documents that share the first LEAST_DEPTH values of some order with the hub of another component, and may be similar.

    ``sets`` has each document's component. The hub is the document of most links of a component of three or more; a region of an order has one, that
    of the largest component in it. In a large group of copies of one text this is the text itself: a copy that resembles nothing else
    need not stand next to it in a dense region, but meets it here. Entries that no hub shares are dropped by a bit table
    before they are shuffled, and entries of the hub's own component where they meet it.
    """
    ends = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("degree"))
    best = sets.select("doc_id", "component").join(ends, "doc_id").groupBy("component").agg(
        F.count("*").alias("size"), F.min(F.struct(-F.col("degree"), F.col("doc_id"))).alias("hub")
    )
    hubs = best.filter("size > 2").select(F.col("hub.doc_id").alias("hub"), "size")
    near = F.xxhash64(F.struct("tree", F.shiftright("key", 64 - 8 * LEAST_DEPTH)))
    rows = forest(sets).withColumn("near", near).drop("tree", "key")
    facts = ("doc_id", "n", "s1", "s2", "component")
    of_hubs = rows.join(hubs, F.col("doc_id") == F.col("hub")).groupBy("near").agg(F.max(F.struct("size", *facts)).alias("h"))
    of_hubs = written(of_hubs.select("near", *(F.col(f"h.{c}").alias(f"h_{c}") for c in facts)), "hub-entries")
    # The bit table looks up a column doc_id.
    wanted = of_hubs.select(F.col("near").alias("doc_id"))
    others = marked(rows.select(F.col("near").alias("doc_id"), F.col("doc_id").alias("of"), "n", "s1", "s2", "component"), wanted)
    agree = SKETCH - F.bit_count(F.col("s1").bitwiseXOR(F.col("h_s1"))) - F.bit_count(F.col("s2").bitwiseXOR(F.col("h_s2")))
    close = (F.col("component") != F.col("h_component")) & (100 * F.least("n", "h_n") >= PERCENT * F.greatest("n", "h_n")) & (agree >= AGREE)
    met = others.join(of_hubs, (F.col("doc_id") == F.col("near")) & close)
    return met.select(F.least("of", "h_doc_id").alias("a"), F.greatest("of", "h_doc_id").alias("b"))


def closest_each(pairs: DataFrame, most: int = CLOSEST) -> DataFrame:
    """a, b of the ``most`` pairs of the closest sketches of each document."""
    both = pairs.select(F.col("a").alias("doc"), "a", "b", "agree").union(pairs.select("b", "a", "b", "agree"))
    order = Window.partitionBy("doc").orderBy(F.desc("agree"), "a", "b")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets, as a written table.

    Sets are made from the texts of the documents in pairs alone; a bit table drops the others where they are read.
    """
    pairs = written(pairs.select("a", "b"), "candidate-pairs")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "keys": [signer.shingles(t).view(np.int64) for t in batch["text"]]})

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = marked(docs.select("doc_id", "text").filter("doc_id is not null"), wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(texts.mapInPandas(sets, f"doc_id {kind}, keys array<bigint>").dropDuplicates(["doc_id"]), "full-sets")
    a, b = (made.select(F.col("doc_id").alias(s), F.col("keys").alias(f"{s}_keys")) for s in "ab")
    sizes = pairs.join(a, "a").join(b, "b").select(
        "a", "b", (F.size("a_keys") + F.size("b_keys")).alias("both"), F.size(F.array_intersect("a_keys", "b_keys")).alias("shared")
    )
    return written(sizes.filter(100 * F.col("shared") >= PERCENT * (F.col("both") - F.col("shared"))).select("a", "b"), "links")


def near_copies(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Equal sets become one, the smallest doc_id, however many they are. The candidates of the rest are neighbours in the sorted
    orders. They are confirmed on full sets in two rounds: for each document its CLOSEST neighbours; then, between what is not yet connected, all
    neighbours and the hubs of components. A pair within a component adds nothing to it, so the second round reads the orders with
    the components of the first, and drops such pairs where they are found: a group of thousands of copies takes a few pairs per document.

    Links are exact, finding them is not: a pair of similarity 0.8 shares the first LEAST_DEPTH values of none of the TREES orders in 1 of
    10^10 cases, and is missed if too many others stand between the two in all of them. Tests and README have measured shares.

    A text of one word is one n-gram; null texts and texts without words have none and stay alone. A null doc_id has a null component_id,
    joins nothing and is not kept. Rows that repeat a doc_id are in the component of one of them if their texts differ. Other columns are not read.
    """
    known = signatures(docs)
    classes = written(known.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "set-classes")
    sets = known.filter("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = written(sets.select("doc_id", "n", "keys", "s1", "s2"), "class-signatures")
    first = neighbour_pairs(sets.withColumn("component", F.col("doc_id")), reach, closest=True)
    links = confirmed(closest_each(first), docs)
    parts = components(links)
    of_parts = sets.join(parts, F.col("doc_id") == F.col("node"), "left").select(*sets.columns, F.coalesce("component", "doc_id").alias("component"))
    of_parts = written(of_parts, "sets-of-components")
    open_ = neighbour_pairs(of_parts, reach).select("a", "b").union(hub_pairs(of_parts, links)).distinct()
    parts = components(links.union(confirmed(open_, docs)))
    of_class = classes.join(parts, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = known.join(of_class, ["d1", "d2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op11_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_near_dedup": (op11_near_dedup, None)}
