"""A Merkle tree over the documents, with a proof for each of them (operator 13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import sql_crc32, table
from pipecheck.llm.ranks import group_key, placed
from pipecheck.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Children of a node.
FANOUT = 2
# So many levels are climbed with one shuffle: a task holds whole blocks of FANOUT ** LEVELS neighbours.
LEVELS = 10

STEPS = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value so that no two lists of values read alike: ``-`` for null, else its number of bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a document; ``changed`` stands for columns by name."""
    return digest(*(encoded(changed.get(c, F.col(c))) for c in FIELDS))


def climbed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (g, place, size, node) with block, top and path: ``levels`` levels up, or to the group's root if it is nearer.

    At each level the children of a parent are spread into ``fanout`` columns by conditional aggregates. The columns one after
    another give the parent's hash; without the own slot they are the node's siblings, before and after it. The parents' numbers
    are kept from the coarsest to the finest, so one shuffle by block and one sort serve all levels. A level whose group has one node
    left changes nothing. Each row keeps its own way up, so the rows of a parent hold the same hash.
    """
    span = fanout**levels
    ups = {f"up{k}": F.expr(f"place div {fanout**k}") for k in range(levels, 0, -1)}
    start = {"block": F.expr(f"place div {span}"), **ups, "top": F.col("node"), "path": F.array().cast(STEPS)}
    rows = nodes.withColumns(start).repartition("g", "block")
    for k in range(levels):
        family = ", ".join(["g", "block", *(f"up{j}" for j in range(levels, k, -1))])
        slot = F.expr(f"(place div {fanout**k}) % {fanout}")
        children = {
            f"slot{s}": F.expr(f"max(CASE WHEN (place div {fanout**k}) % {fanout} = {s} THEN top END) OVER (PARTITION BY {family})")
            for s in range(fanout)
        }
        rows = rows.withColumns(children)
        slots = [F.coalesce(F.col(name), F.lit("")) for name in children]
        side = {
            "before": F.concat(*(F.when(slot > s, c).otherwise("") for s, c in enumerate(slots))),
            "after": F.concat(*(F.when(slot < s, c).otherwise("") for s, c in enumerate(slots))),
        }
        step = F.array(F.struct(*(c.alias(name) for name, c in side.items())))
        lone = F.col("size") <= fanout**k
        rows = rows.withColumns({
            "path": F.when(lone, F.col("path")).otherwise(F.concat("path", step)),
            "top": F.when(lone, F.col("top")).otherwise(digest(*slots)),
        })
    return rows.select(*nodes.columns, "block", "top", "path")


def to_root(
    nodes: DataFrame, above: Callable[[DataFrame], DataFrame] | None = None, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """``nodes`` (g, place, size, node; a written table) with subroot, root and path: the siblings at all levels, from below.

    Each round climbs some levels and writes the tops of its blocks, the nodes of the next round, until every group is one block. Then
    each round's rows take the rest of their path from the row of their block above: a block has at most
    ``fanout ** levels`` rows, so no key is hot, however many rows a group has. ``above`` goes on from the subroots (g, node): it
    returns g, root, path. Without it the subroot is the root.
    """
    span = fanout**levels
    rounds = [climbed(nodes, fanout, levels)]
    while not rounds[-1].filter(F.col("size") > span).isEmpty():
        tops = rounds[-1].filter(F.col("place") % span == 0)
        tops = tops.select("g", F.col("block").alias("place"), F.ceil(F.col("size") / span).alias("size"), F.col("top").alias("node"))
        rounds.append(climbed(written(tops, "tree-tops"), fanout, levels))
    subroots = written(rounds[-1].filter("place = 0").select("g", F.col("top").alias("node")), "subroots")
    if above:
        rest = above(subroots).select(F.col("g").alias("_g"), "root", F.col("path").alias("rest"))
        upper = subroots.join(rest, F.col("g") == F.col("_g")).select("g", F.lit(0).cast("long").alias("place"), F.col("node").alias("subroot"), "root", "rest")
    else:
        node = F.col("node")
        upper = subroots.select("g", F.lit(0).cast("long").alias("place"), node.alias("subroot"), node.alias("root"), F.array().cast(STEPS).alias("rest"))
    for k in range(len(rounds) - 1, -1, -1):
        right = upper.select(F.col("g").alias("_g"), F.col("place").alias("_place"), "subroot", "root", "rest")
        met = rounds[k].join(right, (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_place"))).withColumn("rest", F.concat("path", "rest"))
        if k:
            upper = written(met.select("g", "place", "subroot", "root", "rest"), "tree-paths")
    return met.select(*nodes.columns, "subroot", "root", F.col("rest").alias("path"))


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, **changed: Column) -> DataFrame:
    """doc_id, lang, leaf, changed_leaf, subroot, root, path of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    The leaves of a language stand by doc_id, null first, rows that repeat a doc_id by their leaves. Every ``fanout`` neighbours,
    and what is left at the end, become their hash, until one is left: the language's subroot. A lone leaf is its own subroot. Subroots,
    null language first, then by UTF-8 bytes, give the root alike. ``path`` holds the siblings of each level before and after
    the node, from the leaf up; ``folded`` goes back up with it. No documents: no rows, and no root. Other columns are not read.

    ``changed`` gives columns of documents as someone else may have them; changed_leaf is their leaf, null where they change nothing.
    """
    leaves = docs.select("doc_id", "lang", leaf().alias("leaf"), (leaf(**changed) if changed else F.lit(None).cast("string")).alias("changed_leaf"))
    leaves = leaves.withColumn("changed_leaf", F.when(F.col("changed_leaf") != F.col("leaf"), F.col("changed_leaf")))
    rows = written(leaves.withColumn("g", group_key(F.col("lang"))), "leaves")
    nodes = written(placed(rows, "g", [F.asc_nulls_first("doc_id"), F.col("leaf")], "leaf-places").withColumn("node", F.col("leaf")), "tree-leaves")

    def over_subroots(subroots: DataFrame) -> DataFrame:
        own = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
        ranks = written(placed(written(own, "subroot-rows"), "g", [F.col("of")], "subroot-places"), "subroot-nodes")
        return to_root(ranks, None, fanout, levels).select(F.col("of").alias("g"), "root", "path")

    return to_root(nodes, over_subroots, fanout, levels).select("doc_id", "lang", "leaf", "changed_leaf", "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, level by level from below, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of a path."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of doc_id, someone has added 1 to n_chars: their leaf must not lead to the root."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.col("n_chars") + F.when(tampered, 1).otherwise(0)
    found = merkle_manifest(docs, n_chars=n_chars)
    root = folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, coalesce(':' || lang, '') AS g,
    sha256({' || '.join(_encoded(c) for c in FIELDS)}) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {sql_crc32("doc_id::VARCHAR")} % 7 = 0
      THEN sha256({' || '.join(_encoded('(n_chars + 1)' if c == 'n_chars' else c) for c in FIELDS)}) END AS changed_leaf
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS size FROM docs
), tree AS (
  SELECT g, 0 AS lvl, place, size, leaf AS node FROM leaves
  UNION ALL
  SELECT g, any_value(lvl) + 1, place // 2, any_value((size + 1) // 2), sha256(string_agg(node, '' ORDER BY place)) FROM tree WHERE size > 1 GROUP BY g, place // 2
), subroots AS (
  SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS size FROM tree WHERE size = 1
), top AS (
  SELECT 0 AS lvl, place, size, subroot AS node FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, place // 2, any_value((size + 1) // 2), sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE size > 1 GROUP BY place // 2
), steps AS (
  SELECT l.doc_id, l.leaf, t.lvl AS lvl, (l.place >> t.lvl) % 2 AS slot, o.node AS other
  FROM leaves l JOIN (SELECT DISTINCT g, lvl FROM tree WHERE size > 1) t USING (g)
  LEFT JOIN tree o ON o.g = l.g AND o.lvl = t.lvl AND o.place = xor(l.place >> t.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, 100 + t.lvl, (s.place >> t.lvl) % 2, o.node
  FROM leaves l JOIN subroots s USING (g) CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE size > 1) t
  LEFT JOIN top o ON o.lvl = t.lvl AND o.place = xor(s.place >> t.lvl, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lvl) AS n FROM steps
), folds AS (
  SELECT doc_id, leaf, 0 AS n, coalesce(changed_leaf, leaf) AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.n + 1, sha256(CASE WHEN s.slot = 0 THEN f.node || coalesce(s.other, '') ELSE coalesce(s.other, '') || f.node END)
  FROM folds f JOIN numbered s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.n = f.n + 1
), proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(coalesce(other, ''), '' ORDER BY n)) AS proof FROM numbered GROUP BY doc_id, leaf
), ends AS (SELECT doc_id, leaf, arg_max(node, n) AS folded_root FROM folds GROUP BY doc_id, leaf)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.node AS verified
FROM leaves l JOIN subroots s USING (g) CROSS JOIN (SELECT node FROM top WHERE size = 1) r
JOIN ends e ON e.doc_id = l.doc_id AND e.leaf = l.leaf LEFT JOIN proofs p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
"""

QUERIES = {"op13_merkle": (op13_merkle, SQL)}
