"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.session import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of ``links`` (a, b), as a written table.

    Alternates two steps until every node hangs on its smallest one: each node's larger neighbours go to its smallest
    neighbour, then its smaller neighbours do. The number of rounds grows with the logarithm of the longest
    path. Each round is written to the shared folder, so a lost executor repeats one round at most. Only
    one number per round comes to the driver. Null nodes are left out.
    """
    edges = written(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        .distinct(),
        "links",
    )
    while not _done(edges):
        both = edges.union(edges.select("parent", "node"))
        low = both.groupBy("node").agg(F.min("parent").alias("low"))
        # Larger neighbours move to the smallest node around, the node itself included.
        large = both.join(low, "node").filter(F.col("parent") > F.col("node")).select(
            F.col("parent").alias("node"), F.least("low", "node").alias("parent")
        )
        large = large.distinct()
        low = large.groupBy("node").agg(F.min("parent").alias("low"))
        small = large.join(low, "node")
        moved = small.filter(F.col("parent") > F.col("low")).select(F.col("parent").alias("node"), F.col("low").alias("parent"))
        kept = low.select("node", F.col("low").alias("parent"))
        edges = written(moved.union(kept).distinct(), "links")
    centres = edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return written(edges.select("node", F.col("parent").alias("component")).union(centres), "components")


def _done(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    many = edges.groupBy("node").count().filter("count > 1")
    chained = edges.join(edges.select(F.col("node").alias("parent")), "parent", "left_semi")
    return many.select("node").union(chained.select("node")).isEmpty()
