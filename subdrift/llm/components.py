"""Connected components of links, by stars, in rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``, longs): the smallest node
    that links lead to.

    Every round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones (the two star operations); the rounds needed grow with the logarithm of
    the largest component. A node with very many neighbours is only ever a group of an
    aggregate or the larger side of a join.
    """
    edges = written(_ordered(links.select("a", "b")), "edges")
    while True:
        after = written(_stars(_stars(edges, larger=True), larger=False), "edges")
        changed = after.exceptAll(edges).limit(1).count() or edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    # All edges lead to the smallest node of their component now.
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hangs neighbours of every node on the smallest of them and itself."""
    there = edges.select(F.col("a").alias("hub"), F.col("b").alias("leaf"))
    back = edges.select(F.col("b").alias("hub"), F.col("a").alias("leaf"))
    if larger:
        around = there.union(back)
        # Written first, so that it and the other side of the join are both dealt for the join and
        # a hub with very many leaves can be split.
        least = written(around.groupBy("hub").agg(F.least(F.min("leaf"), F.col("hub")).alias("least")), "least")
        moved = around.where("leaf > hub").join(least, "hub").select(F.col("least").alias("a"), F.col("leaf").alias("b"))
    else:
        # The node itself hangs on its smallest neighbour like the other smaller ones.
        least = written(back.groupBy("hub").agg(F.min("leaf").alias("least")), "least")
        joined = back.join(least, "hub")
        moved = joined.select(F.col("least").alias("a"), F.col("leaf").alias("b")).union(
            joined.select(F.col("least").alias("a"), F.col("hub").alias("b"))
        )
    return _ordered(moved)
