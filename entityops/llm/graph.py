"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityops.llm.storage import shared_folder, table


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node of its component.

    Each round links the neighbours of a node to the smallest of them, once over larger and once over
    smaller neighbours, and is written out. Rounds grow with the logarithm of the longest path. Minima are
    partial aggregates; a node with many neighbours is split by the join.
    """
    folder = folder or shared_folder(edges.sparkSession)
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    number = 0
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, f"large-{number}", folder)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = table(linked.union(low.select("a", F.col("m").alias("b"))).distinct(), f"small-{number}", folder)
        # Done when every edge leads to a root, that is, to a node without an edge of its own.
        if current.join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        number += 1


def merged(found: DataFrame | None, edges: DataFrame, folder: str | None = None) -> DataFrame:
    """Components (see ``components``) of the links behind ``found`` and of ``edges`` together.

    Components found before are contracted to their roots, so only the new links go through rounds. The smallest of
    several roots is the smallest node of them all.
    """
    if found is None:
        return components(edges, folder)
    roots = [found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    short = edges.join(roots[0], "a", "left").join(roots[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    new = components(short, folder)  # no node of it is one of found: those are contracted
    moved = found.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(new)
