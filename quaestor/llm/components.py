"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.tables import staged


def _least(edges: DataFrame) -> DataFrame:
    """Each a's least b; written, so that the join with it can split the rows of one a."""
    return staged(edges.groupBy("a").agg(F.min("b").alias("low")), "star-low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both)
    joined = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    return joined.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = _least(down)
    joined = down.join(low, "a")
    moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, low) for every node that a link (a, b) touches: low is the least node of its component.

    Rounds go on until the table no longer changes; nodes and links stay on the executors, and each round's table is
    written to the shared folder. Links from a node to itself say nothing and are left out.
    """
    edges = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges) if not edges.isEmpty() else None
    while seen is not None:
        edges = staged(_small_star(staged(_large_star(edges), "star-large")), "star-small")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("low"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("low")).distinct())
