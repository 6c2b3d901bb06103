"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and combinable minima over the edge table; nothing
is gathered on the driver but whether a round is the last. Hubs stay harmless:
minima are combined before the shuffle and the joins are joins of a saved table
with its minima, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import drop_saved, save


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser one or only edges from greater ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges hold a > b, and so does the result."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return save(out.where("a > b").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node.

    Loops and rows with a null end are ignored. Nodes that are their own
    component are left out: a missing node is alone or is the least one.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_forest_of_stars(now):
        large = _star(now, True)
        drop_saved(now)
        now = _star(large, False)
        drop_saved(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
