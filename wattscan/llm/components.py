"""Connected components of an edge table by alternating large and small stars; every round is two joins on written tables.

Nulls: an edge with a null end is left out. Loops and repeated edges don't matter, ties can't occur: a component is named
by its least id. Extra columns are ignored. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattscan.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` pairs -> ``id, root``: the least id of its component for each node that isn't that id itself."""
    edges = cut(edges.select("u", "v").where("u != v").distinct(), "edges")
    while True:
        edges = cut(_star(_star(edges, True), False), "edges")
        # Done when all are stars: every node has one parent, and no parent has one.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
