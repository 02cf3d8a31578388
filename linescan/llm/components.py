"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep

#: The neighbours of a node are dealt to so many parts, so that a node with very many is no single task's work.
PARTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one: the larger neighbours, or the smaller ones and the node."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    joined = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(least.withColumn("part", parts), ["u", "part"])
    if large:
        hung = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(u, root) for each node of ``edges`` (u, v): root is the least node of its component.

    Nodes are values of any type with an order. No neighbour list is ever
    gathered: a round takes minima and joins them back. Rounds stop when every
    edge hangs on a root; they are bounded by the square of the logarithm of the
    number of edges, 50 at least, which the method needs at most. Without edges
    there are no rows.
    """
    now = keep(edges.where("u <> v").distinct(), "edges")
    if most_rounds is None:
        most_rounds = max(50, math.ceil(math.log2(now.count() + 2)) ** 2)
    for _ in range(most_rounds):
        now = keep(_star(_star(now, True), False), "stars")
        # Done when each node has one parent and no parent has a parent.
        twice = now.groupBy("u").count().where("count > 1").select("u")
        inner = now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi")
        if twice.union(inner).isEmpty():
            return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")
