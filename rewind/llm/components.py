"""Connected components by repeated contraction, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def contract(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, comp) of nodes after joining what links (a, b) connect; a and b are comps.

    Each step moves every comp to the neighbour (or itself) of least hash and keeps the
    links between different comps, until none is left. As the order is a hash, the number
    of comps that still have links falls by a constant factor a step, whatever the shape.
    """
    edges = durable(links.filter("a <> b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("c"))
        moves = durable(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("comp"), F.least(order("a"), F.col("m"))["c"].alias("to")))
        nodes = durable(nodes.join(moves, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp")))
        left = edges.join(moves.select(F.col("comp").alias("a"), F.col("to").alias("u")), "a").join(moves.select(F.col("comp").alias("b"), F.col("to").alias("v")), "b")
        edges = durable(left.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    return nodes
