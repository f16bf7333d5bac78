"""Connected components over edge tables, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) to (node, component): each node of an edge with the smallest node
    that it can reach.

    Alternating star contraction: in a large star every greater neighbour of a
    node moves to the least node nearby, in a small star every lesser one does;
    the edges become stars around the least nodes in a number of rounds that
    grows with the logarithm of a component's size.  A round is two aggregations
    with map-side sums and two joins that stream the edges of a node, a star's in
    one task; nothing is collected but a count and a checksum a round.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e, seen = stash(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(down, "b")
        e = moved.select(F.col("m").alias("a"), F.explode(F.array(F.col("a"), F.col("b"))).alias("b")).where("a <> b").distinct()
        e = stash(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
