"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moatlens.llm.common import written

#: Rounds before giving up; each at least halves the distance to the smallest node.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected edges (a, b); comp is the smallest node reachable.

    Rounds of large-star and small-star: every node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones, until all trees
    are stars. The edge table never grows, a hub's edges are only grouped by a
    partial minimum, and every round is written to the shared folder.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # a > b in every edge
        hang = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(low.select("a", F.col("m").alias("b")).unionByName(hang).distinct(), "cc-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
