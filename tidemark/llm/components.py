"""Connected components of an edge table: smallest reachable id, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, owner: str, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour. A neighbourhood is a minimum and a join on it, never a collected list.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), owner)
    for _ in range(most_rounds):
        n = both(e)
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = n.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), owner)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.filter("a <> b").distinct(), owner)
        # Stars: no root is itself below another, and each node has one root.
        roots = new.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        open_ = roots.filter("lo <> hi").limit(1).count() or new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        e = new
        if not open_:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")
