"""Connected components by contraction, on DataFrames and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of the edges (u, v): comp is the least node reachable.

    Each round points every node at the least of itself and its neighbours, follows pointers once, and renames
    the edges by it; edges inside a component go. The rounds grow with the logarithm of the longest path."""
    edges = common.stored(edges.where("u <> v").distinct(), "edges")
    names = common.stored(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node")), "names")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.least("u", "m").alias("b")), "pointers")
        jump = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        old = [up, edges, names]
        up = common.stored(jump, "jumped")
        names = common.stored(names.join(up.select(F.col("a").alias("comp"), "b"), "comp", "left").select("node", F.coalesce("b", "comp").alias("comp")), "names")
        left = edges.join(up.select(F.col("a").alias("u"), F.col("b").alias("x")), "u").join(up.select(F.col("a").alias("v"), F.col("b").alias("y")), "v")
        old.append(up)
        edges = common.stored(left.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        common.discard(*old)
    least = names.groupBy("comp").agg(F.min("node").alias("least"))
    return names.join(least, "comp").select("node", F.col("least").alias("comp"))
