"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import discard, materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge, ``root`` the smallest node that it reaches.

    Each round links a node's larger neighbours to its smallest one (large star), then its smaller
    ones (small star); a round is two aggregations and two equi-joins, whatever a node's degree, and
    the number of rounds is logarithmic in the longest path.  Self edges, repeated edges and nulls
    (which link nothing) are dropped first.  An empty edge table gives an empty result.
    """
    current = materialise(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), (F.col(left) != F.col(right)).alias("keep"))
        .where("keep")
        .select("u", "v")
        .distinct()
    )
    seen = None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        following = materialise(small)
        state = following.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_if(F.lit(True)).alias("c")
        ).first()
        discard(current)
        current = following
        if seen == (state["n"], state["s"]):
            break
        seen = (state["n"], state["s"])
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
