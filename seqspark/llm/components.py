"""Connected components of an edge table by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import dropped, written


def _min_neighbour(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = _min_neighbour(both).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    low = _min_neighbour(down)
    near = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return near.union(low.toDF("u", "v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge to another; ``component`` is its smallest node.

    ``edges`` has two columns of one type. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the nodes.
    """
    now = written(edges.toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), name)
    signature = None
    while True:
        following = written(_small_star(_large_star(now)), name)
        row = following.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
        dropped(now)
        now = following
        if (row["n"], row["x"]) == signature:
            break
        signature = (row["n"], row["x"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
