"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, materialize

MAX_ROUNDS = 100


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
    return tuple(row)


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` of all nodes with an edge; ``root`` is the smallest node that is reachable.

    ``edges`` has two columns of one orderable type. Neighbours are reduced to their minimum before
    each shuffle, and stars are rewired edge by edge, so no group of neighbours is ever collected; the edges of
    a hub are not dealt by it.
    Loops, repeated edges and an empty table are allowed; a node whose only edge is a loop gets no row.
    """
    a, b = edges.columns
    stars = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    stars = materialize(stars, "edges")
    before = _signature(stars)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(_nearest(both).withColumn("m", F.least("u", "m")), "least")
        large = join_counted(both.where("v > u"), least, "u", "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = materialize(_nearest(large), "least")
        small = join_counted(large, least, "u", "n", before[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        after = _signature(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
