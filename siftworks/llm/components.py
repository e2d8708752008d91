"""Connected components of a graph of ids by alternating large-star and small-star steps.

Each step is a group-by and a join of edges; edges stay in the shared folder between steps, so a lost executor costs no
more than the step. The number of steps grows with the logarithm of a component's size. (Kiveris et al., 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialize


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges (a, b): ids of any type that can be ordered, any order, repeats and loops allowed. Returns (id, component): each id
    that has an edge to another, with the smallest id that it can reach. An empty edge frame gives no rows. Where an id has
    a large share of all edges, as the hub of a star has, they do not meet in one task."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "cc")
    n, before = pairs.count(), None
    for _ in range(most_rounds):
        # Large star: each node links its larger neighbours to its smallest neighbour (or itself).
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_by_key(both.where("v > u"), low, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them. A hub with the largest id has many.
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_key(large, least, "u", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, pairs = pairs, materialize(small.where("u <> v").distinct(), "cc")
        discard(last, large)
        # Done when no node is linked both ways: every edge then ends at its component's smallest id.
        n, state = pairs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if (n, state) == before:
            break
        before = (n, state)
    else:
        raise RuntimeError("components: no fixed point was reached")
    return pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
