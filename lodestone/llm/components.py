"""Connected components of a link table, without any graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop, save


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    Alternates two star steps: each node's larger neighbours, then its smaller ones, are linked to the
    smallest node that it knows. The number of edges doesn't grow, and the number of rounds grows with
    the logarithm of the longest path: one where the edges are stars already. Each round is a table in the shared folder. Minimums are
    aggregated before the shuffle, and the joins back are ones that adaptive execution can split, as
    the centre of a star may have a third of all nodes.
    """
    pairs = edges.where((F.col(a) != F.col(b)))
    now = save(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = save(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = _state(after)
        drop(large)
        drop(now)
        now = after
        if state == seen:
            break
        state = seen
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
