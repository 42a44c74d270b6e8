"""Connected components of a graph of pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindmill.session import durable


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) -> node, root: every node of a pair with the smallest node of its component, roots included.

    Every round hangs a node's larger neighbours, then its smaller ones, on the smallest neighbour, so paths shrink to
    stars in a number of rounds that grows with the logarithm of the graph. Minima are partial aggregates, and rounds
    are stored tables. Null nodes are left out.
    """
    edges = durable(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"`{a}` is not null and `{b}` is not null and u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("at")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.distinct())
        low = _lowest(large).withColumnRenamed("u", "at")
        small = large.join(low, F.col("u") == F.col("at")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(low.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
