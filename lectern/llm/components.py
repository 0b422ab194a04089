"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.skew import salted_lookup
from lectern.session import discard, written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, root) for every node of the undirected `edges`; root is the component's smallest node.

    Each step points edges at smaller nodes until all are stars; rounds grow with the logarithm of the
    nodes, not with the length of a chain. A hub's edges are spread by salted lookups. Loops and rows with
    a null end are ignored, repeated rows do no harm, no edges give no rows. Each round is a table in the shared folder,
    and the one before it is deleted.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = written(pairs, "edges")
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).withColumn("m", F.least("u", "m"))
        large = salted_lookup(both.where("v > u"), low, "u", "n", 2 * now[0], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "edges")
        low, before = _least(large), pairs
        small = salted_lookup(large, low, "u", "n", now[0], F.col("v")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before, large)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
