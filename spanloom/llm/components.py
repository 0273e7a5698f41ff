"""Connected components of links by alternating large and small stars, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import last_table, materialise, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), the component being its smallest node.

    Each round hangs greater neighbours on the smallest one by aggregates and joins, so that no node's
    neighbours meet in one row; rounds grow with the logarithm of the longest chain. Each round's edges are
    written to the shared folder. Loops and edges with a null are left out.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "edges"), None
    here = last_table()
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(now.sparkSession, here)
        here = last_table()
