"""Connected components by alternating star contractions, on edge tables that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import stage


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label for every node of the edges (a, b: long): label is the smallest node of its component.

    Each round sends a node's larger neighbours to its smallest one and then its smaller ones; both are a minimum by key
    (combined before the shuffle) and a join, so a node with very many neighbours is split like any skewed key. Rounds grow
    with the logarithm of the nodes; if ``rounds`` are not enough that is an error, never an unfinished answer.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _checksum(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select("b", "a"))
        # written first, so that the join below has two plain exchanges and a hub can be split
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stage(small.where("a != b").distinct(), "edges")
        new = _checksum(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components are still changing after {rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
