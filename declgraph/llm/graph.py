"""Connected components by alternating large and small stars; every round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declgraph.llm.common import cut, discard


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), longs with u > v -> (node, root): the smallest node that each node of any edge reaches, roots left out.

    Both steps only ever replace a node's neighbours by its smallest one, so edges never multiply. The minima are
    written before they are joined, which leaves plain exchanges on both sides: a hub's partition can be split.
    Empty edges give an empty result; repeated edges count once.
    """
    edges = cut(edges.select("u", "v").distinct(), "cc")
    was = _digest(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "cc")
        discard(edges, least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(large, least)
        now = _digest(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
