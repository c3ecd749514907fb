"""Connected components of links by alternating stars: each round is two aggregations and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root``: every node of ``links`` (columns ``a, b``) with the least node it can reach.

    Nodes are of any ordered type. Links may repeat, run either way or lead to
    themselves; null ends link nothing. Hubs are reduced before the shuffle.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, at, before = scratch.keep("stars-0", edges), 0, None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            ).distinct()
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = small.union(low.select("u", "m")).distinct()
        at += 1
        edges, before = scratch.keep(f"stars-{at}", following), now
        scratch.drop(f"stars-{at - 1}")
