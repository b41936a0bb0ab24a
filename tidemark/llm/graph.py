"""Connected components of a link table, by alternating star contraction.

Each round hooks every neighbour of a node that is larger than it onto the
smallest neighbour (large star), then the smaller neighbours onto that minimum
(small star). Both are one grouped minimum and one equi-join; hub nodes are
pre-aggregated before the shuffle, and no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import settle


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return (node, component): the smallest node reachable, for every node with
    a link. Self-links and nulls are ignored; repeated links change nothing; an
    empty table gives an empty result."""
    edges = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
    edges = settle(edges.where("u <> v and u is not null and v is not null").distinct(), "links")
    now = _digest(edges)
    for _ in range(max_rounds if now[0] else 0):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself onto the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = settle(small.where("u <> v").distinct(), "links", replaces=edges)
        was, now = now, _digest(after)
        edges = after
        if was == now:
            break
    else:
        if now[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Row count and commutative hash of distinct edges."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())
