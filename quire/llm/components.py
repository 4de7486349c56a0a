"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("coalesce(sum(cast(a % 1000003 as decimal(38,0))), 0)")).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component) for every node of an edge; component is the smallest node reachable.

    Nulls and loops are ignored; no edges give no rows. Minima are pre-aggregated before each
    shuffle and only narrow rows meet at a hub, which the skew join splits.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
