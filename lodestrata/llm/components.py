"""Connected components of an edge table, without leaving the cluster.

Alternating large-star and small-star steps on links kept as (higher, lower); each round is written
to the shared folder. Rounds grow with the logarithm of the longest chain. Heavy nodes are aggregated before the
shuffle and joined back, so that a hub is split by the engine's skew handling and meets no single task as a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node of its component.

    Nodes are of any ordered type; self-links, repeated and null ends are ignored.
    """
    pairs = links.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _signature(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        now = materialize(_stars(edges))
        after = _signature(now)
        discard(edges)
        edges = now
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
