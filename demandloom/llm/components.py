"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.session import checkpoint as keep

ROUNDS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest neighbour of its first end.

    The sums are cut off by a checkpoint: both sides of the join are then plain exchanges, which
    Spark can split where one end has very many edges.
    """
    low = keep(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(low, "u")


def components(links: DataFrame, left: str, right: str, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for each node that has a link to another; root is the smallest node it reaches.

    Rounds of large and small stars halve the paths, so their number grows with the logarithm of
    the longest one. Null ends, loops and repeated links are ignored; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = keep(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = keep(large.distinct())
        small = _lowest(large)
        edges = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = keep(edges.distinct())
    raise RuntimeError(f"components are not settled after {rounds} rounds")
