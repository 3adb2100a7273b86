"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import settled


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `links`; the root is the smallest node that can be reached.

    Every round hangs the larger neighbours of a node on its smallest neighbour and then does the
    same for the smaller ones, which halves the depth of what is left, so rounds grow with the
    logarithm of a component's size.  No neighbour list is gathered: a round is a minimum for each
    node and a join with it, so a node with very many links is spread over many tasks.  Loops,
    repeated links and links with a null end are allowed and mean nothing more than the link.
    """
    edges = settled(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = (both.where("lo > hi").join(least, "hi")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        edges = settled(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(small.select("hi", F.col("m").alias("lo"))).where("hi != lo").distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo"), F.col("lo")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the links."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)
