"""Connected components by alternating star contraction.

Each round points the larger neighbours of every node, and then the smaller ones, at the node's
least neighbour, until only stars are left. Rounds are written to the shared folder; only counts
reach the driver. The least neighbour comes from an aggregation with map-side partial results,
so a hub is never gathered; it is joined back, where a skewed hub can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

#: Up to so many edges, least neighbours are joined as they are; above, they are written first,
#: which lets Spark split the join at hubs.
SPLIT_EDGES = 5_000_000


def _least(sides: DataFrame, edges: int, held: list[Written]) -> DataFrame:
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if edges <= SPLIT_EDGES:
        return least
    held.append(Written(least))
    return held[-1].df


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Edges with a null end and loops join nothing; repeated edges count once. Nodes may be of any
    type that sorts.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = Written(pairs.distinct())
    state = None
    while True:
        count, mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == (count, mark) or not count:
            break
        state = (count, mark)
        held: list[Written] = []
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        own = _least(both, count, held).select("u", F.least("m", "u").alias("m"))
        large = both.join(own, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        first = Written(large)
        least = _least(first.df, count, held)
        small = first.df.join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        after = Written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for old in (now, first, *held):
            old.drop()
        now = after
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
