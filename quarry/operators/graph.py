"""Connected components by alternating large and small stars; nothing leaves the cluster but a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, written


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, comp): ``comp`` is the least node reachable over ``edges(i, j)`` between nodes; rounds go on until nothing changes."""
    labels = components(edges, "i", "j").withColumnRenamed("node", "n2")
    own = nodes.select(F.col(node).alias("node")).distinct()
    return own.join(labels, F.col("node") == F.col("n2"), "left").select("node", F.coalesce("label", "node").alias("comp"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node of an edge: ``label`` is the least node of its component.

    Each round points every node's larger neighbours at the least neighbour, then its smaller ones; rounds are logarithmic.
    Minima are pre-aggregated and a hub's edges are joined as a skewed join, so no node's neighbours are gathered in one place.
    Loops and repeated edges change nothing; an edge with a null end is ignored; no edges give an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    e = written(e, "components")
    seen = _sum(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        near = large.join(least, F.col("u") == F.col("w"))
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small, "components")
        dropped(e)
        e, now = new, _sum(new)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
