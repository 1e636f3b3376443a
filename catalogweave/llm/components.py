"""Connected components of a large edge table by alternating star contraction.

Each round links every vertex to the smallest vertex it knows, first outwards (large star),
then inwards (small star), until every component is a star around its smallest vertex. A
round is two aggregations with map-side minima and two joins on shuffled keys, which
adaptive execution splits where a hub is hot. Every round is staged in the shared folder;
only one count and one checksum reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _toward(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    return edges.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = stage(both.groupBy("u").agg(F.min("v").alias("m")), "star")
    linked = _toward(both, smallest).where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    inner = _toward(edges, smallest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(smallest.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component): every vertex of an edge and the smallest vertex of its component.

    Edges may repeat and point either way; loops and nulls are ignored.
    """
    a, b = F.col(first), F.col(second)
    current = stage(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    state = _state(current)
    while state[0]:
        outward = stage(_large_star(current).where("u <> v").distinct(), "outward")
        current = stage(_small_star(outward).where("u <> v").distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
