"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node with an edge; edges: u, v integers.

    Minima are pre-aggregated and met again by joins, so a node with many edges is no single task's;
    rounds are written to the shared folder, the last one stays there, and their number follows the logarithm of the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(edges), None
    state = _state(now)
    while state != before:
        before = state
        last, now = now, stored(_small(_large(now)).where("u <> v").distinct())
        release(last)
        state = _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root of the components that roots (of components()) and further edges make together.

    Edges are taken between roots and closed on their own, so rounds carry the further edges alone;
    then each node follows its root.
    """
    for end in ("u", "v"):
        to = roots.select(F.col("node").alias(end), "root")
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    moved = components(edges)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(old.unionByName(moved.join(roots, "node", "left_anti")))
