"""Connected components of a graph that does not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of (a, b) can reach, as (node, component).

    Every round links each node's larger neighbours, then its smaller ones, to the least of them
    (large-star, small-star), until nothing changes: about log(n) rounds. A node with very many
    neighbours is handled by aggregates and by joins that the adaptive planner splits; no list of
    neighbours is ever built. Every round's edges are written, so a lost executor costs one round.
    Edges with a NULL end and loops are ignored; nodes without an edge are not in the result.
    """
    current = written(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # (a, b) with b < a; large star: larger neighbours of every node go to its least neighbour
        least = _both_ways(current).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = current.select(F.col("b").alias("a"), F.col("a").alias("far"))
        large = up.join(least, "a").select(F.col("far").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = written(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # a star forest does not change any more: every node has one smaller neighbour, a root
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, current = mark, after
