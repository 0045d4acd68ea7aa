"""Overlaps between data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pairwise_overlap(df: DataFrame, dataset: str, key: str, fraction: bool = False) -> DataFrame:
    """(a, b, overlap) for every ordered pair of data sets that share a key, a = b included.

    Keys are first reduced to their (small) set of data sets, and equal sets are counted, so
    pairs are only formed between data sets, never between rows.
    """
    members = df.select(dataset, key).distinct().groupBy(key).agg(F.sort_array(F.collect_set(dataset)).alias("_sets"))
    signatures = members.groupBy("_sets").agg(F.count(F.lit(1)).alias("_c"))
    pairs = signatures.select("_sets", "_c", F.explode("_sets").alias("a")).select(
        "a", F.explode("_sets").alias("b"), "_c"
    )
    counts = pairs.groupBy("a", "b").agg(F.sum("_c").alias("overlap"))
    if not fraction:
        return counts
    sizes = counts.where("a = b").select("a", F.col("overlap").alias("_size"))
    return counts.join(sizes, "a").select("a", "b", (F.col("overlap") / F.col("_size")).alias("overlap"))


def overlap_matrix(overlaps: DataFrame, datasets: list[str]) -> DataFrame:
    """One row per data set, one column per data set; 0 where nothing is shared."""
    return overlaps.groupBy("a").pivot("b", datasets).agg(F.first("overlap")).na.fill(0)
