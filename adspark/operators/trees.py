"""Fitted forests as tables of nodes, and the outputs of all trees of a forest in one pass over the rows.

A forest is saved to the shared folder and read back as rows (tree, node, feature, threshold, left,
right, value). Rows of data meet the nodes as arrays within a task: a step moves every row down one
level in every tree at once, so a plan has one Python step for a run of trees, however many they are.
The nodes go by way of the driver, which is right for MLlib's models and small forests; the workflows
score the forests of ``forests`` where their trees are (``Grown.with_trees``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import shared_folder
from .forests import Grown

#: Nodes sent to the tasks at once (28 bytes each); a forest with more is scored in several runs of trees.
MOST_NODES = 4_000_000
#: Pairs of row and tree that a task walks at once.
STATES = 1 << 20


def node_table(spark: SparkSession, model, probability: bool = False) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value) of a fitted forest, MLlib's or one of ``forests``.

    Children are node numbers of the same tree; a leaf has feature -1. ``value`` is the node's
    prediction, or its share of class 1: zero where no row of class 1 was fitted. Features are
    numbers; a split by categories raises ``ValueError``.
    """
    if isinstance(model, Grown):
        return model.node_table(spark, probability)
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if n.where("split.numCategories >= 0").head(1):
        raise ValueError("the forest splits by categories; only splits by numbers are known")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v)
    share = F.try_divide(F.try_element_at("impurityStats", F.lit(2)), total)
    return n.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("split.featureIndex").alias("feature"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        (F.coalesce(share, F.lit(0.0)) if probability else F.col("prediction")).alias("value"),
    )


def runs_of_trees(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs (first, end) of trees with at most ``most`` nodes together; a larger tree is a run of its own."""
    runs, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            runs.append((first, i))
            first, held = i, 0
        held += n
    return [*runs, (first, len(sizes))] if sizes else []


@dataclass(frozen=True)
class Nodes:
    """Nodes of a run of trees, one after the other; a leaf's feature is -1 and children are positions."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, table: pd.DataFrame) -> Nodes:
        t = table.sort_values(["tree", "node"], ignore_index=True)
        roots = np.flatnonzero(np.r_[True, np.diff(t["tree"].to_numpy()) != 0])
        counts = np.diff(np.r_[roots, len(t)])
        start = np.repeat(roots, counts)
        if (t["node"].to_numpy() != np.arange(len(t)) - start).any():
            raise ValueError("nodes of a tree must be numbered from 0 without gaps")
        place = {c: (t[c].to_numpy() + start).astype(np.int32) for c in ("left", "right")}
        feature = t["feature"].to_numpy().astype(np.int32)
        return cls(roots, feature, t["threshold"].to_numpy(dtype=float), place["left"], place["right"], t["value"].to_numpy(dtype=float))

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row of ``x`` reaches in each tree."""
        trees = len(self.roots)
        at = np.tile(self.roots, len(x))
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            now = at[open_]
            goes_left = x[open_ // trees, self.feature[now]] <= self.threshold[now]
            at[open_] = np.where(goes_left, self.left[now], self.right[now])
            open_ = open_[self.feature[at[open_]] >= 0]
        return self.value[at].reshape(len(x), trees)


class Forest:
    """The trees of a fitted forest, ready to score columns of features."""

    def __init__(self, spark: SparkSession, model, probability: bool = False, most_nodes: int = MOST_NODES):
        table = node_table(spark, model, probability)
        sizes = [r["n"] for r in table.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()]
        self.width = model.numFeatures
        self.runs = []
        for first, end in runs_of_trees(sizes, most_nodes):
            nodes = Nodes.of(table.where(F.col("tree").between(first, end - 1)).toArrow().to_pandas())
            self.runs.append(spark.sparkContext.broadcast(nodes))

    def outputs(self, features: str) -> Column:
        """Output of every tree, in order, as a list; NULL where the list of features is.

        A NULL in the list goes right in every split, as a number above every threshold. Lists of
        another length than the fitted ones raise ``ValueError``.
        """
        return F.concat(*[_walk(nodes, self.width)(F.col(features).cast("array<double>")) for nodes in self.runs])


def _walk(shared, width: int):
    """Scalar function from features to the outputs of one run of trees."""

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nodes = shared.value
        step = max(1, STATES // len(nodes.roots))
        for rows in batches:
            given = rows.notna().to_numpy()
            lists = rows[given].to_list()
            if any(len(v) != width for v in lists):
                raise ValueError(f"the forest was fitted on {width} features")
            found = np.empty(len(rows), dtype=object)
            places = np.flatnonzero(given)
            for s in range(0, len(lists), step):
                x = np.array([np.asarray(v, dtype=float) for v in lists[s : s + step]])
                for i, values in zip(places[s : s + step], nodes.outputs(x)):
                    found[i] = values
            yield pd.Series(found, index=rows.index)

    return F.pandas_udf(walk, "array<double>")
