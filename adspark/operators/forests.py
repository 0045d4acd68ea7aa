"""Forests on all rows of a fit, several trees to a task, and their outputs without a forest in one place.

MLlib grows all trees together, a job a level, and keeps a histogram of every feature for every open
node: right for large nodes, but trees without a depth limit have about as many nodes as rows, and
their histograms outweigh the rows a thousand times. Here the rows of a fit are put into bins, a byte
a feature, and sent once to each of a few tasks; a task grows its share of the trees one after the
other. The rules are MLlib's: 32 bins a feature, Poisson weights with mean one for every row and tree,
a new random choice of features at every node, variance or Gini impurity, nodes split as long as that
gains anything.

Forests on parts of the same rows (splits, folds, seeds) are fitted together: a row says in ``_fits``
which of them take it, and all trees of all forests are the tasks of the same few jobs.

Trees stay in the shared folder as arrays, about 13 bytes a node, and never meet on the driver. Rows to
score are put into the same bins and sent to the tasks that hold a share of the trees; what these return
is put together block by block. MLlib's own model is only written when one is asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.shared import materialise, shared_folder

BINS = 32
#: Entries of the histograms that a task holds at once, one for each node, feature and bin.
CELLS = 1 << 18
#: Pairs of row and feature that a task puts into histograms at once.
ENTRIES = 1 << 18
#: Nodes of so few rows are split by trying each row as the border, so many nodes at once.
FEW_ROWS, SMALL_NODES = 4, 8_192
#: Rows of a block, which are scored and put together at once, and blocks that meet a share of the trees in one task.
BLOCK_ROWS, BLOCKS = 4_096, 128

_VALUES = "feature int, values binary, fits binary"
_PACKED = "fit int, keys binary, y binary, codes binary"
_TREES = "fit int, task int, tree int, feature binary, cut binary, child binary, value binary"
_BLOCKS = "fit int, block long, codes binary, payload binary"
_OUTPUTS = "block long, task int, outputs binary"
_NODES = "fit int, tree int, node int, w double, w1 double, w0 double, sq double, n long, gain double, left int, right int, feature int, threshold double"


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins`` - 1 thresholds: between all distinct values if they are few, else at equal shares of the rows."""
    values = np.sort(values[np.isfinite(values)])
    distinct = np.unique(values)
    if len(distinct) > bins:
        at = np.arange(1, bins) * len(values) // bins
        below, above = values[at - 1], values[at]
    else:
        below, above = distinct[:-1], distinct[1:]
    return np.unique(below + (above - below) / 2)


def _chosen(nodes: int, features: int, wanted: int, rng) -> np.ndarray:
    """``wanted`` random features of every node."""
    return np.argpartition(rng.random((nodes, features)), wanted - 1, axis=1)[:, :wanted]


def _small_splits(codes, y, w, first, size: int, wanted: int, rng):
    """(feature, last bin of the left side, gain) of nodes of ``size`` rows, which begin at ``first``: every row is tried as the border."""
    line, chosen = np.arange(len(first)), _chosen(len(first), codes.shape[1], wanted, rng)
    rows = first[:, None] + np.arange(size)
    c, weight, total = codes[rows[:, :, None], chosen[:, None, :]], w[rows][:, :, None], (w * y)[rows][:, :, None]
    best, feature, cut = np.full(len(first), -np.inf), np.zeros(len(first), int), np.zeros(len(first), int)
    for j in range(size):
        left = c <= c[:, j : j + 1]
        right = ~left
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (left * total).sum(axis=1) ** 2 / (left * weight).sum(axis=1) + (right * total).sum(axis=1) ** 2 / (right * weight).sum(axis=1)
        score = np.where(right.any(axis=1), score, -np.inf)
        at = score.argmax(axis=1)
        better = score[line, at] > best
        best, feature, cut = np.where(better, score[line, at], best), np.where(better, chosen[line, at], feature), np.where(better, c[line, j, at], cut)
    won = best - total.sum(axis=(1, 2)) ** 2 / weight.sum(axis=(1, 2))
    return np.where(won > 0, feature, -1), cut, np.where(won > 0, won, 0.0)


def best_splits(codes, y, w, at, nodes: int, wanted: int, bins: int, rng):
    """(feature, last bin of the left side, gain) of every node; feature -1 where no split gains.

    ``at`` holds the rows' nodes in ascending order. Of every node ``wanted`` random features are looked at.
    """
    feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
    sizes = np.bincount(at, minlength=nodes)
    starts = np.cumsum(sizes) - sizes
    for size in range(2, FEW_ROWS + 1):
        few = np.flatnonzero(sizes == size)
        for part in np.split(few, range(SMALL_NODES, len(few), SMALL_NODES)) if len(few) else ():
            feature[part], cut[part], gain[part] = _small_splits(codes, y, w, starts[part], size, wanted, rng)
    large = np.flatnonzero(sizes > FEW_ROWS)
    if not len(large):
        return feature, cut, gain
    rows = np.flatnonzero(sizes[at] > FEW_ROWS)
    at, wy = np.repeat(np.arange(len(large)), sizes[large]), (w * y)[rows]
    w, ends = w[rows], np.r_[0, np.cumsum(sizes[large])]
    whole = not np.any(w % 1)  # sums of whole numbers are exact, so no weight is left where no row is
    step = max(1, CELLS // (wanted * bins))
    for low in range(0, len(large), step):
        high = min(len(large), low + step)
        a, b = ends[low], ends[high]
        own, shape = at[a:b] - low, (high - low, wanted, bins)
        chosen = _chosen(high - low, codes.shape[1], wanted, rng)
        weight, total, count = np.empty(shape), np.empty(shape), None if whole else np.empty(shape)
        some = max(1, ENTRIES // (b - a))
        for f in range(0, wanted, some):
            columns = chosen[:, f : f + some]
            n = columns.shape[1]
            cell = codes[rows[a:b, None], columns[own]] + (own[:, None] * n + np.arange(n)) * bins
            sums = lambda v: np.bincount(cell.ravel(), v, (high - low) * n * bins).reshape(high - low, n, bins).cumsum(axis=2)  # noqa: E731, B023
            weight[:, f : f + n], total[:, f : f + n] = sums(np.repeat(w[a:b], n)), sums(np.repeat(wy[a:b], n))
            if not whole:
                count[:, f : f + n] = sums(None)
        left_w, left = weight[..., :-1], total[..., :-1]
        right_w, right = weight[..., -1:] - left_w, total[..., -1:] - left
        both = (left_w > 0) & (right_w > 0) if whole else (count[..., :-1] > 0) & (count[..., :-1] < count[..., -1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            score = left**2 / left_w + right**2 / right_w
        score = np.where(both, score, -np.inf).reshape(high - low, -1)
        best = score.argmax(axis=1)
        line = np.arange(high - low)
        won = score[line, best] - total[:, 0, -1] ** 2 / weight[:, 0, -1]
        nodes_ = large[low:high]
        feature[nodes_] = np.where(won > 0, chosen[line, best // (bins - 1)], -1)
        cut[nodes_], gain[nodes_] = best % (bins - 1), np.where(won > 0, won, 0.0)
    return feature, cut, gain


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, wanted: int, depth: int, bins: int, rng) -> pd.DataFrame:
    """Nodes of one tree, level by level; children come after their parents."""
    levels, first, at, level = [], 0, np.zeros(len(y), int), 0
    centre = np.average(y, weights=w)  # squares lose nothing if values lie around zero
    while len(y):
        nodes = at[-1] + 1
        total = lambda v: np.bincount(at, v, nodes)  # noqa: E731, B023
        starts = np.searchsorted(at, np.arange(nodes))
        mixed = np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)
        feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        if level < depth and mixed.any():
            rows, number = mixed[at], np.cumsum(mixed) - 1
            feature[mixed], cut[mixed], gain[mixed] = best_splits(
                codes[rows], y[rows] - centre, w[rows], number[at[rows]], int(mixed.sum()), wanted, bins, rng
            )
        split = feature >= 0
        left = first + nodes + 2 * (np.cumsum(split) - 1)
        levels.append(
            {
                "node": first + np.arange(nodes), "w": total(w), "w1": total(w * y), "w0": total(w * (1 - y)), "sq": total(w * y * y),
                "n": total(None), "gain": gain, "left": np.where(split, left, -1), "right": np.where(split, left + 1, -1), "feature": feature, "cut": cut,
            }
        )
        kept = np.flatnonzero(split[at])
        own = at[kept]
        child = left[own] - first - nodes + (codes[kept, feature[own]] > cut[own])
        order = np.argsort(child, kind="stable")
        kept, at = kept[order], child[order]
        codes, y, w = codes[kept], y[kept], w[kept]
        first, level = first + nodes, level + 1
    return pd.DataFrame({c: np.concatenate([part[c] for part in levels]) for c in levels[0]})


def _checked(b: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, y) of a batch of rows to fit."""
    lists = b["features"].to_list()
    if any(v is None or len(v) != width for v in lists):
        raise ValueError(f"a row to fit has not {width} features")
    x, y = np.array([np.asarray(v, dtype=float) for v in lists]).reshape(-1, width), b["y"].to_numpy(dtype=float)
    if np.isnan(y).any() or np.isnan(x).any():
        raise ValueError("a row to fit has a missing label or feature")
    return x, y


def _taken(lists, fits: int) -> np.ndarray:
    """Matrix of rows and forests: whether the forest takes the row."""
    sizes = np.array([0 if v is None else len(v) for v in lists], int)
    taken = np.zeros((len(sizes), fits), bool)
    taken[np.repeat(np.arange(len(sizes)), sizes), [f for v in lists if v is not None for f in v]] = True
    return taken


def _edges(rows: DataFrame, width: int, fits: int) -> list[list[np.ndarray]]:
    """Edges of the bins of every feature in every fit; a task has all values of a feature, once for all fits."""

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, _ = _checked(b, width)
            taken = np.packbits(_taken(b["_fits"], fits), axis=1).tobytes()
            yield pd.DataFrame({"feature": np.arange(width), "values": [x[:, f].tobytes() for f in range(width)], "fits": [taken] * width})

    def edges_of(key, part):
        values = np.frombuffer(b"".join(part["values"]), float)
        order = np.argsort(values)
        taken = np.frombuffer(b"".join(part["fits"]), np.uint8).reshape(len(values), -1)[order]
        values = values[order]
        # the place of a fit's bit as packbits puts it
        own = [bin_edges(values[taken[:, f // 8] >> (7 - f % 8) & 1 > 0]) for f in range(fits)]
        return pd.DataFrame({"feature": key[0], "fit": np.arange(fits), "edges": own})

    found = rows.mapInPandas(columns, _VALUES).groupBy("feature").applyInPandas(edges_of, "feature int, fit int, edges array<double>").collect()
    edges = {(r[1], r[0]): np.array(r[2]) for r in found}
    return [[edges[fit, f] for f in range(width)] for fit in range(fits)]


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _packed(rows: DataFrame, edges: list[list[np.ndarray]]) -> DataFrame:
    """The rows of a batch as one row of arrays for each fit, features as numbers of bins."""
    width = len(edges[0])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            (x, y), keys, taken = _checked(b, width), b["key"].to_numpy(dtype=np.int64), _taken(b["_fits"], len(edges))
            for fit in np.flatnonzero(taken.any(axis=0)):
                own = taken[:, fit]
                arrays = {"keys": keys[own], "y": y[own], "codes": _codes(x[own], edges[fit])}
                yield pd.DataFrame({"fit": [fit]} | {k: [v.tobytes()] for k, v in arrays.items()})

    return rows.mapInPandas(pack, _PACKED)


def _grower(edges: list[list[np.ndarray]], trees: int, tasks: int, wanted: int, depth: int, seeds: list[int], weights: list, write: Callable):
    """Function from the rows of some tasks to what ``write`` makes of (fit, task, tree, nodes), a tree at a time."""
    width = len(edges[0])

    def grow_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = defaultdict(lambda: defaultdict(list))
        for b in batches:
            for c in ("keys", "y", "codes"):
                for fit, task, piece in zip(b["fit"], b["task"], b[c]):
                    parts[int(fit), int(task)][c].append(piece)
        for fit, task in sorted(parts):
            own, bins = parts.pop((fit, task)), max(2, max(len(e) for e in edges[fit]) + 1)
            keys, y = np.frombuffer(b"".join(own.pop("keys")), np.int64), np.frombuffer(b"".join(own.pop("y")), float)
            order = np.argsort(keys, kind="stable")
            y = y[order]
            codes = np.frombuffer(b"".join(own.pop("codes")), np.uint8).reshape(-1, width)[order]
            w = np.ones(len(y)) if weights[fit] is None else np.array(weights[fit])[y.astype(int)]
            for tree in range(task, trees, tasks):
                rng = np.random.default_rng([seeds[fit], tree])
                times = rng.poisson(1.0, len(order))
                while not times.any():
                    times = rng.poisson(1.0, len(order))
                bag = np.flatnonzero(times)
                yield write(fit, task, tree, grow(codes[bag], y[bag], w[bag] * times[bag], wanted, depth, bins, rng))

    return grow_all


def _as_arrays(fit: int, task: int, tree: int, nodes: pd.DataFrame) -> pd.DataFrame:
    """A tree as one row: feature and last bin of the left side of every node, its left child (the right one follows), values of the leaves."""
    leaf = nodes["feature"] < 0
    arrays = {
        "feature": nodes["feature"].to_numpy(np.int32), "cut": nodes["cut"].to_numpy(np.uint8), "child": nodes["left"].to_numpy(np.int32),
        "value": (nodes["w1"][leaf] / nodes["w"][leaf]).to_numpy(float),
    }
    return pd.DataFrame({"fit": [fit], "task": [task], "tree": [tree]} | {k: [v.tobytes()] for k, v in arrays.items()})


def _from_arrays(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, left child, value) of the nodes of a stored tree; the value of an inner node is 0."""
    feature, child = np.frombuffer(tree["feature"], np.int32), np.frombuffer(tree["child"], np.int32)
    value = np.zeros(len(feature))
    value[feature < 0] = np.frombuffer(tree["value"], float)
    return feature, np.frombuffer(tree["cut"], np.uint8), child, value


def walk(tree, codes: np.ndarray) -> np.ndarray:
    """Value of the leaf that each row of ``codes`` reaches in a stored tree."""
    feature, cut, child, value = _from_arrays(tree)
    at = np.zeros(len(codes), np.int32)
    open_ = np.flatnonzero(feature[at] >= 0)
    while len(open_):
        now = at[open_]
        now = child[now] + (codes[open_, feature[now]] > cut[now])
        at[open_] = now
        open_ = open_[feature[now] >= 0]
    return value[at]


def _blocks(rows: DataFrame, features: str, keep: list[str], edges: list[list[np.ndarray]], fits: str | None) -> DataFrame:
    """Blocks of rows for a forest: numbers of bins of those with features, and the columns to keep as an Arrow stream."""
    width = len(edges[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            given = np.array(pc.is_valid(batch.column("_x")), dtype=bool)
            lists = batch.column("_x").drop_null()
            if pc.any(pc.not_equal(pc.list_value_length(lists), width)).as_py():
                raise ValueError(f"the forest was fitted on {width} features")
            # missing values are NaN, which lies behind all edges
            x = np.empty((batch.num_rows, width))
            x[given] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            taken = np.ones((batch.num_rows, 1), bool) if fits is None else _taken(batch.column(fits).to_pylist(), len(edges))
            for fit in np.flatnonzero(taken.any(axis=0)):
                places = np.flatnonzero(taken[:, fit])
                for start in range(0, len(places), BLOCK_ROWS):
                    own = places[start : start + BLOCK_ROWS]
                    columns = batch.select(keep).take(pa.array(own)).append_column("_given", pa.array(given[own]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, columns.schema) as stream:
                        stream.write_batch(columns)
                    codes = _codes(x[own[given[own]]], edges[fit]).tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {"fit": pa.array([fit], pa.int32()), "block": pa.array([block], pa.int64()), "codes": [codes], "payload": [sink.getvalue().to_pybytes()]}
                    )
                    block += 1

    return rows.withColumn("_x", F.col(features).cast("array<double>")).mapInArrow(pack, _BLOCKS)


class Grown:
    """Fitted forests: trees as arrays in the shared folder, and MLlib's model of them when one is asked for.

    ``edges`` are those of every fit. ``several`` fits were made of rows that say in ``_fits`` which take them;
    rows to score then say the same, and come back once for each fit, which is named in ``_fit``.
    """

    def __init__(self, path: str, estimator, edges: list[list[np.ndarray]], tasks: int, several: bool, nodes: Callable[[], DataFrame]):
        self.path, self.estimator, self.edges, self.tasks, self.several, self._nodes = path, estimator, edges, tasks, several, nodes
        self.numFeatures, self.classes = len(edges[0]), estimator.hasParam("rawPredictionCol")
        self.number = estimator.getOrDefault("numTrees")

    def _one(self) -> None:
        if self.several:
            raise ValueError("this holds several forests")

    def node_table(self, spark, probability: bool = False) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value), see ``trees.node_table``."""
        self._one()
        edges = self.edges[0]
        share = probability or not self.classes

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for tree in b.to_dict("records"):
                    feature, cut, child, value = _from_arrays(tree)
                    inner, threshold = np.flatnonzero(feature >= 0), np.full(len(feature), np.nan)
                    threshold[inner] = [edges[f][c] for f, c in zip(feature[inner], cut[inner])]
                    right = np.where(feature >= 0, child + 1, -1)
                    value = value if share else (value > 0.5).astype(float)
                    yield pd.DataFrame(
                        {"tree": tree["tree"], "node": np.arange(len(feature)), "feature": feature, "threshold": threshold, "left": child, "right": right, "value": value}
                    )

        return spark.read.schema(_TREES).parquet(self.path).mapInPandas(unpack, "tree int, node int, feature int, threshold double, left int, right int, value double")

    def _scored(self, rows: DataFrame, features: str, probability: bool, mean: bool, name: str, keep: list[str] | None = None) -> DataFrame:
        """Rows with the output of every tree as the list ``name``, or with the mean of all outputs.

        Rows go to the trees, a byte a feature for each task, and values come back. The columns to ``keep``,
        all without a choice, wait beside them in the block's payload.
        """
        trees, tasks, width, fits = self.number, self.tasks, self.numFeatures, len(self.edges)
        share = probability or not self.classes
        spark = rows.sparkSession
        by = "_fits" if self.several else None
        fields = [f for f in rows.schema.fields if f.name != by and (keep is None or f.name in keep)]
        blocks = materialise(_blocks(rows, features, [f.name for f in fields], self.edges, by), "blocks")
        turns = blocks.groupBy("fit").agg(F.ceil(F.count(F.lit(1)) / BLOCKS).alias("n")).agg(F.max("n")).first()[0] or 1
        # a slot is a fit's share of the trees and a turn of its blocks
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sent = blocks.select("fit", "block", "codes", F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int").alias("turn"), each(tasks).alias("task"))
        grown = spark.read.schema(_TREES).parquet(self.path).withColumn("turn", each(turns))
        slot = (F.col("fit") * tasks + F.col("task")) * turns + F.col("turn")
        met = grown.unionByName(sent, allowMissingColumns=True).repartitionById(fits * tasks * turns, slot.cast("int"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slots = defaultdict(lambda: ([], []))
            for b in batches:
                for r in b.to_dict("records"):
                    slots[r["fit"], r["task"], r["turn"]][0 if r["feature"] is not None else 1].append(r)
            for at in sorted(slots):
                own, given = slots.pop(at)
                own.sort(key=lambda t: t["tree"])
                for r in given:
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, width)
                    out = np.stack([walk(t, codes) for t in own], axis=1)
                    out = out if share else (out > 0.5).astype(float)
                    yield pd.DataFrame({"block": [int(r["block"])], "task": [at[1]], "outputs": [(out.sum(axis=1) if mean else out).tobytes()]})

        kind = T.DoubleType() if mean else T.ArrayType(T.DoubleType())
        schema = T.StructType([*fields, *([T.StructField("_fit", T.IntegerType())] if by else []), T.StructField("_given", T.BooleanType()), T.StructField(name, kind)])

        def put_together(table: pa.Table) -> pa.Table:
            columns = {c: table.column(c).to_pylist() for c in ("fit", "task", "outputs", "payload")}
            payload = next(i for i, p in enumerate(columns["payload"]) if p is not None)
            whole = pa.ipc.open_stream(columns["payload"][payload]).read_all()
            given = whole.column("_given").to_numpy()
            if by:
                at = whole.column_names.index("_given")
                whole = whole.add_column(at, "_fit", pa.array(np.full(len(given), columns["fit"][payload], np.int32)))
            found = {task: np.frombuffer(o, float) for task, o in zip(columns["task"], columns["outputs"]) if o is not None}
            if len(found) != tasks:
                raise RuntimeError(f"outputs of {tasks} shares of the trees expected, {len(found)} found")
            if mean:
                values = np.zeros(len(given))
                values[given] = sum(found[t] for t in range(tasks)) / trees
                return whole.append_column(name, pa.array(values, mask=~given))
            values = np.empty((int(given.sum()), trees))
            for task, o in found.items():
                values[:, task::tasks] = o.reshape(len(values), len(range(task, trees, tasks)))
            offsets = np.r_[0, np.cumsum(np.where(given, trees, 0))].astype(np.int32)
            return whole.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(~given)))

        outputs = met.mapInPandas(score, _OUTPUTS)
        waiting = blocks.select("block", "fit", "payload")
        return outputs.unionByName(waiting, allowMissingColumns=True).groupBy("block").applyInArrow(put_together, schema).drop("_given")

    def with_trees(self, rows: DataFrame, features: str, name: str, probability: bool = False, keep: list[str] | None = None) -> DataFrame:
        """Rows with the output of every tree, in order: its prediction, or its share of class 1.

        NULL where the list of features is; a NULL in the list goes right in every split. Lists of another
        length than the fitted ones raise ``ValueError``. Of the rows' columns, those to ``keep``, or all.
        """
        return self._scored(rows, features, probability, False, name, keep)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with the columns that MLlib's model adds: the mean of the trees, or of their shares of the classes."""
        get = self.estimator.getOrDefault
        vector = get("featuresCol")
        lists = rows.withColumn(vector, vector_to_array(vector))
        out = self._scored(lists, vector, True, True, "_mean").withColumn(vector, array_to_vector(vector))
        one, number, columns = F.col("_mean"), F.lit(float(self.number)), [c for c in out.columns if c != "_mean"]
        if not self.classes:
            return out.select(*columns, one.alias(get("predictionCol")))
        return out.select(
            *columns,
            array_to_vector(F.array(number * (1 - one), number * one)).alias(get("rawPredictionCol")),
            array_to_vector(F.array(1 - one, one)).alias(get("probabilityCol")),
            (one > 0.5).cast("double").alias(get("predictionCol")),
        )

    @cached_property
    def model(self):
        kind, loader = ("classification.{}Classification", RandomForestClassificationModel) if self.classes else ("regression.{}Regression", RandomForestRegressionModel)
        named = lambda params: {p.name: v for p, v in params.items() if v is not None}
        tree = (DecisionTreeClassifier if self.classes else DecisionTreeRegressor)()
        own, sizes = named(self.estimator._paramMap), {"numFeatures": self.numFeatures} | ({"numClasses": 2} if self.classes else {})
        self._one()
        nodes = self._nodes()
        spark, path = nodes.sparkSession, f"{self.path}-mllib"

        def text(name: str, uid: str, given: dict, default: dict, **more) -> str:
            head = {"class": f"org.apache.spark.ml.{kind.format(name)}Model", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
            return json.dumps(head | {"uid": uid, "paramMap": given, "defaultParamMap": default} | more)

        nodes.write.parquet(f"{path}/data")
        shared = {k: v for k, v in own.items() if tree.hasParam(k)}
        trees = [(i, text("DecisionTree", f"{tree.uid}_{i}", shared, named(tree._defaultParamMap), **sizes), 1.0) for i in range(self.number)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        whole = text("RandomForest", self.estimator.uid, own, named(self.estimator._defaultParamMap), **sizes, numTrees=self.number)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return loader.load(path)

    @property
    def trees(self):
        return self.model.trees


def _mllib_nodes(nodes: DataFrame, classes: bool) -> DataFrame:
    """Nodes in MLlib's layout."""
    mean = F.col("w1") / F.col("w")
    leaf = F.col("feature") < 0
    if classes:
        prediction, stats, impurity = (F.col("w1") > F.col("w0")).cast("double"), F.array("w0", "w1"), 2 * mean * (1 - mean)
    else:
        prediction, stats, impurity = mean, F.array("w", "w1", "sq"), F.greatest(F.lit(0.0), F.col("sq") / F.col("w") - mean * mean)
    gain = F.when(leaf, -1.0).otherwise(F.col("gain") * (2 if classes else 1) / F.col("w"))
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    data = F.struct(
        F.col("node").alias("id"), prediction.alias("prediction"), impurity.alias("impurity"), stats.alias("impurityStats"), F.col("n").alias("rawCount"),
        gain.alias("gain"), F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    return nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData"))


def fit_trees(rows: DataFrame, estimator, balanced: bool = False, seeds: list[int] | None = None) -> Grown:
    """Fit what ``estimator``, an MLlib forest, describes, on all rows (id, y, features).

    Classes are 0 and 1; ``balanced`` ones get the same total weight. Depth, trees, seed and the choice of features
    (``onethird`` or ``sqrt``) are those of the estimator. With a list of ``seeds``, as many forests are fitted, each
    on the rows whose list ``_fits`` has its number. The result does not depend on how the rows are partitioned, nor
    on the number of tasks. A task holds the bins of all rows of a fit, a byte a feature.
    """
    spark, get = rows.sparkSession, lambda name: estimator.getOrDefault(name)
    classes, trees, depth, several = estimator.hasParam("rawPredictionCol"), get("numTrees"), get("maxDepth"), seeds is not None
    seeds = [s % (1 << 63) for s in (seeds if several else [get("seed")])]
    if classes:
        rows = rows.where(F.assert_true(F.coalesce(F.col("y").isin(0, 1), F.lit(False)), F.lit("classes must be 0 and 1")).isNull())
    own = F.col("_fits").cast("array<int>") if several else F.array(F.lit(0))
    rows = rows.select(F.xxhash64("id").alias("key"), F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features"), own.alias("_fits"))
    rows = materialise(rows, "fit")
    counts = rows.select("y", F.size("features").alias("s"), F.explode("_fits").alias("fit"))
    counts = counts.groupBy("fit").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n1"), F.max("s").alias("width")).collect()
    counts = {r["fit"]: r for r in counts}
    width = max((r["width"] or 0 for r in counts.values()), default=0)
    if set(counts) != set(range(len(seeds))) or width < 1:
        raise ValueError("no rows to fit a forest on")
    # weight of the classes 0 and 1; one that no row has is not looked up
    half = lambda n, c: n / (2 * c) if c else 0.0
    fits = [counts[f] for f in range(len(seeds))]
    weights = [(half(r["n"], r["n"] - r["n1"]), half(r["n"], r["n1"])) if balanced else None for r in fits]
    edges = _edges(rows, width, len(seeds))
    wanted = {"onethird": ceil(width / 3), "sqrt": ceil(sqrt(width))}[get("featureSubsetStrategy")]
    # every task gets all rows of its fit, so there are as many as run at once, and of several fits some more, as they differ
    cores = spark.sparkContext.defaultParallelism
    tasks = min(trees, cores if len(seeds) == 1 else ceil(4 * cores / len(seeds)))
    dealt = _packed(rows, edges).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = dealt.repartitionById(len(seeds) * tasks, F.col("fit") * tasks + F.col("task"))
    of = (edges, trees, tasks, wanted, depth, seeds, weights)

    def as_rows(fit, task, tree, nodes):
        inner = nodes["feature"] >= 0
        nodes["threshold"] = np.nan
        nodes.loc[inner, "threshold"] = [edges[fit][f][c] for f, c in zip(nodes["feature"][inner], nodes["cut"][inner])]
        return nodes.drop(columns="cut").assign(fit=fit, tree=tree)[[f.split()[0] for f in _NODES.split(", ")]]

    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    dealt.mapInPandas(_grower(*of, _as_arrays), _TREES).write.parquet(path)
    return Grown(path, estimator, edges, tasks, several, lambda: _mllib_nodes(dealt.mapInPandas(_grower(*of, as_rows), _NODES), classes))
