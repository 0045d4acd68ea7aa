"""Forests grown a tree to a task: splits against plain loops, whole trees, and MLlib's reading of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.operators import models as M
from adspark.operators.forests import best_splits, bin_edges, grow
from adspark.operators.trees import Forest, node_table
from adspark.sources.shared import materialise


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = [(i, float(rng.normal()), int(rng.random() < 0.3), [float(v) for v in rng.normal(size=5)]) for i in range(200)]
    return materialise(spark.createDataFrame(data, "id int, value double, label int, features array<double>"), "rows")


def side(rows, target):
    return rows.select("id", F.col(target).alias("y"), "features")


def test_edges_lie_between_few_values_and_at_equal_shares_of_many():
    assert bin_edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert bin_edges(np.array([7.0, 7.0])).tolist() == []
    many = bin_edges(np.arange(3200.0))
    assert len(many) == 31 and np.ptp(np.bincount(np.searchsorted(many, np.arange(3200.0)))) <= 1
    assert np.isfinite(bin_edges(np.array([np.inf, -np.inf, 0.0, 1.0]))).all()


def test_best_splits_equal_plain_loops():
    rng = np.random.default_rng(3)
    codes, y, w = rng.integers(0, 6, (90, 4)).astype(np.uint8), rng.normal(size=90), rng.integers(1, 4, 90).astype(float)
    at = np.sort(rng.integers(0, 5, 90))
    feature, cut, gain = best_splits(codes, y, w, at, 5, 4, 6, rng)
    for node in range(5):
        mine = at == node
        spread = lambda m: np.sum(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2)  # noqa: E731, B023
        gains = {}
        for f in range(4):
            for c in range(5):
                left = mine & (codes[:, f] <= c)
                if left.any() and (mine & ~left).any():
                    gains[f, c] = spread(mine) - spread(left) - spread(mine & ~left)
        assert gain[node] == pytest.approx(max(gains.values())) == pytest.approx(gains[feature[node], cut[node]])


def test_a_tree_of_one_row_and_of_equal_rows_is_a_leaf():
    for y in ([2.0], [1.0, 3.0]):
        nodes = grow(np.zeros((len(y), 3), np.uint8), np.array(y), np.ones(len(y)), 3, 30, 2, np.random.default_rng(1))
        assert len(nodes) == 1 and nodes["feature"][0] == -1 and nodes["w1"][0] / nodes["w"][0] == 2.0


def test_a_forest_does_not_depend_on_the_partitions_of_its_rows(spark, rows):
    for target, fit in (("value", M.fit_regressor), ("label", M.fit_classifier)):
        some = [fit(side(rows, target).repartition(n), 5, trees=6, depth=30) for n in (1, 7)]
        one, other = [sorted(map(tuple, node_table(spark, m).toArrow().to_pandas().fillna(-9).to_numpy())) for m in some]
        assert one == other and len({r[0] for r in one}) == 6


def test_trees_without_a_depth_limit_fit_their_rows(spark, rows):
    train = side(rows, "label")
    model = M.fit_classifier(train, 2, trees=12)
    nodes = node_table(spark, model, probability=True)
    assert nodes.where("feature < 0 and value not in (0.0, 1.0)").count() == 0
    hits = M.native_classes(model, train).where("pred_class = y").count()
    assert hits > 180
    # MLlib reads the nodes as a model of its own
    own = {r.id: r.prob for r in M.native_classes(model, train).collect()}
    for r in M.with_tree_outputs(Forest(spark, model, True), train).collect():
        assert np.mean(r.trees) == pytest.approx(own[r.id])
    assert len(model.trees) == 12 and model.model.getNumTrees == 12 and model.numFeatures == 5


def test_rows_that_cannot_be_fitted_are_rejected(spark, rows):
    with pytest.raises(ValueError):
        M.fit_regressor(side(rows, "value").limit(0), 1, trees=2)
    for y, features in ((None, [1.0, 2.0, 3.0, 4.0, 5.0]), (1.0, None), (1.0, [1.0, 2.0])):
        odd = spark.createDataFrame([(-1, y, features)], "id int, y double, features array<double>")
        with pytest.raises(Exception, match="missing label|5 features"):
            M.fit_regressor(side(rows, "value").unionByName(odd), 1, trees=2)
    with pytest.raises(Exception, match="classes must be 0 and 1"):
        M.fit_classifier(side(rows, "label").withColumn("y", F.lit(2)), 1, trees=2)


def test_without_a_bound_mllib_fits_all_rows(rows):
    assert type(M.fit_regressor(side(rows, "value"), 1, trees=2, depth=2, fit_rows=None)).__module__.startswith("pyspark.ml")


def test_small_nodes_are_split_as_well_as_by_plain_loops():
    rng = np.random.default_rng(8)
    sizes = np.array([2, 3, 4, 5, 1, 2, 4, 3])
    at = np.repeat(np.arange(len(sizes)), sizes)
    codes, y, w = rng.integers(0, 4, (len(at), 3)).astype(np.uint8), rng.normal(size=len(at)), rng.integers(1, 3, len(at)) * 0.7
    feature, cut, gain = best_splits(codes, y, w, at, len(sizes), 3, 4, rng)
    for node in range(len(sizes)):
        mine = at == node
        spread = lambda m: np.sum(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2)  # noqa: E731, B023
        sides = {(f, c): mine & (codes[:, f] <= c) for f in range(3) for c in range(3)}
        gains = {k: spread(mine) - spread(m) - spread(mine & ~m) for k, m in sides.items() if m.any() and (mine & ~m).any()}
        if not gains:
            assert feature[node] == -1
            continue
        assert gain[node] == pytest.approx(max(gains.values())) == pytest.approx(gains[feature[node], cut[node]])


def test_forests_are_fitted_on_all_rows_and_no_node_comes_to_the_driver(spark, monkeypatch):
    # more rows than the 20,000 that forests used to be cut to
    n = 24_000
    x = F.array(*[F.xxhash64("id", F.lit(f)) / float(1 << 63) for f in range(3)])
    many = materialise(spark.range(n).select("id", (x[0] + x[1]).alias("y"), (x[0] > 0).cast("int").alias("label"), x.alias("features")), "many")
    monkeypatch.setattr(Forest, "__init__", None)
    model = M.fit_regressor(many, 3, trees=2, depth=2)
    rooted = model._nodes().where("nodeData.id = 0").select("nodeData.*").collect()
    # a tree takes a row 0, 1, 2, ... times, once on average, and 63 % of the rows at all
    assert all(abs(r.impurityStats[0] / n - 1) < 0.05 and abs(r.rawCount / n - 0.632) < 0.02 for r in rooted)
    classes = M.fit_classifier(many.withColumn("y", F.col("label")), 3, trees=2, depth=2)
    assert all(abs(r.rawCount / n - 0.632) < 0.02 for r in classes._nodes().where("nodeData.id = 0").select("nodeData.*").collect())
    scored = M.score_values(model, many, ["id"]).where("abs(pred) <= 2 and size(trees) = 2").count()
    assert scored == n == M.score_classes(classes, many.withColumn("y", F.col("label"))).where("score between 0 and 1").count()


def test_forests_fitted_together_equal_those_fitted_alone(spark, rows):
    for target, fit, probability in (("value", M.fit_regressor, False), ("label", M.fit_classifier, True)):
        train, seeds = side(rows, target), [5, 9, 5]
        fits = [F.col("id") % 3 != 0, F.col("id") % 3 != 1, F.lit(True)]
        taken = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(fits)]))
        together = fit(train.withColumn("_fits", taken), seeds, trees=5, depth=6)
        out = M.with_tree_outputs(together, train.withColumn("_fits", taken), probability, ["id"]).collect()
        for i, c in enumerate(fits):
            alone = fit(train.where(c), seeds[i], trees=5, depth=6)
            want = {r.id: r.trees for r in M.with_tree_outputs(alone, train.where(c), probability).collect()}
            assert {r.id: r.trees for r in out if r._fit == i} == want
    with pytest.raises(ValueError, match="no rows"):
        M.fit_regressor(side(rows, "value").withColumn("_fits", F.array(F.lit(0))), [1, 2], trees=2)


def test_rows_without_features_and_several_blocks(spark, rows, monkeypatch):
    from adspark.operators import forests

    model = M.fit_regressor(side(rows, "value"), 4, trees=7)
    odd = spark.createDataFrame([(-1, None, "a"), (-2, [0.0, None, 1.0, 2.0, 3.0], "b"), (-2, [0.0, None, 1.0, 2.0, 3.0], "b")], "id int, features array<double>, node string")
    given = odd.unionByName(rows.select("id", "features"), allowMissingColumns=True)
    want = sorted(M.with_tree_outputs(Forest(spark, model), given).collect(), key=lambda r: r.id)
    monkeypatch.setattr(forests, "BLOCK_ROWS", 6)
    monkeypatch.setattr(forests, "BLOCKS", 4)
    assert sorted(M.with_tree_outputs(model, given).collect(), key=lambda r: r.id) == want
    assert [r.trees for r in want if r.id == -1] == [None] and M.with_tree_outputs(model, odd.limit(0)).collect() == []
    with pytest.raises(Exception, match="5 features"):
        M.with_tree_outputs(model, spark.createDataFrame([([1.0],)], "features array<double>")).collect()
