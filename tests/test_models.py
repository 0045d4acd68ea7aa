"""Properties of the forest workflows: their numbers depend on the random trees."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adspark.operators import intervals as I
from adspark.operators import models as M
from adspark.operators.domain import spread_of
from adspark.operators.trees import Forest, Nodes, runs_of_trees
from adspark.sources.shared import materialise

SMALL = {"trees": 8, "depth": 4}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 4))
    value = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=160)
    data = [(i, float(v), int(v > 0), [float(a) for a in r]) for i, (v, r) in enumerate(zip(value, x))]
    df = spark.createDataFrame(data, "id int, value double, label int, features array<double>")
    return materialise(df, "rows")


def sides(rows, target):
    df = rows.select("id", F.col(target).alias("y"), "features")
    return df.where("id % 4 <> 0"), df.where("id % 4 = 0")


def test_forest_prediction_is_the_mean_of_its_trees(rows):
    train, test = sides(rows, "value")
    model = M.fit_regressor(train, 1, **SMALL)
    forest = {r.id: r.prediction for r in model.transform(M.with_vector(test)).collect()}
    for r in M.score_values(model, test).collect():
        assert len(r.trees) == 8 and r.pred == pytest.approx(forest[r.id])
        assert r.spread == pytest.approx(np.std(r.trees)) and r.scale == pytest.approx(np.exp(r.spread))


def test_tree_probabilities_and_scores(rows):
    train, test = sides(rows, "label")
    model = M.fit_classifier(train, 1, **SMALL)
    scored = {r.id: r.score for r in M.score_classes(model, test).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    for r in M.with_tree_outputs(model, test, probability=True).collect():
        assert all(0 <= p <= 1 for p in r.trees) and np.mean(r.trees) == pytest.approx(scored[r.id])


@pytest.mark.parametrize("method,extra", [("Native", {}), ("ICP", {}), ("ACP", {"n": 2}), ("SCP", {"parts": 2})])
def test_intervals_contain_predictions_and_shrink_with_the_level(rows, method, extra):
    train, test = sides(rows, "value")
    out = materialise(M.regression_intervals(method, train, test, (0.1, 0.5, 0.8), 3, **SMALL, **extra), "intervals")
    checks = I.interval_checks(out, ["sig_level"]).collect()
    assert len(checks) == 3 and all(c.n == 40 and c.reversed == 0 and c.outside == 0 for c in checks)
    width = {r.sig_level: r.w for r in out.groupBy("sig_level").agg(F.avg(F.col("upper") - F.col("lower")).alias("w")).collect()}
    assert width[0.1] > width[0.5] >= width[0.8]


@pytest.mark.parametrize("method", ["Native", "IVAP", "CVAP"])
def test_probabilities_separate_the_classes(rows, method):
    train, test = sides(rows, "label")
    extra = {"folds": 2} if method == "CVAP" else {}
    out = M.class_probabilities(method, train, test, 3, **SMALL, **extra)
    got = out.join(test.select("id", "y"), "id").collect()
    assert len(got) == 40 and all(0 <= r.prob <= 1 and r.pred_class == int(r.prob > 0.5) for r in got)
    assert np.mean([r.pred_class == r.y for r in got]) > 0.7


def test_agreement_weights_cover_all_training_rows(rows):
    for target, regression in (("label", False), ("value", True)):
        train, _ = sides(rows, target)
        got = M.agreement_weights(train, 5, regression, trees=4, depth=4).collect()
        assert len(got) == 120 and all(0 <= r.weight <= 1 and 0 <= r.agreement <= 1 for r in got)


def test_unknown_methods_are_rejected(rows):
    train, test = sides(rows, "value")
    with pytest.raises(ValueError):
        M.regression_intervals("other", train, test, (0.1,), 1)
    with pytest.raises(ValueError):
        M.class_probabilities("other", train, test, 1)


def test_component_count_is_capped(rows):
    scores, explained = M.principal_components(rows, "features", 10, 4)
    assert len(explained) == 4 and sum(explained) == pytest.approx(100)
    assert len(scores.first().components) == 4


def test_nodes_walk_a_tree_grown_by_hand():
    # x0 <= 1 ? 10 : (x1 <= -2 ? 20 : 30), and a tree of one leaf
    table = pd.DataFrame(
        [(0, 0, 0, 1.0, 1, 2, 0.0), (0, 1, -1, None, -1, -1, 10.0), (0, 2, 1, -2.0, 3, 4, 0.0), (0, 3, -1, None, -1, -1, 20.0), (0, 4, -1, None, -1, -1, 30.0), (7, 0, -1, None, -1, -1, 5.0)],
        columns=["tree", "node", "feature", "threshold", "left", "right", "value"],
    )
    nodes = Nodes.of(table.sample(frac=1, random_state=1))
    x = np.array([[1.0, 9.0], [1.5, -2.0], [1.5, 0.0], [np.nan, np.nan], [np.inf, -np.inf]])
    assert nodes.outputs(x).tolist() == [[10, 5], [20, 5], [30, 5], [30, 5], [20, 5]]
    assert nodes.outputs(x[:0]).shape == (0, 2)
    with pytest.raises(ValueError):
        Nodes.of(table[table["node"] != 1])


def test_runs_of_trees():
    assert runs_of_trees([], 10) == []
    assert runs_of_trees([4, 6, 1], 10) == [(0, 2), (2, 3)]
    assert runs_of_trees([50, 3, 50], 10) == [(0, 1), (1, 2), (2, 3)]


def test_trees_as_nodes_equal_the_trees_themselves(spark, rows):
    for target, fit in (("value", M.fit_regressor), ("label", M.fit_classifier)):
        train, test = sides(rows, target)
        model = fit(train, 1, **SMALL)
        chained = M.with_vector(test)
        for i, tree in enumerate(model.trees):
            tree.setPredictionCol(f"p{i}" if target == "value" else "")
            if target == "label":
                tree.setRawPredictionCol("").setProbabilityCol(f"p{i}")
            chained = tree.transform(chained)
        want = {r.id: [r[f"p{i}"] if target == "value" else r[f"p{i}"][1] for i in range(8)] for r in chained.collect()}
        for most in (1, 40, 4_000_000):
            forest = Forest(spark, model, target == "label", most)
            assert len(forest.runs) == {1: 8, 4_000_000: 1}.get(most, len(forest.runs))
            got = M.with_tree_outputs(forest, test)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ArrowEvalPython") == len(forest.runs)
            assert {r.id: pytest.approx(r.trees) for r in got.collect()} == want


def test_rows_without_features_and_clashing_columns(spark, rows):
    train, test = sides(rows, "value")
    forest = Forest(spark, M.fit_regressor(train, 1, **SMALL))
    odd = spark.createDataFrame([(1, None, "a"), (2, [0.0, None, 1.0, 2.0], "b"), (2, [0.0, None, 1.0, 2.0], "b")], "id int, features array<double>, node string")
    got = M.with_tree_outputs(forest, odd).collect()
    assert [r.node for r in got] == ["a", "b", "b"] and got[0].trees is None and len(got[1].trees) == 8 and got[1].trees == got[2].trees
    assert M.with_tree_outputs(forest, odd.limit(0)).collect() == []
    with pytest.raises(Exception, match="4 features"):
        M.with_tree_outputs(forest, spark.createDataFrame([([1.0],)], "features array<double>")).collect()


def test_a_bound_keeps_about_that_many_rows(rows):
    train, _ = sides(rows, "value")
    assert M.bounded(train).count() == 120 and 20 <= M.bounded(train, 50).count() <= 80
    assert M.bounded(train.limit(0)).count() == 0


def test_the_spread_of_a_long_list_takes_its_mean_once(spark):
    # 20,000 values: 400,000,000 steps with a mean for each of them
    values = F.sequence(F.lit(1), F.lit(20_000)).cast("array<double>")
    df = spark.range(2).select("id", F.when(F.col("id") == 0, values).alias("v"))
    start = time.time()
    got = {r.id: r.s for r in df.select("id", spread_of("v").alias("s")).collect()}
    assert time.time() - start < 15
    assert got[0] == pytest.approx(np.std(np.arange(1, 20_001))) and got[1] is None
