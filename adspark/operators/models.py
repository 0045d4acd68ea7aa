"""Random forests with MLlib, their per-tree outputs, and the workflows built on them."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import with_scalars
from ..sources.shared import materialise
from . import calibrate, intervals, splits
from .domain import agreement_classification, agreement_regression, agreement_weight, spread_of
from .forests import Grown, fit_trees
from .trees import Forest

_VEC = "_vector"
#: What a forest is fitted on unless a caller sets a bound.
ALL_ROWS = math.inf


def with_vector(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn(_VEC, array_to_vector(F.col(features)))


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Add ``_w`` = n / (2 n_class): both classes get the same total weight."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_n1"))
    size = F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1"))
    weighted = with_scalars(df, counts).withColumn("_w", F.col("_n") / (2 * size))
    return weighted.drop("_n", "_n1")


def bounded(train: DataFrame, fit_rows: float | None = ALL_ROWS) -> DataFrame:
    """All training rows; with a bound, which only callers of their own choice set, about that many by hash of their id."""
    if fit_rows is None or fit_rows == ALL_ROWS:
        return train
    share = min(1.0, fit_rows / max(1, train.count()))
    return train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_regressor(train: DataFrame, seed: int | list[int], trees: int = 100, depth: int = 30, fit_rows: float | None = ALL_ROWS):
    """Forest of regression trees, a third of the features per split, on all rows.

    With a list of seeds, as many forests, each on the rows whose list ``_fits`` has its number. With
    ``fit_rows=None`` MLlib grows the trees.
    """
    forest = RandomForestRegressor(
        featuresCol=_VEC, labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=_first(seed)
    )
    return forest.fit(with_vector(train)) if fit_rows is None else fit_trees(bounded(train, fit_rows), forest, seeds=_several(seed))


def _first(seed: int | list[int]) -> int:
    return seed[0] if isinstance(seed, list) else seed


def _several(seed: int | list[int]) -> list[int] | None:
    return seed if isinstance(seed, list) else None


def classifier(seed: int, trees: int = 101, depth: int = 30) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=_VEC, labelCol="y", weightCol="_w", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )


def fit_classifier(train: DataFrame, seed: int | list[int], trees: int = 101, depth: int = 30, grid: dict | None = None, fit_rows: float | None = ALL_ROWS):
    """Forest of classification trees, balanced classes, square root of the features per split, on all rows.

    A ``grid`` (parameter name -> values) with more than one point is searched by 2-fold
    cross-validation on the balanced accuracy; one point is simply fitted. With a list of seeds, as many
    forests, each on the rows whose list ``_fits`` has its number. With ``fit_rows=None`` MLlib grows the trees.
    """
    rows, forest = bounded(train, fit_rows), classifier(_first(seed), trees, depth)
    points = [{forest.getParam(k): v for k, v in zip(grid, chosen)} for chosen in product(*grid.values())] if grid else [{}]
    if len(points) > 1:
        rows = materialise(rows, "search")
        points = [_best_point(rows, forest, points, _first(seed), fit_rows is None)]
    forest = forest.copy(points[0])
    return forest.fit(with_vector(balanced_weights(rows))) if fit_rows is None else fit_trees(rows, forest, balanced=True, seeds=_several(seed))


def _best_point(rows: DataFrame, forest, points: list[dict], seed: int, by_mllib: bool) -> dict:
    """The point with the highest balanced accuracy in two folds, the first of equal ones."""
    folds = materialise(balanced_weights(rows).withColumn("_fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2))), "folds")

    def accuracy(point: dict, fold: int) -> float:
        own, others = folds.where(F.col("_fold") == fold), folds.where(F.col("_fold") != fold)
        tried = forest.copy(point)
        model = tried.fit(with_vector(others)) if by_mllib else fit_trees(others, tried, balanced=True)
        # with balanced weights, the share of the weight that is right is the balanced accuracy
        right = F.when(F.col("prediction") == F.col("y"), F.col("_w")).otherwise(0.0)
        return model.transform(with_vector(own)).agg((F.sum(right) / F.sum("_w")).alias("a")).first().a

    found = in_parallel([lambda p=p, f=f: accuracy(p, f) for p in points for f in (0, 1)])
    return points[max(range(len(points)), key=lambda i: found[2 * i] + found[2 * i + 1])]


def class_1_probability(vector: str = "probability") -> Column:
    """Probability of class 1; a forest trained on one class only has no second entry."""
    p = vector_to_array(F.col(vector))
    return F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0))


def score_classes(model, rows: DataFrame) -> DataFrame:
    """Input columns plus ``score`` (probability of class 1); of several forests, a row for each of ``_fits``, named in ``_fit``."""
    out = model.transform(with_vector(rows))
    return out.select(*[c for c in out.columns if c in rows.columns or c == "_fit"], class_1_probability().alias("score"))


def native_classes(model, rows: DataFrame) -> DataFrame:
    """Input columns plus ``prob`` and ``pred_class`` of the plain forest."""
    scored = score_classes(model, rows).withColumnRenamed("score", "prob")
    return scored.withColumn("pred_class", (F.col("prob") > 0.5).cast("int"))


def with_tree_outputs(model, rows: DataFrame, probability: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Input columns, or those to ``keep``, plus ``trees``: per-tree prediction, or probability of class 1.

    ``model`` is a fitted forest, or the ``Forest`` made of it if its nodes are few. Of several forests, a row
    for each of ``_fits``, named in ``_fit``.
    """
    if isinstance(model, Grown):
        return model.with_trees(rows, "features", "trees", probability, keep)
    forest = model if isinstance(model, Forest) else Forest(rows.sparkSession, model, probability)
    out = rows.withColumn("trees", forest.outputs("features"))
    return out if keep is None else out.select(*keep, "trees")


def score_values(model, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Input columns, or those to ``keep``, plus ``trees``, ``pred``, ``spread`` and ``scale`` of a regression forest."""
    out = with_tree_outputs(model, rows, keep=keep)
    out = out.withColumn("pred", intervals.tree_mean("trees")).withColumn("spread", spread_of("trees"))
    return out.withColumn("scale", F.exp("spread"))


def in_parallel(jobs: list[Callable], threads: int = 8) -> list:
    """Run independent fits side by side; every fit is itself a distributed job, of few tasks if its rows are few."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- regression workflows ------------------------------------------------------------------------


def native_intervals(train: DataFrame, test: DataFrame, levels, seed: int, trees: int = 100, depth: int = 30, variant: str = "PI") -> DataFrame:
    """Plain forest with ENS or PI intervals for every level (confidence = 100 (1 - level))."""
    scored = materialise(score_values(fit_regressor(train, seed, trees, depth), test, ["id"]), "native")
    make = intervals.ensemble_interval if variant == "ENS" else intervals.percentile_interval
    each = [
        F.struct(F.lit(float(level)).alias("sig_level"), make(F.col("pred"), F.col("trees"), int(round(100 * (1 - level), 2))).alias("i"))
        for level in levels
    ]
    return scored.select("id", "pred", F.explode(F.array(*each)).alias("_e")).select("id", "pred", "_e.sig_level", "_e.i.lower", "_e.i.upper")


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _to_score(held: DataFrame, test: DataFrame, fits: int) -> DataFrame:
    """Calibration rows with the fits that do not see them, and test rows with all fits, for one pass over the trees."""
    rows = held.select("id", "y", "features", "_fits", F.lit(True).alias("_held"))
    new = test.select("id", "features", _numbers(fits).alias("_fits"), F.lit(False).alias("_held"))
    return rows.unionByName(new, allowMissingColumns=True)


def _calibrated(train: DataFrame, held: DataFrame, test: DataFrame, name: str, seeds: list[int], trees: int, depth: int):
    """Scored calibration and test rows of several fits; ``_fits`` of ``train`` and ``held`` has those that fit or hold out a row."""
    model = fit_regressor(train, seeds, trees, depth)
    scored = score_values(model, _to_score(held, test, len(seeds)), ["id", "y", "_held"])
    scored = materialise(scored.select(F.col("_fit").alias(name), "id", "y", "pred", "spread", "scale", "_held"), "scored")
    return scored.where("_held").drop("_held"), scored.where("NOT _held").drop("_held", "y")


def icp_intervals(train: DataFrame, test: DataFrame, levels, seed: int, trees: int = 100, depth: int = 30, fraction: float = 0.25) -> DataFrame:
    """ICP: one stratified calibration split."""
    return acp_splits(train, test, levels, seed, 1, trees, depth, fraction).drop("split")


def acp_splits(train: DataFrame, test: DataFrame, levels, seed: int, n: int, trees: int, depth: int, fraction: float) -> DataFrame:
    """ICP intervals of ``n`` independent calibration splits, numbered in ``split``."""

    rows = splits.with_value_strata(train.select("id", "y", "features"), [], "y")
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    # the splits of a row as one list, so that its features are not copied
    roles = splits.repeated_splits(rows.select("id", "_row", "stratum"), "id", "stratum", fraction, seed, n)
    held = roles.where("role = 'test'").groupBy("_row").agg(F.array_sort(F.collect_list("split")).alias("_fits"))
    held = materialise(rows.join(held, "_row", "left").withColumn("_fits", F.coalesce("_fits", F.array().cast("array<int>"))), "splits")
    fitted = held.withColumn("_fits", F.array_except(_numbers(n), "_fits"))
    calibration, new = _calibrated(fitted, held, test, "split", [seed + i for i in range(n)], trees, depth)
    out = intervals.icp(calibration, new, ["split"], levels)
    return out.select("split", "id", "pred", "sig_level", "lower", "upper")


def acp_intervals(train: DataFrame, test: DataFrame, levels, seed: int, n: int = 20, trees: int = 100, depth: int = 30, fraction: float = 0.25) -> DataFrame:
    """ACP: medians over ``n`` splits."""
    return intervals.acp(acp_splits(train, test, levels, seed, n, trees, depth, fraction), ["id"])


def scp_intervals(train: DataFrame, test: DataFrame, levels, seed: int, parts: int = 5, trees: int = 100, depth: int = 30, fraction: float = 0.25) -> DataFrame:
    """SCP: one calibration set, forests on disjoint parts of the remaining rows."""
    split = materialise(splits.continuous_split(train, "id", "y", fraction, seed), "split")
    held = split.where("role = 'test'").withColumn("_fits", _numbers(parts))
    numbered = splits.contiguous_parts(split.where("role = 'train'").drop("role"), "id", parts, seed).withColumn("_fits", F.array("part"))
    calibration, new = _calibrated(numbered, held, test, "part", [seed] * parts, trees, depth)
    only = F.lit(0).alias("calibration_set")
    cal = calibration.select(only, "id", intervals.nonconformity().alias("alpha"))
    out = intervals.scp(cal, new.select(only, "id", "pred", "spread"), ["calibration_set"], levels)
    return out.select("id", "pred", "sig_level", "lower", "upper")


def regression_intervals(method: str, train: DataFrame, test: DataFrame, levels, seed: int, **options) -> DataFrame:
    """(id, pred, sig_level, lower, upper) by Native, ICP, ACP or SCP."""
    known = {"Native": native_intervals, "ICP": icp_intervals, "ACP": acp_intervals, "SCP": scp_intervals}
    if method not in known:
        raise ValueError(f"unknown uncertainty method {method!r}")
    return known[method](train, test, levels, seed, **options).select("id", "pred", "sig_level", "lower", "upper")


# --- classification workflows --------------------------------------------------------------------


def _fold_scores(train: DataFrame, held: DataFrame, test: DataFrame, seeds: list[int], trees: int, depth: int):
    """Scores of calibration and test rows by several fits; ``_fits`` of ``train`` and ``held`` has those that fit or hold out a row."""
    model = fit_classifier(train, seeds, trees, depth)
    scored = score_classes(model, _to_score(held, test, len(seeds)))
    scored = materialise(scored.select(F.col("_fit").alias("fold"), "id", "y", "score", "_held"), "scored")
    return scored.where("_held").select("fold", "y", "score"), scored.where("NOT _held").select("fold", "id", "score")


def ivap_probabilities(train: DataFrame, test: DataFrame, seed: int, trees: int = 101, depth: int = 30, fraction: float = 0.2) -> DataFrame:
    """IVAP: fit on 80 %, calibrate on 20 %; (id, p0, p1, prob)."""
    split = materialise(splits.stratified_split(train, "id", "y", fraction, seed), "split").withColumn("_fits", _numbers(1))
    cal, new = _fold_scores(split.where("role = 'train'"), split.where("role = 'test'"), test, [seed], trees, depth)
    return calibrate.ivap(cal, new, ["fold"]).select("id", "p0", "p1", "prob")


def cvap_probabilities(train: DataFrame, test: DataFrame, seed: int, folds: int = 5, trees: int = 101, depth: int = 30) -> DataFrame:
    """CVAP: every fold calibrates once; geometric means over the folds."""
    held = materialise(splits.k_folds(train, "id", "y", folds, seed), "folds").withColumn("_fits", F.array("fold"))
    fitted = held.withColumn("_fits", F.array_except(_numbers(folds), "_fits"))
    cal, new = _fold_scores(fitted, held, test, [seed] * folds, trees, depth)
    return calibrate.cvap(calibrate.venn_abers(cal, new, ["fold"]), [])


def class_probabilities(method: str, train: DataFrame, test: DataFrame, seed: int, **options) -> DataFrame:
    """(id, prob, pred_class) by Native, IVAP or CVAP."""
    if method == "Native":
        return native_classes(fit_classifier(train, seed, **options), test).select("id", "prob", "pred_class")
    if method not in ("IVAP", "CVAP"):
        raise ValueError(f"unknown uncertainty method {method!r}")
    run = ivap_probabilities if method == "IVAP" else cvap_probabilities
    out = run(train, test, seed, **options)
    return out.select("id", "prob", (F.col("prob") > 0.5).cast("int").alias("pred_class"))


# --- RDN weights -----------------------------------------------------------------------------------


def agreement_weights(train: DataFrame, seed: int, regression: bool, trees: int = 10, folds: int = 2, depth: int = 30) -> DataFrame:
    """(id, agreement, spread, weight) of every training row from forests that did not see it."""
    rows = splits.with_value_strata(train, [], "y") if regression else train.withColumn("stratum", F.col("y"))
    held = materialise(splits.k_folds(rows, "id", "stratum", folds, seed).drop("stratum"), "folds").withColumn("_fits", F.array("fold"))
    fitted = held.withColumn("_fits", F.array_except(_numbers(folds), "_fits"))
    if regression:
        model = fit_regressor(fitted, [seed] * folds, trees, depth)
    else:
        forest = RandomForestClassifier(
            featuresCol=_VEC, labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
        )
        model = fit_trees(fitted, forest, seeds=[seed] * folds)
    scored = with_tree_outputs(model, held, not regression, ["id", "y"])
    measure = agreement_regression if regression else agreement_classification
    agree, std = measure("trees", "y")
    out = materialise(scored.select("id", agree.alias("agreement"), std.alias("spread")), "agreement")
    return out.withColumn("weight", agreement_weight(F.col("agreement"), F.col("spread")))


# --- descriptor space ------------------------------------------------------------------------------


def principal_components(df: DataFrame, features: str, wanted: int, width: int) -> tuple[DataFrame, list[float]]:
    """Scores of the leading components and their explained variance in percent.

    At most min(rows, width) components; the covariance matrix has ``width`` squared entries.
    """
    rows = df.limit(width).count()
    k = max(1, min(wanted, rows, width))
    model = PCA(k=k, inputCol=_VEC, outputCol="_pc").fit(with_vector(df, features))
    scores = model.transform(with_vector(df, features)).withColumn("components", vector_to_array("_pc"))
    return scores.drop(_VEC, "_pc"), [100 * float(v) for v in model.explainedVariance]
