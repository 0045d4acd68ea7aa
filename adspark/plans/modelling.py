"""Registered queries: forests, calibrated probabilities and conformal intervals with fitted models.

MLlib forests have no SQL twin; the ``_checks`` queries count rows that break what must hold, and
their twins expect none. Forests have full size: 100 trees for values, 101 for classes, no depth
limit but MLlib's 30, all training rows.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions.bits import unpack_bits
from ..operators import domain as D
from ..operators import intervals as I
from ..operators import models as M
from ..operators.clean import big_enough
from ..operators.metrics import class_statistics, regression_statistics
from ..operators.neighbours import Space
from ..sources.shared import materialise
from .registry import query
from .testbed import DESCRIPTORS, SIG_LEVELS, bit_rows, descriptors, train_test

SEED = 42
METHODS = ("Native", "ICP", "ACP", "SCP")
UPDATES = (1, 2, 3)
# fixed values: the five seeds of a full study
SEEDS = (42, 100, 1, 1000, 657)


def class_rows(t):
    return train_test(descriptors(t).select("id", "y", "features"))


def value_rows(t):
    """Regression rows: the first descriptor is the endpoint, the others describe it."""
    rows = descriptors(t).select(
        "id",
        (F.col("features")[0] * 10 + F.col("features")[1] * 5).alias("y"),
        F.slice("features", 2, 63).alias("features"),
    )
    return train_test(rows)


@query("f1_forest_regression")
def f1(t):
    train, test = value_rows(t)
    model = M.fit_regressor(train, SEED)
    return model.transform(M.with_vector(test)).select("id", "y", F.col("prediction").alias("pred"))


@query("f2_forest_classification")
def f2(t):
    train, test = class_rows(t)
    return M.score_classes(M.fit_classifier(train, SEED), test).select("id", "y", "score")


@query("f3_grid_search")
def f3(t):
    train, test = class_rows(t)
    model = M.fit_classifier(train, SEED, grid={"maxDepth": [6, 30]})
    return M.score_classes(model, test).select("id", "y", "score")


@query("f4_tree_predictions")
def f4(t):
    train, test = value_rows(t)
    return M.with_tree_outputs(M.fit_regressor(train, SEED), test).select("id", "trees")


@query("f4_tree_probabilities")
def f4p(t):
    train, test = class_rows(t)
    return M.with_tree_outputs(M.fit_classifier(train, SEED), test, probability=True).select("id", "trees")


@query("f5_tree_spread_of_forest")
def f5(t):
    train, test = value_rows(t)
    return M.score_values(M.fit_regressor(train, SEED), test).select("id", "pred", "spread")


@query("f7_native_classes")
def f7(t):
    train, test = class_rows(t)
    return M.native_classes(M.fit_classifier(train, SEED), test).select("id", "prob", "pred_class")


@query("f8_ivap_workflow")
def f8(t):
    train, test = class_rows(t)
    return M.ivap_probabilities(train, test, SEED)


@query("f13_ivap_and_cvap_workflows")
def f13(t):
    train, test = class_rows(t)
    parts = [
        M.class_probabilities(m, train, test, SEED).withColumn("method", F.lit(m)) for m in ("Native", "IVAP", "CVAP")
    ]
    return M.union_all(parts)


@query("f20_icp_workflow")
def f20(t):
    train, test = value_rows(t)
    return M.icp_intervals(train, test, SIG_LEVELS, SEED)


@query("f21_acp_workflow")
def f21(t):
    train, test = value_rows(t)
    return M.acp_intervals(train, test, SIG_LEVELS, SEED)


@query("f23_scp_workflow")
def f23(t):
    train, test = value_rows(t)
    return M.scp_intervals(train, test, SIG_LEVELS, SEED)


@query("f24_native_intervals")
def f24(t):
    train, test = value_rows(t)
    pi = M.native_intervals(train, test, SIG_LEVELS, SEED, variant="PI")
    ens = M.native_intervals(train, test, (0.1, 0.32, 0.5), SEED, variant="ENS")
    return pi.withColumn("variant", F.lit("PI")).unionByName(ens.withColumn("variant", F.lit("ENS")))


@query("f26_level_sweep")
def f26(t):
    train, test = value_rows(t)
    out = M.icp_intervals(train, test, SIG_LEVELS, SEED)
    return I.interval_checks(out, ["sig_level"])


def method_intervals(t):
    train, test = value_rows(t)
    return M.union_all([M.regression_intervals(m, train, test, SIG_LEVELS, SEED).withColumn("method", F.lit(m)) for m in METHODS])


@query("f27_regression_methods")
def f27(t):
    return method_intervals(t)


# --- what must hold for any forest -----------------------------------------------------------------

TEST_ROWS = "test_rows AS (SELECT id FROM descriptors WHERE is_test)"


@query(
    "f4_tree_mean_checks",
    """SELECT target, trees, count(*) AS n, 0 AS wrong_trees, 0 AS wrong_means
       FROM test_rows, (VALUES ('value', 100), ('class', 101)) AS v(target, trees) GROUP BY 1, 2""",
    [DESCRIPTORS, TEST_ROWS],
)
def f4_checks(t):
    """Rows whose number of trees is wrong, or whose trees have another mean than the forest's own output."""
    parts = []
    for target, trees, (train, test) in (("value", 100, value_rows(t)), ("class", 101, class_rows(t))):
        if target == "value":
            model = M.fit_regressor(train, SEED)
            own = model.transform(M.with_vector(test)).select(*test.columns, F.col("prediction").alias("own"))
        else:
            model = M.fit_classifier(train, SEED)
            own = M.score_classes(model, test).withColumnRenamed("score", "own")
        out = M.with_tree_outputs(model, own, probability=target == "class")
        same = F.coalesce(F.abs(I.tree_mean("trees") - F.col("own")) < 1e-9, F.lit(False))
        parts.append(
            out.groupBy(F.lit(target).alias("target"), F.lit(trees).alias("trees")).agg(
                F.count("*").alias("n"), F.count_if(F.size("trees") != trees).alias("wrong_trees"), F.count_if(~same).alias("wrong_means")
            )
        )
    return M.union_all(parts)


@query(
    "f13_probability_checks",
    """SELECT method, count(*) AS n, count(DISTINCT id) AS ids, 0 AS misordered, 0 AS wrong_class
       FROM test_rows, (VALUES ('Native'), ('IVAP'), ('CVAP')) AS m(method) GROUP BY 1""",
    [DESCRIPTORS, TEST_ROWS],
)
def f13_checks(t):
    """One row per test id, the probability between p0 and p1 within [0, 1], and the class on the right side of one half.

    p0 <= p1 holds for every calibration set, so for IVAP, but not for CVAP: of folds with (0, 0.1) and (0.9, 1)
    the geometric means are 0.68 and 0.32. The probability lies between the two either way.
    """
    train, test = class_rows(t)
    native = M.class_probabilities("Native", train, test, SEED).select("id", F.lit("Native").alias("method"), F.col("prob").alias("p0"), F.col("prob").alias("p1"), "prob", "pred_class")
    side = (F.col("prob") > 0.5).cast("int").alias("pred_class")
    ivap = M.ivap_probabilities(train, test, SEED).select("id", F.lit("IVAP").alias("method"), "p0", "p1", "prob", side)
    cvap = M.cvap_probabilities(train, test, SEED).select("id", F.lit("CVAP").alias("method"), "p0", "p1", "prob", side)
    low = F.when(F.col("method") == "CVAP", F.least("p0", "p1")).otherwise(F.col("p0"))
    high = F.when(F.col("method") == "CVAP", F.greatest("p0", "p1")).otherwise(F.col("p1"))
    # the two means and the probability are rounded apart
    ordered = (low >= 0) & (low <= F.col("prob") + 1e-12) & (F.col("prob") <= high + 1e-12) & (high <= 1 + 1e-12)
    return M.union_all([native, ivap, cvap]).groupBy("method").agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("ids"),
        F.count_if(~F.coalesce(ordered, F.lit(False))).alias("misordered"),
        F.count_if(~F.coalesce(F.col("pred_class") == (F.col("prob") > 0.5).cast("int"), F.lit(False))).alias("wrong_class"),
    )


@query(
    "f27_interval_checks",
    """SELECT method, sig_level, count(*) AS n, count(DISTINCT id) AS ids, 0 AS outside, 0 AS growing
       FROM test_rows, (VALUES ('Native'), ('ICP'), ('ACP'), ('SCP')) AS m(method), (SELECT unnest([0.0, 0.1, 0.2, 0.32, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS sig_level) AS s
       GROUP BY 1, 2""",
    [DESCRIPTORS, TEST_ROWS],
    "sig_level",
)
def f27_checks(t):
    """One row per test id, method and level; predictions within their intervals, which do not grow with the level.

    Native is only held to lower <= upper.
    """
    lower, upper, pred = F.col("lower"), F.col("upper"), F.col("pred")
    inside = F.when(F.col("method") == "Native", lower <= upper).otherwise(pred.between(lower, upper))
    before = Window.partitionBy("method", "id").orderBy("sig_level")
    grows = F.coalesce((upper - lower) > F.lag(upper - lower).over(before) + 1e-9, F.lit(False))
    rows = method_intervals(t).withColumn("grows", grows)
    return rows.groupBy("method", "sig_level").agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("ids"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"),
        F.count_if("grows").alias("growing"),
    )


@query("e12_forest_agreement_classification")
def e12(t):
    return M.agreement_weights(class_rows(t)[0], 100, regression=False)


@query("e13_forest_agreement_regression")
def e13(t):
    return M.agreement_weights(value_rows(t)[0], 100, regression=True)


@query("e16_rdn_with_forests")
def e16(t):
    train, test = class_rows(t)
    weights = M.agreement_weights(train, 100, regression=False).select("id", "weight")
    return D.rdn_status(train.join(weights, "id"), test, Space(), 3).select("id", "inside")


@query("e21_principal_components")
def e21(t):
    dense = bit_rows(t).select("id", unpack_bits("features", 64).cast("array<double>").alias("bits"))
    scores, explained = M.principal_components(dense, "bits", 2, 64)
    return scores.select(
        "id",
        F.col("components")[0].alias("pc1"),
        F.col("components")[1].alias("pc2"),
        F.lit(explained[0]).alias("explained_1"),
        F.lit(explained[1]).alias("explained_2"),
    )


def time_points(t):
    """Descriptor rows with one of four time points (by md5 of the id)."""
    digit = F.conv(F.substring(F.md5(F.col("id").cast("string")), 2, 1), 16, 10).cast("int")
    return descriptors(t).select("id", "y", "features", F.floor(digit / 4).cast("int").alias("time"))


@query("i20_time_update_classification")
def i20(t):
    """Updates T1..T3: train on everything earlier, test on the time point itself."""
    rows = time_points(t)
    status, sizes = [], []
    runs = [(update, seed) for update in UPDATES for seed in SEEDS]

    def of(row) -> Column:
        """Numbers of the runs that use a row for ``row(update, time)``."""
        return F.array_compact(F.array(*[F.when(row(F.lit(u), F.col("time")), F.lit(i)) for i, (u, _) in enumerate(runs)]))

    for update in UPDATES:
        train, test = rows.where(F.col("time") < update), rows.where(F.col("time") == update)
        tag = F.lit(f"T{update}").alias("update")
        status.append(D.nunc_status(train.drop("y", "time"), test, Space(), [3]).select(tag, "id", "inside"))
        sizes.append(big_enough(test.withColumn("update", F.lit(f"T{update}")), ["update"], "y"))
    model = M.fit_classifier(rows.withColumn("_fits", of(lambda u, time: time < u)), [seed for _, seed in runs])
    scored = M.native_classes(model, rows.withColumn("_fits", of(lambda u, time: time == u)))
    update, seed = (F.get(F.array(*[F.lit(v) for v in values]), F.col("_fit")) for values in ([f"T{u}" for u, _ in runs], [s for _, s in runs]))
    scored = scored.select(update.alias("update"), seed.alias("seed"), "id", "y", "prob")
    usable = M.union_all(sizes).where("usable").select("update")
    scored = scored.join(M.union_all(status), ["update", "id"]).join(usable, "update", "left_semi")
    return class_statistics(D.tag_subsets(materialise(scored, "updates")), ["update", "seed", "subset"], p_values=False)


@query("i20_time_update_regression")
def i20r(t):
    """Regression twin: ICP intervals and regression statistics per update."""
    rows = time_points(t).select(
        "id", "time", (F.col("features")[0] * 10 + F.col("features")[1] * 5).alias("y"), F.slice("features", 2, 63).alias("features")
    )
    status = []

    def fitted(update: int):
        train, test = rows.where(F.col("time") < update).drop("time"), rows.where(F.col("time") == update).drop("time")
        out = M.icp_intervals(train, test, SIG_LEVELS, SEED).join(test.select("id", "y"), "id")
        return out.select(F.lit(f"T{update}").alias("update"), "*")

    for update in UPDATES:
        train, test = rows.where(F.col("time") < update), rows.where(F.col("time") == update)
        status.append(D.nunc_status(train.drop("y", "time"), test.drop("time"), Space(), [3]).select(F.lit(f"T{update}").alias("update"), "id", "inside"))
    scored = M.in_parallel([lambda u=u: fitted(u) for u in UPDATES])
    scored = materialise(M.union_all(scored).join(M.union_all(status), ["update", "id"]), "updates")
    return regression_statistics(D.tag_subsets(scored), ["update", "subset"], p_values=False)
