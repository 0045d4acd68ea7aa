"""Groups and rows with a NULL key are groups and rows like any other."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from adspark.functions import ordered
from adspark.functions.bits import sign_words, token_position
from adspark.functions.distance import dense_distance
from adspark.functions.joining import join_on
from adspark.operators import calibrate as V, clean as C, domain as D, intervals as I, metrics as M, shift as H, splits as S
from adspark.operators.neighbours import Space
from adspark.sources.files import write_partitioned

GROUPS = (None, 1)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(g, i, i % 2, round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * (i % 2), 0.2))), 3), i % 3 != 0) for g in GROUPS for i in range(40)]
    return spark.createDataFrame(rows, "g int, id int, y int, prob double, inside boolean").cache()


@pytest.fixture(scope="module")
def measured(spark):
    rng = random.Random(5)
    rows = []
    for g in GROUPS:
        for i in range(45):
            y, half = rng.gauss(0, 2), rng.uniform(0.2, 2)
            pred = y + rng.gauss(0, 1)
            rows += [(g, i, y, pred, pred - half * k, pred + half * k, level, i % 3 != 0) for k, level in ((1, 0.32), (2, 0.1))]
    return spark.createDataFrame(rows, "g int, id int, y double, pred double, lower double, upper double, sig_level double, inside boolean").cache()


def groups_of(df):
    return sorted({r["g"] for r in df.select("g").collect()}, key=str)


def same_for_both(df, *, ignore=("g",)):
    """Every group has rows, and equal groups have equal results."""
    assert groups_of(df) == [1, None]
    rows = df.collect()
    return [r for r in rows if r["g"] is None], [r for r in rows if r["g"] == 1]


@pytest.mark.parametrize("how, n", [("inner", 3), ("left", 4), ("left_semi", 3), ("left_anti", 1)])
def test_join(spark, how, n):
    a = spark.createDataFrame([(None, 1), (1, 2), (None, 3), (2, 4)], "k int, v int")
    b = spark.createDataFrame([(None, 7), (1, 8)], "k int, w int")
    out = join_on(a, b, ["k"], how)
    assert out.count() == n and out.columns == (["k", "v", "w"] if how in ("inner", "left") else ["k", "v"])


def test_ids(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), (None, 4)], "k string, v int")
    got = {(r.k, r.v): r.id for r in C.dense_ids(df, "k").collect()}
    assert got == {(None, 2): 0, (None, 4): 0, ("a", 3): 1, ("b", 1): 2}


def test_cleaning(spark):
    rows = [(None, 1, v) for v in (1.0, 2.0, 3.0, 4.0, 500.0)] + [(1, 1, v) for v in (1.0, 2.0, 3.0, 4.0, 500.0)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    kept = C.without_outliers(df, ["g"], "v").groupBy("g").count().collect()
    assert {(r.g, r["count"]) for r in kept} == {(None, 4), (1, 4)}
    assert {(r.g, round(r.v, 4)) for r in C.dedup_values(df, "g", "v", ["o"]).collect()} == {(None, 2.5), (1, 2.5)}


def test_splits(spark):
    rows = [(None if i % 2 else "e", i, float(i % 7), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id int, v double, s int")
    for out in (
        S.stratified_split(df, "id", "s", 0.25, 1, ["g"]),
        S.random_split(df, "id", 0.25, 1, ["g"]),
        S.continuous_split(df, "id", "v", 0.25, 1, ["g"]),
        S.stratified_split(df.withColumn("s", F.lit(None).cast("int")), "id", "s", 0.25, 1, ["g"]),
    ):
        got = {(r.g, r.role): r["count"] for r in out.groupBy("g", "role").count().collect()}
        assert got == {(g, role): n for g in (None, "e") for role, n in (("test", 5), ("train", 15))}
    assert S.k_folds(df, "id", "s", 4, 1, ["g"]).count() == S.contiguous_parts(df, "id", 4, 1, ["g"]).count() == 40


def test_class_statistics(scored):
    lone, one = same_for_both(M.class_statistics(scored, ["g"]))
    assert len(lone) == len(one) == 1 and lone[0].auc is not None and lone[0].spearman_cal is not None
    same_for_both(M.auc(scored, ["g"]))
    same_for_both(M.calibration(scored, ["g"], (0.05, 0.1)))


def test_regression_statistics(measured):
    lone, one = same_for_both(M.regression_statistics(measured, ["g"]))
    assert all(lone[0][c] is not None for c in ("rmse", "spearman", "validity", "ece", "ence", "scc"))
    same_for_both(M.activity_summary(measured, ["g"], "y"))


def test_order_statistics(scored):
    quantiles = ordered.exact_quantiles(scored, ["g"], "prob", {"median": 0.5})
    expected = {r.g: r.m for r in scored.groupBy("g").agg(F.expr("percentile(prob, 0.5D)").alias("m")).collect()}
    assert {r.g: r["median"] for r in quantiles.collect()} == pytest.approx(expected)
    same_for_both(ordered.row_positions(scored, ["g"], "prob", "id", "at"))
    same_for_both(ordered.kth_smallest(scored, ["g"], "prob", F.lit(3), "third"))


def test_calibrated_and_conformal(scored, measured):
    early = scored.where("id < 25").select("g", F.col("prob").alias("score"), "y")
    late = scored.where("id >= 25").select("g", "id", F.col("prob").alias("score"))
    lone, one = same_for_both(V.ivap(early, late, ["g"]))
    assert len(lone) == len(one) == 15
    rows = measured.where("sig_level = 0.1").withColumn("scale", F.lit(1.0))
    out = I.icp(rows.where("id < 30"), rows.where("id >= 30").select("g", "id", "pred", "scale"), ["g"], (0.2, 0.7))
    lone, one = same_for_both(out)
    assert len(lone) == len(one) == 30


def test_plain_floor_of_the_conformal_rank(spark):
    # 0.7 * 90 is just under 63 in floating point
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 90)], "g int, alpha double")
    got = {r.sig_level: r.alpha_s for r in I.conformal_quantiles(df, ["g"], (0.1, 0.7)).collect()}
    assert got == {0.1: 89.0 - math.floor(0.1 * 90) + 1, 0.7: 89.0 - math.floor(0.7 * 90) + 1}


def test_shifts(scored, measured):
    lone, one = same_for_both(H.permutation_test(scored, ["g"], ["ba", "auc", "rmse_cal"], n=8, seed=3))
    assert len(lone) == len(one) == 6 and all(r.p is not None for r in lone)
    lone, _ = same_for_both(H.permutation_test(measured, ["g"], ["rmse", "validity"], n=8, seed=3, kind="value"))
    assert all(r.p is not None for r in lone)
    family = scored.select("g", "id", F.when(F.col("id") > 3, F.col("prob")).alias("p"))
    lone, one = same_for_both(H.adjust_p_values(family, ["g"]))
    assert len(lone) == len(one) == 40 and sum(r.p_adjusted is None for r in lone) == 4


def test_neighbours(spark):
    rows = [(g, i, [float(i), float(i % 3)]) for g in GROUPS for i in range(12)] + [(1, 99, None)]
    train = spark.createDataFrame(rows, "g int, id int, features array<double>").where("features IS NOT NULL")
    space = Space(by=("g",))
    near = D.nearest_distances(train, None, space, 2)
    assert near.count() == 24
    lone, one = same_for_both(D.dknn_status(train, train, space, [2]))
    assert len(lone) == len(one) == 12


def test_wide_sign_words(spark):
    df = spark.createDataFrame([([1.0] * 80,), ([-1.0] * 64 + [1.0] * 16,), ([],), ([1.0],)], "v array<double>")
    words = [r[0] for r in df.select(sign_words("v")).collect()]
    assert words == [[-1, 2**16 - 1], [0, 2**16 - 1], [0], [1]]


def test_widths_are_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(dense_distance("a", "b", "euclidean", 2)).first()[0] == 2.0
    with pytest.raises(Exception, match="do not have 1 values"):
        df.select(dense_distance("a", "b", "euclidean", 1)).collect()
    with pytest.raises(ValueError):
        token_position(F.lit("x"), 1 << 17)


def test_a_large_partition_value_has_many_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS e")
    write_partitioned(df, f"{tmp_path}/out", ["e"], rows_per_file=500)
    files = {e: len(list((tmp_path / "out" / f"e={e}").glob("*.parquet"))) for e in "ab"}
    assert 4 <= files["a"] <= 9 and files["b"] == 1
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("e").count().collect() is not None
