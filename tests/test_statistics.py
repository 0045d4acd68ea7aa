"""Metrics, calibration, intervals, p-values and ranking on small literals."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.functions import ordered
from adspark.functions import scalar
from adspark.functions.scalar import incomplete_beta, strict_reach
from adspark.operators import calibrate as V
from adspark.operators import intervals as I
from adspark.operators import metrics as M
from adspark.operators import ranking as R
from adspark.operators import shift as H


def class_frame(spark, y, p):
    return spark.createDataFrame([(1, i, a, float(b)) for i, (a, b) in enumerate(zip(y, p))], "g int, id int, y int, prob double")


def test_classification_row(spark):
    df = class_frame(spark, [1, 1, 1, 1, 0], [0.8, 0.49, 0.2, 0.1, 0.6])
    r = M.class_statistics(df, ["g"]).first()
    want = dict(
        precision_1=0.5, precision_0=0.0, recall_1=0.25, recall_0=0.0, ba=0.125, mcc=-0.6123724356957946,
        kappa=-0.4285714285714287, brier=0.42202, strat_brier=0.3987625, n=5, n1=4, n0=1, auc=0.25,
    )
    for name, value in want.items():
        assert r[name] == pytest.approx(value), name
    # no other label within 0.05: the observed probabilities are the labels
    assert r.rmse_cal == pytest.approx(math.sqrt(0.42202))
    assert r.pearson_cal < 0 and r.pearson_p_cal > 0.5


def test_delta_calibration_border_is_strict(spark):
    df = class_frame(spark, [0, 0, 0, 1], [0.01, 0.02, 0.48, 0.059]).withColumn("delta", F.lit(0.05))
    got = {r.prob: r.observed for r in M.observed_probability(df, ["g"]).collect()}
    assert got == pytest.approx({0.01: 1 / 3, 0.02: 1 / 3, 0.48: 0.0, 0.059: 1 / 3})


def test_band_sums_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 100, 300) / 100
    y = rng.integers(0, 2, 300)
    df = class_frame(spark, [int(v) for v in y], p).withColumn("delta", F.lit(0.05))
    got = {r.prob: r.observed for r in M.observed_probability(df, ["g"]).collect()}
    for q in set(p):
        assert got[float(q)] == pytest.approx(y[np.abs(p - q) < 0.05].mean())


def test_strict_reach_matches_float_comparison():
    import pandas as pd

    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(200), np.arange(0, 100) / 100])
    out = strict_reach.func(pd.Series(p), pd.Series(np.full(len(p), 0.05)))
    lo, hi = out["lo"].to_numpy(), out["hi"].to_numpy()
    assert (np.abs(lo - p) < 0.05).all() and (np.abs(hi - p) < 0.05).all()
    assert (np.abs(np.nextafter(lo, -1) - p) >= 0.05).all() and (np.abs(np.nextafter(hi, 2) - p) >= 0.05).all()


def test_metrics_are_missing_for_one_class_and_tiny_groups(spark):
    one = M.class_statistics(class_frame(spark, [1, 1, 1], [0.2, 0.6, 0.9]), ["g"], p_values=False).first()
    assert one.ba is None and one.mcc is None and one.auc is None and one.strat_brier is None and one.r2_cal is None
    assert one.recall_1 == pytest.approx(2 / 3) and one.brier is not None
    tiny = M.class_statistics(class_frame(spark, [1], [0.2]), ["g"], p_values=False).first()
    assert tiny.n == 1 and tiny.brier is None and tiny.recall_1 is None


def test_regression_metrics_handle_infinity_and_constants(spark):
    rows = [(1, 1.0, 1.5), (1, 2.0, float("inf")), (2, 3.0, 1.0), (2, 3.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, y double, pred double")
    got = {r.g: r for r in M.regression_fit(df, ["g"]).collect()}
    assert math.isinf(got[1].rmse) and got[1].r2 == -math.inf and got[1].pearson is None
    assert got[2].r2 is None and got[2].pearson is None
    assert got[3].pearson is None and got[3].r2 is not None


def test_ence_bins(spark):
    for n, bins in ((3, 1), (22, 1), (40, 2), (41, 2)):
        rows = [(1, i, float(i), 1.0, 0.5, i - 1.0 - i / 10, i + 1.0 + i / 10) for i in range(n)]
        df = spark.createDataFrame(rows, "g int, id int, y double, a double, pred double, lower double, upper double")
        sizes = sorted(r.n for r in M.ence_bins(df, ["g"]).collect())
        assert len(sizes) == bins and sum(sizes) == n and max(sizes) - min(sizes) <= 1
    zero = spark.createDataFrame([(1, 1, 1.0, 2.0, 2.0, 2.0), (1, 2, 1.0, 2.0, 2.0, 2.0)], "g int, id int, y double, pred double, lower double, upper double")
    assert math.isinf(M.ence(zero, ["g"]).first().ence)


def test_ence_leaves_out_bins_without_width_and_error(spark):
    exact = [(1, i, 1.0, 1.0, 1.0, 1.0) for i in range(20)]
    wide = [(1, 20 + i, 1.0, 2.0, 0.0, 4.0) for i in range(20)]
    df = spark.createDataFrame(exact + wide, "g int, id int, y double, pred double, lower double, upper double")
    assert M.ence(df, ["g"]).first().ence == pytest.approx(0.5)
    endless = [(1, 40 + i, 1.0, 1.0, -math.inf, math.inf) for i in range(20)]
    assert M.ence(df.unionByName(spark.createDataFrame(endless, df.schema)), ["g"]).first().ence is None


def test_buckets_follow_skewed_values(spark):
    values = np.exp(np.random.default_rng(1).normal(0, 4, 20_000)).tolist() + [math.inf, -math.inf]
    df = spark.createDataFrame([(None, v) for v in values], "g int, v double")
    sizes = [r["count"] for r in ordered.value_buckets(df, ["g"], "v").groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * len(values) / 1024 + 5
    placed = ordered.running_totals(df.withColumn("one", F.lit(1)), ["g"], ["v"], {"pos": "one"}).orderBy("pos").collect()
    assert [r.v for r in placed] == sorted(values) and [r.pos for r in placed] == list(range(1, len(values) + 1))


def test_upper_tail_of_the_normal(spark):
    z = [-40.0, -8.0, -3.5, -1.0, 0.0, 0.3, 1.6448536269514722, 3.4, 3.6, 6.0, 20.0, 37.0, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(scalar.normal_upper_tail("z")).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z[:-1]], rel=1e-12, abs=1e-300)


def test_row_positions_with_a_hot_value(spark):
    values = [2.0] * 60 + [1.0, 3.0, 3.0] + [0.5 * i for i in range(20)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, id int, v double")
    got = ordered.row_positions(df, ["g"], "v", "id", "pos").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, len(values) + 1)) and {r.pos_n for r in got} == {len(values)}
    assert [r.v for r in got] == sorted(values)


def test_incomplete_beta_and_correlation_tail():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    # r = 0.5, n = 12: t = 1.825742, two-tail p of Student's t with 10 degrees of freedom
    assert incomplete_beta(5.0, 0.5, 1 - 0.25) == pytest.approx(0.0979, abs=1e-4)


def test_quantiles_and_ranks_spread_over_buckets(spark):
    values = [0.5, 1.0, 98.5, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = ordered.exact_quantiles(df, [], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    assert (r.q1, r.q2, r.q3) == (0.5, 0.75, 25.375)


def test_conformal_quantile_positions(spark):
    alphas = [1, 2, 0.5, 0.6, 0.9, 1.2, 1.3, 0.2, 0.91, 0.98]
    df = spark.createDataFrame([(1, float(a)) for a in alphas], "g int, alpha double")
    got = {r.sig_level: r.alpha_s for r in I.conformal_quantiles(df, ["g"], (0.2, 0.1, 0.05, 0.0, 1.0)).collect()}
    assert got == {0.2: 1.3, 0.1: 2.0, 0.05: 2.0, 0.0: 2.0, 1.0: 0.2}


def test_conformal_intervals_widen_and_contain_their_prediction(spark):
    rng = np.random.default_rng(5)
    cal = spark.createDataFrame([(0, float(a), float(b), 1.0) for a, b in rng.normal(size=(60, 2))], "g int, y double, pred double, scale double")
    test = spark.createDataFrame([(0, i, float(i), 1.5) for i in range(5)], "g int, id int, pred double, scale double")
    out = I.icp(cal, test, ["g"], (0.1, 0.3, 0.6))
    checks = {r.sig_level: r for r in I.interval_checks(out, ["sig_level"]).collect()}
    assert all(c.reversed == 0 and c.outside == 0 for c in checks.values())
    width = {r.sig_level: r.upper - r.lower for r in out.where("id = 0").collect()}
    assert width[0.1] >= width[0.3] >= width[0.6]


def isotonic(points, x, label):
    """Pool-adjacent-violators value at x after adding (x, label)."""
    values = {}
    for s, y in points + [(x, label)]:
        n, t = values.get(s, (0, 0))
        values[s] = (n + 1, t + y)
    blocks = []
    for s in sorted(values):
        blocks.append([values[s][0], values[s][1], [s]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, t, members = blocks.pop()
            blocks[-1][0] += n
            blocks[-1][1] += t
            blocks[-1][2] += members
    return next(t / n for n, t, members in blocks if x in members)


@pytest.mark.parametrize("range_rows", [4096, 5])
def test_venn_abers_equals_isotonic_between_scores(spark, range_rows):
    rng = np.random.default_rng(6)
    scores = rng.integers(1, 40, 120) / 40
    labels = (rng.random(120) < scores).astype(int)
    cal = spark.createDataFrame([(1, float(s), int(y)) for s, y in zip(scores, labels)], "fold int, score double, y int")
    points = list(zip(scores.tolist(), labels.tolist()))
    low, high = scores.min(), scores.max()
    asked = [float(x) for x in np.arange(1, 80) / 80 + 0.001 if low < x < high]
    test = spark.createDataFrame([(1, i, x) for i, x in enumerate(asked)], "fold int, id int, score double")
    got = {r.score: (r.p0, r.p1) for r in V.venn_abers(cal, test, ["fold"], range_rows).collect()}
    for x in asked:
        assert got[x] == pytest.approx((isotonic(points, x, 0), isotonic(points, x, 1)))


def test_geometric_means_and_confidence(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4), (1, 0.4, 0.9), (2, 0.0, 0.0), (2, 0.1, 0.5)], "id int, p0 double, p1 double")
    got = {r.id: r for r in V.cvap(df, []).collect()}
    assert got[1].p1 == pytest.approx(0.6) and got[1].p0 == pytest.approx(1 - math.sqrt(0.8 * 0.6))
    assert got[2].p1 == 0.0


# --- permutation p-values -------------------------------------------------------------------------


def test_permutation_p_values(spark):
    shifts = {
        "r2": (0.82, [0.82, 0.9, 0.87, 0.83] + [0.51] * 92 + [-0.82, -0.9, -0.1, -0.2]),
        "rmse": (-0.82, [-0.82, -0.9] + [0.9] * 98),
        "pearson": (0.82, [0.82] * 50 + [0.6] * 50),
        "ece": (0.82, [0.82] * 25 + [0.6] * 75),
        "ence": (-0.82, [-0.82] * 25 + [-0.6] * 75),
        "scc": (None, [0.1] * 100),
    }
    rows = []
    for metric, (orig, rand) in shifts.items():
        rows.append((1, H.ORIGINAL, metric, orig))
        rows += [(1, i, metric, v) for i, v in enumerate(rand)]
    df = spark.createDataFrame(rows, "g int, perm int, metric string, shift double")
    got = {r.metric: r.p for r in H.shift_p_values(df, ["g"], tails=("one",)).collect()}
    assert got == pytest.approx({"r2": 0.04, "rmse": 0.02, "pearson": 0.5, "ece": 1.0, "ence": 0.25, "scc": None})


def test_p_value_aggregation(spark):
    rows = [(1, p) for p in (0.05, 0.04, 0.02, 0.01)] + [(2, p) for p in (0.6, 0.78, 0.79, 0.83)] + [(3, 0.03), (3, None)]
    df = spark.createDataFrame(rows, "g int, p double")
    got = {r.g: r.p for r in df.groupBy("g").agg(H.aggregate_p().alias("p")).collect()}
    assert got == pytest.approx({1: 0.06, 2: 1.0, 3: 0.06})


def test_false_discovery_adjustment(spark):
    rows = [(1, i, p) for i, p in enumerate((0.04, 0.001, None, 0.01))]
    df = spark.createDataFrame(rows, "family int, id int, p double")
    got = {r.id: r.p_adjusted for r in H.adjust_p_values(df, ["family"]).collect()}
    assert got[2] is None
    assert [got[i] for i in (0, 1, 3)] == pytest.approx([0.0733333, 0.0055, 0.0275], abs=1e-6)


def test_harmonic_series_joins_its_asymptote(spark):
    df = spark.createDataFrame([(3,), (10000,), (10001,)], "n bigint")
    got = [r[0] for r in df.select(H.harmonic(F.col("n"))).collect()]
    exact = [sum(1 / i for i in range(1, n + 1)) for n in (3, 10000, 10001)]
    assert got == pytest.approx(exact, rel=1e-12)


def test_value_strata_follow_inside(spark):
    one = [-12.262465184828052, -3.3635781991822906, -2.732455189245883, -0.5769849432117597, 0.9788448564114522, 1.1367136974286423, 4.429012647802734, 5.9832260159059185, 6.917764085416956, 15.954900037736373]
    two = [-19.458093636448474, -10.54941385468599, -3.865585892480138, 0.18809399784200753, 6.964780125808418, 11.056090568429347, 34.73594131857662]
    rows = [(1, v, True) for v in one] + [(1, v, False) for v in two]
    df = spark.createDataFrame(rows, "g int, y double, inside boolean")
    got = {r.y: r.stratum for r in H.value_strata(df, ["g"]).collect()}
    assert [got[v] for v in one] == [0, 1, 1, 2, 2, 2, 2, 3, 3, 4]
    assert [got[v] for v in two] == [0, 0, 1, 2, 3, 4, 4]


@pytest.mark.parametrize("method, band", [("md5", (6.0, 10.0)), ("xxhash64", (0.1, 0.1))])
def test_counted_redraws_are_those_made_row_by_row(spark, monkeypatch, method, band):
    monkeypatch.setattr(H, "BAND", band)  # the narrow one misses the end of most quotas at first
    rng = np.random.default_rng(8)
    rows = [(g, i, int(rng.random() < 0.4), float(np.round(rng.random(), 2)), bool(rng.random() < 0.6)) for g, m in ((None, 60), (1, 7), (2, 4)) for i in range(m)]
    df = spark.createDataFrame(rows, "g int, id int, y int, prob double, inside boolean").withColumn("stratum", F.col("y"))
    drawn = H.redraw(df, ["g"], 30, 5, method=method).withColumn("subset", F.when(F.col("inside"), "Inside").otherwise("Outside"))
    want = M.confusion(drawn, ["g", "perm", "subset"]).select("g", "perm", "subset", "n", "n1", "n0", "tp", "fp", "tn", "fn", F.round("brier", 9), F.round("loss_1", 9), F.round("loss_0", 9))
    got = H.permuted_confusion(df, ["g"], 30, 5, method=method)
    got = got.select("g", "perm", "subset", "n", "n1", "n0", "tp", "fp", "tn", "fn", F.round("brier", 9), F.round("loss_1", 9), F.round("loss_0", 9))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_redraws_keep_stratum_sizes_and_retry(spark):
    rows = [(1, i, i % 2, [0.2, 0.8, 0.5][i % 3], i % 2, i < 14) for i in range(24)]
    df = spark.createDataFrame(rows, "g int, id int, y int, prob double, stratum int, inside boolean")
    drawn = H.redraw(df, ["g"], 40, 1)
    counts = drawn.groupBy("perm", "stratum").agg(F.count_if("inside").alias("n"), F.count(F.lit(1)).alias("m"))
    assert {(r.n, r.m) for r in counts.collect()} == {(7, 12)}
    assert drawn.groupBy("perm").agg(F.sum(F.when(F.col("inside"), F.col("id")))).distinct().count() > 20
    # two rows inside with equal scores can never be varied: tried ten times, then kept
    flat = spark.createDataFrame([(1, i, i % 2, 0.5, i % 2, i < 2) for i in range(6)], df.schema)
    assert H.redraw(flat, ["g"], 3, 1).count() == 18


@pytest.mark.parametrize("digits", [1, 3])
def test_quota_rows_are_the_smallest_hashes(spark, digits):
    rows = [(i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id int").withColumn("_h", F.md5(F.col("id").cast("string")))
    quota = spark.createDataFrame([(0, 5), (1, 0), (2, 66)], "g int, _quota bigint")
    got = H.smallest_by_hash(df, ["g"], quota, ["g"], "id", digits).where("inside").collect()
    import hashlib

    want = set()
    for g, q in ((0, 5), (1, 0), (2, 66)):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for h, i in rows if h == g)
        want |= {i for _, i in ids[:q]}
    assert {r.id for r in got} == want


def test_working_domain_is_significant(spark):
    rows = []
    for i in range(120):
        inside = i < 60
        y = i % 2
        prob = (0.9 if y else 0.1) if inside else (0.4 + 0.002 * (i % 50) if y else 0.6 - 0.002 * (i % 50))
        rows.append((1, i, y, prob + 0.0001 * i, inside))
    df = spark.createDataFrame(rows, "g int, id int, y int, prob double, inside boolean")
    out = H.permutation_test(df, ["g"], ["ba", "auc", "strat_brier"], n=60)
    one = {r.metric: r.p for r in out.where("tail = 'one'").collect()}
    assert set(one) == {"ba", "auc", "strat_brier"} and max(one.values()) <= 0.05


def test_shift_of_two_infinities_is_missing(spark):
    inf = float("inf")
    rows = [(1, "ence", "Inside", inf), (1, "ence", "Outside", inf), (2, "ence", "Inside", 1.0), (2, "ence", "Outside", inf), (3, "ence", "Inside", 1.0)]
    df = spark.createDataFrame(rows, "g int, metric string, subset string, value double")
    got = {r.g: r.shift for r in H.shift_metrics(df, ["g"]).collect()}
    assert got == {1: None, 2: -inf, 3: None}


def test_labels(spark):
    rows = [(0.01, 0.04, 0.2, 0.2, False), (0.05, 0.06, 0.2, 0.2, False), (0.01, 0.01, 0.01, 0.02, True), (0.9, 0.9, 0.02, 0.5, True), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "one_raw double, one_adjusted double, two_raw double, two_adjusted double, wrong_sign boolean")
    assert [r[0] for r in df.select(H.significance_label()).collect()] == ["**", "*", "xx", "x", ""]


def test_gap_is_missing_when_nothing_can_win(spark):
    inf = float("inf")
    rows = [("W1", "a", "ba", 0.3), ("W1", "b", "ba", 0.1), ("W2", "a", "ba", -inf), ("W2", "b", "ba", -inf), ("W1", "a", "rmse", 1.0), ("W1", "b", "rmse", -1.0)]
    df = spark.createDataFrame(rows, "t string, m string, metric string, shift double")
    got = {(r.t, r.m, r.metric): r.gap for r in R.gap_to_best(df, ["t"]).collect()}
    assert got[("W1", "a", "ba")] == 0 and got[("W1", "b", "ba")] == pytest.approx(0.2)
    assert got[("W2", "a", "ba")] is None and got[("W1", "b", "rmse")] == 0 and got[("W1", "a", "rmse")] == 2


def test_scenario_label_round_trip(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string").select(R.scenario_label(["x", "y"]).alias("l"))
    r = df.select(*R.split_scenario("l", ["x", "y"])).first()
    assert (r.x, r.y) == ("a", "b")
    with pytest.raises(Exception, match="unexpected scenario label"):
        df.select(*R.split_scenario("l", ["x", "y", "z"])).collect()
