"""Registered queries: statistics per group of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.scalar import correlation_two_tail_p
from ..operators import metrics as M
from .registry import query
from .testbed import (
    CLASS,
    REG,
    REG_ALL,
    class_scores,
    class_subsets,
    reg_predictions,
    reg_subsets,
    with_intervals,
)

KEYS = ["endpoint", "test_set", "subset"]
K = "endpoint, test_set, subset"

CONFUSION = f"""confusion AS (
  SELECT {K}, count(*) AS n, count_if(y = 1) AS n1, count_if(y = 0) AS n0,
         count_if(y = 1 AND prob > 0.5) AS tp, count_if(y = 0 AND prob > 0.5) AS fp,
         count_if(y = 0 AND NOT prob > 0.5) AS tn, count_if(y = 1 AND NOT prob > 0.5) AS fn,
         avg((prob - y) * (prob - y)) AS brier,
         avg((prob - y) * (prob - y)) FILTER (y = 1) AS loss_1,
         avg((prob - y) * (prob - y)) FILTER (y = 0) AS loss_0
  FROM class_subsets GROUP BY {K})"""
CONF = [*CLASS, CONFUSION]

RECALL_1 = "tp::DOUBLE / nullif(tp + fn, 0)"
RECALL_0 = "tn::DOUBLE / nullif(tn + fp, 0)"
PRECISION_1 = "tp::DOUBLE / nullif(tp + fp, 0)"
PRECISION_0 = "tn::DOUBLE / nullif(tn + fn, 0)"
BA = f"({RECALL_1} + {RECALL_0}) / 2"
MCC = """CASE WHEN n1 > 0 AND n0 > 0 THEN coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) /
         nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) END"""
KAPPA = """CASE WHEN n1 > 0 AND n0 > 0 THEN
  ((tp + tn)::DOUBLE / n - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n)) /
  nullif(1 - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n), 0) END"""


def gate(expr: str) -> str:
    return f"CASE WHEN n >= 2 THEN {expr} END"


@query("g1_class_sizes", f"SELECT {K}, n, n1, n0 FROM confusion", CONF)
def g1(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, "n", "n1", "n0")


@query(
    "g2_recall_precision",
    f"""SELECT {K}, {RECALL_1} AS recall_1, {RECALL_0} AS recall_0, {PRECISION_1} AS precision_1,
        {PRECISION_0} AS precision_0 FROM confusion""",
    CONF,
    "recall_1 recall_0 precision_1 precision_0",
)
def g2(t):
    return M.confusion(class_subsets(t), KEYS).select(
        *KEYS, M.recall_1().alias("recall_1"), M.recall_0().alias("recall_0"),
        M.precision_1().alias("precision_1"), M.precision_0().alias("precision_0"),
    )


@query("g3_balanced_accuracy", f"SELECT {K}, {BA} AS ba FROM confusion", CONF, "ba")
def g3(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, M.balanced_accuracy().alias("ba"))


@query("g4_mcc", f"SELECT {K}, {MCC} AS mcc FROM confusion", CONF, "mcc")
def g4(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, M.mcc().alias("mcc"))


AUC_CTE = f"""auc AS (
  SELECT {K}, (sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) /
         nullif(count_if(y = 1)::DOUBLE * count_if(y = 0), 0) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY prob) +
               (count(*) OVER (PARTITION BY {K}, prob) - 1) / 2.0::DOUBLE AS rk FROM class_subsets) AS r
  GROUP BY {K})"""


@query("g5_auc", f"SELECT {K}, auc FROM auc", [*CLASS, AUC_CTE], "auc")
def g5(t):
    return M.auc(class_subsets(t), KEYS)


# three ordered classes of the event value: below 20, below 80, the rest; probabilities from k
THREE = """three AS (
  SELECT endpoint, test_set, fold,
         CASE WHEN value < 20 THEN 0 WHEN value < 80 THEN 1 ELSE 2 END AS label,
         CASE WHEN k + value < 55 THEN 0 WHEN k + value < 140 THEN 1 ELSE 2 END AS predicted,
         list_transform([20.0::DOUBLE / (20 + value + k), value / (20 + value + k), k / (20.0::DOUBLE + value + k)],
                        lambda p: p * (0.99::DOUBLE + (k % 3) * 0.01::DOUBLE)) AS probs
  FROM events_base)"""


def three_classes(t):
    from .testbed import events_base

    v, k = F.col("value"), F.col("k")
    total = F.lit(20.0) + v + k
    return events_base(t).select(
        "endpoint", "test_set", "fold",
        F.when(v < 20, 0).when(v < 80, 1).otherwise(2).alias("label"),
        F.when(k + v < 55, 0).when(k + v < 140, 1).otherwise(2).alias("predicted"),
        # sums of 0.99, 1 and 1.01: within the tolerance, but ranks change by dividing by them
        F.transform(F.array(20.0 / total, v / total, k / total), lambda p: p * (F.lit(0.99) + (k % 3) * 0.01)).alias("probs"),
    )


@query(
    "g5_pairwise_auc",
    """SELECT endpoint, avg(auc) AS auc FROM (
         SELECT endpoint, a, b, (sum(rk) FILTER (hit) - count_if(hit) * (count_if(hit) + 1) / 2.0::DOUBLE) /
                (count_if(hit)::DOUBLE * count_if(NOT hit)) AS auc
         FROM (SELECT *, rank() OVER (PARTITION BY endpoint, a, b ORDER BY s) +
                      (count(*) OVER (PARTITION BY endpoint, a, b, s) - 1) / 2.0::DOUBLE AS rk
               FROM (SELECT endpoint, a, b, label = a AS hit, probs[a + 1] / list_sum(probs) AS s
                     FROM three, (VALUES (0,1),(1,0),(0,2),(2,0),(1,2),(2,1)) AS p(a, b)
                     WHERE label IN (a, b)) AS x) AS y
         GROUP BY endpoint, a, b) AS z GROUP BY endpoint""",
    [CLASS[0], THREE],
    "auc",
)
def g5b(t):
    return M.pairwise_auc(three_classes(t), ["endpoint"], [0, 1, 2])


@query("g6_kappa", f"SELECT {K}, {KAPPA} AS kappa FROM confusion", CONF, "kappa")
def g6(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, M.kappa().alias("kappa"))


@query(
    "g6_weighted_kappa",
    """SELECT endpoint, test_set, (agree - chance) / (1 - chance) AS kappa FROM (
         SELECT m.endpoint, m.test_set, m.agree, sum(po.c::DOUBLE * pp.c * (1 - abs(po.label - pp.predicted) / 2.0::DOUBLE)) / (any_value(m.n)::DOUBLE * any_value(m.n)) AS chance
         FROM (SELECT endpoint, test_set, count(*) AS n, avg(1 - abs(label - predicted) / 2.0::DOUBLE) AS agree FROM three GROUP BY 1, 2) m
         JOIN (SELECT endpoint, test_set, label, count(*) AS c FROM three GROUP BY 1, 2, 3) po USING (endpoint, test_set)
         JOIN (SELECT endpoint, test_set, predicted, count(*) AS c FROM three GROUP BY 1, 2, 3) pp USING (endpoint, test_set)
         GROUP BY 1, 2, 3) AS x""",
    [CLASS[0], THREE],
    "kappa",
)
def g6b(t):
    return M.weighted_kappa(three_classes(t), ["endpoint", "test_set"], "label", "predicted", 3)


@query("g7_brier", f"SELECT {K}, brier FROM confusion", CONF, "brier")
def g7(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, "brier")


@query(
    "g8_one_hot_brier",
    """SELECT endpoint, test_set, avg(pow(probs[1] - (label = 0)::INT, 2) + pow(probs[2] - (label = 1)::INT, 2)
                                       + pow(probs[3] - (label = 2)::INT, 2)) AS brier
       FROM three GROUP BY 1, 2""",
    [CLASS[0], THREE],
    "brier",
)
def g8(t):
    return three_classes(t).groupBy("endpoint", "test_set").agg(F.avg(M.one_hot_brier(M.checked_probabilities("probs"), "label")).alias("brier"))


@query(
    "g9_log_loss",
    """SELECT endpoint, test_set, avg(-ln(probs[label + 1] + 1e-15)) AS log_loss,
              avg(-(1 - abs(0 - label) / 2.0::DOUBLE) * ln(probs[1] + 1e-15) - (1 - abs(1 - label) / 2.0::DOUBLE) * ln(probs[2] + 1e-15)
                  - (1 - abs(2 - label) / 2.0::DOUBLE) * ln(probs[3] + 1e-15)) AS ordinal_log_loss
       FROM three GROUP BY 1, 2""",
    [CLASS[0], THREE],
    "log_loss ordinal_log_loss",
)
def g9(t):
    return three_classes(t).groupBy("endpoint", "test_set").agg(
        F.avg(M.log_loss(M.checked_probabilities("probs"), "label", 3)).alias("log_loss"),
        F.avg(M.log_loss("probs", "label", 3, ordinal=True)).alias("ordinal_log_loss"),
    )


@query(
    "g8_probability_sums",
    """SELECT endpoint, count(*) AS n, count_if(abs(list_sum(probs) * (1 + fold * 0.01::DOUBLE) - 1) > 0.02::DOUBLE) AS beyond FROM three GROUP BY 1""",
    [CLASS[0], THREE],
)
def g8s(t):
    """Rows whose probabilities, blown up by the fold, no longer pass the check of their sum."""
    off = F.abs(M.probability_sum("probs") * (1 + F.col("fold") * 0.01) - 1) > 0.02
    return three_classes(t).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("beyond"))


@query("g10_stratified_brier", f"SELECT {K}, (loss_1 + loss_0) / 2 AS strat_brier FROM confusion", CONF, "strat_brier")
def g10(t):
    return M.confusion(class_subsets(t), KEYS).select(*KEYS, M.stratified_brier().alias("strat_brier"))


@query(
    "g10_stratified_loss",
    """SELECT endpoint, test_set, CASE WHEN count(*) = 3 THEN avg(l) END AS loss FROM (
         SELECT endpoint, test_set, label, avg(-ln(probs[label + 1] + 1e-15)) AS l FROM three GROUP BY 1, 2, 3) AS x
       GROUP BY 1, 2""",
    [CLASS[0], THREE],
    "loss",
)
def g10b(t):
    return M.stratified_loss(three_classes(t), ["endpoint", "test_set"], M.log_loss("probs", "label", 3), "label", 3)


def observed_cte(deltas: str) -> str:
    return f"""observed AS (
  SELECT a.{K.replace(', ', ', a.')}, d.delta, a.prob, a.c, sum(b.ones)::DOUBLE / sum(b.c) AS obs
  FROM (SELECT {K}, prob, count(*) AS c, sum(y) AS ones FROM class_subsets GROUP BY ALL) a,
       (SELECT unnest({deltas}::DOUBLE[]) AS delta) d,
       (SELECT {K}, prob, count(*) AS c, sum(y) AS ones FROM class_subsets GROUP BY ALL) b
  WHERE a.endpoint = b.endpoint AND a.test_set = b.test_set AND a.subset = b.subset AND abs(b.prob - a.prob) < d.delta
  GROUP BY ALL)"""


def fit_cte(keys: str) -> str:
    return f"""expanded AS (SELECT *, unnest(range(c)) AS copy FROM observed),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY obs) + (count(*) OVER (PARTITION BY {keys}, obs) - 1) / 2.0::DOUBLE AS ro,
         rank() OVER (PARTITION BY {keys} ORDER BY prob) + (count(*) OVER (PARTITION BY {keys}, prob) - 1) / 2.0::DOUBLE AS rp
  FROM expanded),
fit AS (
  SELECT {keys}, count(*) AS n, sqrt(avg((obs - prob) * (obs - prob))) AS rmse, avg(abs(obs - prob)) AS mad,
         CASE WHEN max(obs) > min(obs) THEN 1 - avg((obs - prob) * (obs - prob)) / var_pop(obs) END AS r2,
         CASE WHEN max(obs) > min(obs) AND max(prob) > min(prob) THEN corr(obs, prob) END AS pearson,
         CASE WHEN max(obs) > min(obs) AND max(prob) > min(prob) THEN corr(ro, rp) END AS spearman
  FROM ranked GROUP BY {keys})"""


KD = f"{K}, delta"
OBSERVED = observed_cte("[0.05]")
FIT = fit_cte(KD)


@query("g11_observed_probability", f"SELECT {KD}, prob, c AS rows, obs AS observed FROM observed", [*CLASS, OBSERVED], "prob observed delta")
def g11(t):
    return M.observed_probability(class_subsets(t).withColumn("delta", F.lit(0.05)), KEYS)


FIT_COLS = "rmse mad r2 pearson spearman"


@query(
    "g12_calibration_statistics",
    f"SELECT {K}, n, rmse, mad, r2, pearson, spearman FROM fit",
    [*CLASS, OBSERVED, FIT],
    FIT_COLS,
)
def g12(t):
    return M.calibration(class_subsets(t), KEYS, p_values=False).drop("delta")


@query("g12_calibration_p_values")
def g12p(t):
    return M.calibration(class_subsets(t), KEYS)


@query(
    "g28_delta_sweep",
    f"SELECT {KD}, n, rmse, mad, r2, pearson, spearman FROM fit",
    [*CLASS, observed_cte("[0.05, 0.2]"), FIT],
    FIT_COLS + " delta",
)
def g28(t):
    return M.calibration(class_subsets(t), KEYS, (0.05, 0.2), p_values=False)


REG_FIT = f"""reg_fit AS (
  SELECT {K}, count(*) AS n, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(abs(pred - y)) AS mad,
         1 - avg((pred - y) * (pred - y)) / nullif(var_pop(y), 0) AS r2,
         CASE WHEN max(y) > min(y) AND max(pred) > min(pred) THEN corr(y, pred) END AS pearson
  FROM reg_subsets GROUP BY {K})"""


@query("g13_rmse_mad", f"SELECT {K}, n, rmse, mad FROM reg_fit", [*REG, REG_FIT], "rmse mad")
def g13(t):
    return M.regression_fit(reg_subsets(t), KEYS).select(*KEYS, "n", "rmse", "mad")


@query("g14_r2", f"SELECT {K}, r2 FROM reg_fit", [*REG, REG_FIT], "r2")
def g14(t):
    return M.regression_fit(reg_subsets(t), KEYS).select(*KEYS, "r2")


@query("g15_pearson", f"SELECT {K}, pearson FROM reg_fit", [*REG, REG_FIT], "pearson")
def g15(t):
    return M.regression_fit(reg_subsets(t), KEYS).select(*KEYS, "pearson")


def avg_rank(col: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {col}) + (count(*) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0::DOUBLE"


SPEARMAN = f"""spearman AS (
  SELECT {K}, CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) END AS spearman
  FROM (SELECT {K}, {avg_rank('y', K)} AS ry, {avg_rank('pred', K)} AS rx FROM reg_subsets) AS r GROUP BY {K})"""


@query("g16_spearman", f"SELECT {K}, spearman FROM spearman", [*REG, SPEARMAN], "spearman")
def g16(t):
    return ordered.spearman(reg_subsets(t), KEYS, "pred", "y", "spearman")


@query("g17_one_tail_p_values")
def g17(t):
    stats = M.regression_fit(reg_subsets(t), [*KEYS, "fold"])
    out = M.with_correlation_p(stats, "pearson").withColumnRenamed("pearson_p", "p_greater")
    out = M.with_correlation_p(out, "pearson", "less").withColumnRenamed("pearson_p", "p_less")
    return out.withColumn("p_different", correlation_two_tail_p(F.col("pearson"), F.col("n").cast("double")))


@query("g18_residuals", "SELECT id, endpoint, fold, abs(y - pred) AS residual FROM reg_predictions", REG[:1], "residual")
def g18(t):
    return reg_predictions(t).select("id", "endpoint", "fold", M.residual().alias("residual"))


LEVEL_STATS = f"""level_stats AS (
  SELECT {K}, sig_level, avg((y < lower OR y > upper)::INT) AS error_rate,
         1 - avg((y < lower OR y > upper)::INT) AS validity, avg(upper - lower) AS efficiency
  FROM reg_intervals GROUP BY {K}, sig_level)"""


@query(
    "g19_interval_statistics",
    f"SELECT {K}, sig_level, error_rate, validity, efficiency FROM level_stats",
    [*REG_ALL, LEVEL_STATS],
    "sig_level error_rate validity efficiency",
)
def g19(t):
    return M.interval_statistics(with_intervals(reg_subsets(t)), KEYS)


ECE = f"ece AS (SELECT {K}, avg(abs(error_rate - sig_level)) AS ece FROM level_stats GROUP BY {K})"


@query("g20_expected_calibration_error", f"SELECT {K}, ece FROM ece", [*REG_ALL, LEVEL_STATS, ECE], "ece")
def g20(t):
    return M.expected_calibration_error(with_intervals(reg_subsets(t)), KEYS)


@query(
    "g21_estimated_variance",
    "SELECT id, fold, pow((upper - lower) / 2, 2) AS variance FROM reg_intervals WHERE sig_level = 0.32::DOUBLE AND subset = 'All'",
    REG_ALL,
    "variance",
)
def g21(t):
    return with_intervals(reg_predictions(t), (0.32,)).select("id", "fold", M.estimated_variance().alias("variance"))


ENCE = f"""ence_bins AS (
  SELECT {K}, bin, count(*) AS n, sqrt(avg(err * err)) AS rmse, sqrt(avg(var)) AS rmv
  FROM (SELECT *, CASE WHEN pos < extra * (size + 1) THEN pos // (size + 1) ELSE extra + (pos - extra * (size + 1)) // size END AS bin
        FROM (SELECT *, n // b AS size, n % b AS extra
              FROM (SELECT *, greatest(n // 20, 1) AS b FROM (
                SELECT {K}, pred - y AS err, pow((upper - lower) / 2, 2) AS var,
                       row_number() OVER (PARTITION BY {K} ORDER BY pow((upper - lower) / 2, 2), md5(id), id) - 1 AS pos,
                       count(*) OVER (PARTITION BY {K}) AS n
                FROM reg_intervals WHERE sig_level = 0.32::DOUBLE) AS a) AS b) AS c) AS d
  GROUP BY {K}, bin),
ence AS (SELECT {K}, avg(abs(rmse - rmv) / rmv) AS ence FROM ence_bins GROUP BY {K})"""


@query("g22_ence_bins", f"SELECT {K}, bin, n, rmse, rmv FROM ence_bins", [*REG_ALL, ENCE], "rmse rmv")
def g22b(t):
    return M.ence_bins(with_intervals(reg_subsets(t), (0.32,)), KEYS)


@query("g22_ence", f"SELECT {K}, ence FROM ence", [*REG_ALL, ENCE], "ence")
def g22(t):
    return M.ence(with_intervals(reg_subsets(t), (0.32,)), KEYS)


SCC = f"""scc AS (
  SELECT {K}, CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) END AS scc
  FROM (SELECT {K}, {avg_rank('upper - lower', K)} AS rx, {avg_rank('abs(y - pred)', K)} AS ry
        FROM reg_intervals WHERE sig_level = 0.32::DOUBLE) AS r GROUP BY {K})"""


@query("g23_width_residual_spearman", f"SELECT {K}, scc FROM scc", [*REG_ALL, SCC], "scc")
def g23(t):
    return M.width_residual_spearman(with_intervals(reg_subsets(t), (0.32,)), KEYS)


CLASS_ROW_CTES = [*CONF, AUC_CTE, OBSERVED, FIT]
CLASS_ROW = f"""SELECT c.{K.replace(', ', ', c.')}, c.n, c.n1, c.n0,
  {PRECISION_1} AS precision_1, {PRECISION_0} AS precision_0, {RECALL_1} AS recall_1, {RECALL_0} AS recall_0,
  {BA} AS ba, {MCC.replace('n1', 'c.n1').replace('n0', 'c.n0')} AS mcc, {KAPPA.replace(' n)', ' c.n)').replace('n::', 'c.n::').replace('/ n ', '/ c.n ').replace('* n)', '* c.n)')} AS kappa,
  brier, (loss_1 + loss_0) / 2 AS strat_brier, auc, f.rmse AS rmse_cal, f.mad AS mad_cal, f.r2 AS r2_cal,
  f.pearson AS pearson_cal, f.spearman AS spearman_cal
  FROM confusion c JOIN auc USING ({K}) JOIN fit f USING ({K})"""
CLASS_ROW_DOUBLES = "precision_1 precision_0 recall_1 recall_0 ba mcc kappa brier strat_brier auc rmse_cal mad_cal r2_cal pearson_cal spearman_cal"


@query("g24_classification_row", CLASS_ROW, CLASS_ROW_CTES, CLASS_ROW_DOUBLES)
def g24(t):
    return M.class_statistics(class_subsets(t), KEYS, p_values=False)


REG_ROW_CTES = [*REG_ALL, REG_FIT, SPEARMAN, LEVEL_STATS, ECE, ENCE, SCC]


@query(
    "g24_regression_row",
    f"""SELECT {K}, n, rmse, mad, r2, pearson, spearman, error_rate, validity, efficiency, ece, ence, scc
        FROM reg_fit JOIN spearman USING ({K}) JOIN (SELECT * FROM level_stats WHERE sig_level = 0.32::DOUBLE) l USING ({K})
        JOIN ece USING ({K}) JOIN ence USING ({K}) JOIN scc USING ({K})""",
    REG_ROW_CTES,
    "rmse mad r2 pearson spearman error_rate validity efficiency ece ence scc",
)
def g24r(t):
    return M.regression_statistics(with_intervals(reg_subsets(t)), KEYS, p_values=False)


@query(
    "g25_mean_sd_over_folds",
    """SELECT endpoint, subset, avg(ba) AS ba_mean, stddev_samp(ba) AS ba_sd, avg(brier) AS brier_mean, stddev_samp(brier) AS brier_sd
       FROM (SELECT endpoint, fold, subset, (avg((prob > 0.5)::INT) FILTER (y = 1) + avg((NOT prob > 0.5)::INT) FILTER (y = 0)) / 2 AS ba,
                    avg((prob - y) * (prob - y)) AS brier
             FROM class_subsets GROUP BY 1, 2, 3) AS x GROUP BY 1, 2""",
    CLASS,
    "ba_mean ba_sd brier_mean brier_sd",
)
def g25(t):
    per_fold = M.confusion(class_subsets(t), ["endpoint", "fold", "subset"]).withColumn("ba", M.balanced_accuracy())
    return M.mean_and_deviation(per_fold, ["endpoint", "subset"], ["ba", "brier"])


@query(
    "g26_class_summary",
    "SELECT endpoint, test_set, count(*) AS n, count_if(y = 1) AS actives, count_if(y = 0) AS inactives FROM class_scores GROUP BY 1, 2",
    CLASS[:2],
)
def g26(t):
    return M.class_summary(class_scores(t), ["endpoint", "test_set"])


@query(
    "g26_activity_summary",
    """SELECT endpoint, test_set, count(*) AS n, min(y) AS min, max(y) AS max, median(y) AS median, avg(y) AS mean,
              stddev_pop(y) AS sd FROM reg_predictions GROUP BY 1, 2""",
    REG[:1],
    "min max median mean sd",
)
def g26r(t):
    return M.activity_summary(reg_predictions(t), ["endpoint", "test_set"], "y")


@query(
    "g27_activity_per_fold_and_merged",
    """SELECT endpoint, test_set, coalesce(CAST(fold AS VARCHAR), 'merged') AS fold, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd
       FROM reg_predictions GROUP BY GROUPING SETS ((endpoint, test_set, fold), (endpoint, test_set))""",
    REG[:1],
    "mean sd",
)
def g27(t):
    return M.fold_and_merged_distribution(reg_predictions(t), ["endpoint", "test_set"], "fold", "y").drop("label")
