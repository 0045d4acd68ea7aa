"""Registered queries: shift-metrics, permutation tests and false-discovery adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import redraws as R, shift as H
from .registry import query
from .statistics import BA, CONFUSION, KAPPA, MCC, gate
from .testbed import CLASS, EVENT_PREDICTIONS, EVENTS_BASE, REG, class_scores, event_predictions, reg_predictions, with_intervals

GROUP = ["endpoint", "fold"]
PERMS = 1000
SEED = 42

# --- SQL twin of the redraws: attempt 0 suffices because every group has varied scores ----------------

DRAWN = f"""drawn AS MATERIALIZED (
  SELECT endpoint, fold, perm, id, y, prob, rn <= q AS inside FROM (
    SELECT c.*, p.perm, quota.q, row_number() OVER (PARTITION BY c.endpoint, c.fold, p.perm, c.y
             ORDER BY md5(concat_ws('|', c.id, c.endpoint, c.fold, p.perm, {SEED}, 0)), c.id) AS rn
    FROM class_scores c JOIN (SELECT endpoint, fold, y, count_if(inside) AS q FROM class_scores GROUP BY ALL) quota
           ON quota.endpoint = c.endpoint AND quota.fold = c.fold AND quota.y = c.y,
         (SELECT unnest(range({PERMS})) AS perm) p) AS r)"""
BOTH = """class_subsets AS (
  SELECT endpoint, fold, -1 AS perm, id, y, prob, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END AS subset FROM class_scores
  UNION ALL SELECT endpoint, fold, perm, id, y, prob, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END FROM drawn)"""
KP = "endpoint, fold, perm, subset"
PERM_CONFUSION = CONFUSION.replace("endpoint, test_set, subset", KP).replace("confusion AS (", "confusion AS MATERIALIZED (")
VALUES = f"""vals AS (
  SELECT {KP}, unnest(['ba', 'mcc', 'kappa', 'strat_brier']) AS metric,
         unnest([{gate(BA)}, {gate(MCC)}, {gate(KAPPA)}, {gate('(loss_1 + loss_0) / 2')}]) AS value FROM confusion)"""
SHIFTS = """shifts AS (
  SELECT endpoint, fold, perm, metric, max(value) FILTER (subset = 'Inside') - max(value) FILTER (subset = 'Outside') AS shift
  FROM vals GROUP BY ALL)"""
SIGN = "CASE WHEN metric IN ('strat_brier', 'rmse_cal', 'rmse', 'efficiency', 'ence', 'ece') THEN -1 ELSE 1 END"
P_VALUES = f"""pvals AS MATERIALIZED (
  SELECT o.endpoint, o.fold, o.metric, t.tail, any_value(o.shift) AS shift,
         avg(CASE WHEN t.tail = 'one' THEN (r.shift * {SIGN.replace('metric', 'o.metric')} >= o.shift * {SIGN.replace('metric', 'o.metric')})::INT
                  ELSE (abs(r.shift) >= abs(o.shift))::INT END) FILTER (r.shift IS NOT NULL) AS p
  FROM shifts o JOIN shifts r ON r.endpoint = o.endpoint AND r.fold = o.fold AND r.metric = o.metric AND r.perm >= 0,
       (VALUES ('one'), ('two')) AS t(tail)
  WHERE o.perm = -1 GROUP BY o.endpoint, o.fold, o.metric, t.tail)"""
PERM = [*CLASS[:2], DRAWN, BOTH, PERM_CONFUSION, VALUES, SHIFTS, P_VALUES]
FAMILY = f"""family AS (
  SELECT *, CASE WHEN tail = 'one' THEN average_shift * {SIGN} <= 0 END AS wrong_sign FROM (
    SELECT endpoint, metric, tail, least(1.0::DOUBLE, 2 * avg(p)) AS p, avg(shift) AS average_shift,
           string_agg(printf('%.6f', p), ';' ORDER BY fold) AS all_p, string_agg(printf('%.6f', shift), ';' ORDER BY fold) AS all_shifts
    FROM pvals GROUP BY 1, 2, 3) AS f)"""
ADJUSTED = """adjusted AS (
  SELECT f.*, least(1.0::DOUBLE, min(q) OVER (PARTITION BY tail ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM (
    SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)) / cume AS q FROM (
      SELECT *, count(*) OVER (PARTITION BY tail) AS m, count(*) OVER (PARTITION BY tail ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume
      FROM family) AS g) AS f)"""
SIDE = """side AS (
  SELECT endpoint, metric, max(p) FILTER (tail = 'one') AS one_raw, max(p_adjusted) FILTER (tail = 'one') AS one_adjusted,
         max(p) FILTER (tail = 'two') AS two_raw, max(p_adjusted) FILTER (tail = 'two') AS two_adjusted,
         bool_or(wrong_sign) AS wrong_sign, max(average_shift) AS average_shift FROM adjusted GROUP BY 1, 2)"""
LABEL = """CASE WHEN NOT wrong_sign AND round(one_raw, 2) <= 0.05 AND round(one_adjusted, 2) <= 0.05 THEN '**'
     WHEN NOT wrong_sign AND round(one_raw, 2) <= 0.05 THEN '*'
     WHEN wrong_sign AND round(two_raw, 2) <= 0.05 AND round(two_adjusted, 2) <= 0.05 THEN 'xx'
     WHEN wrong_sign AND round(two_raw, 2) <= 0.05 THEN 'x' ELSE '' END"""
ALL = [*PERM, FAMILY, ADJUSTED, SIDE]


def strata_rows(t):
    return class_scores(t).select(*GROUP, "id", "y", "prob", "inside").withColumn("stratum", F.col("y"))


def perm_shifts(t):
    return H.permuted_shifts(class_scores(t), GROUP, list(H.COUNT_METRICS), PERMS, SEED, method="md5")


def family(t):
    return H.family_p_values(H.shift_p_values(perm_shifts(t), GROUP), ["endpoint"], ["fold"])


def side_by_side(t):
    return H.tails_side_by_side(H.adjust_p_values(family(t), ["tail"]), ["endpoint"])


@query("h1_merged_subsets", "SELECT id, endpoint, inside FROM class_scores", CLASS[:2])
def h1(t):
    rows = class_scores(t).select("id", "endpoint", "inside")
    return H.merge_subsets(rows.where("inside").drop("inside"), rows.where("NOT inside").drop("inside"))


STRATA = """strata AS (
  SELECT r.*, CASE WHEN hi > lo THEN least(greatest(floor((y - lo) / ((hi - lo) / b)), 0), b - 1) ELSE 0 END::INT AS stratum
  FROM reg_predictions r JOIN (SELECT endpoint, fold, min(y) FILTER (inside) AS lo, max(y) FILTER (inside) AS hi,
    greatest(2, least(5, count(DISTINCT y) FILTER (inside))) AS b FROM reg_predictions GROUP BY 1, 2) s ON s.endpoint = r.endpoint AND s.fold = r.fold)"""


@query("h2_value_strata", "SELECT endpoint, fold, stratum, inside, count(*) AS n FROM strata GROUP BY ALL", [REG[0], STRATA])
def h2(t):
    strata = H.value_strata(reg_predictions(t), GROUP)
    return strata.groupBy(*GROUP, "stratum", "inside").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h3_redraws",
    "SELECT endpoint, fold, perm::INT AS perm, y, count_if(inside) AS n_inside, sum(id) FILTER (inside)::BIGINT AS checksum FROM drawn GROUP BY ALL",
    [*CLASS[:2], DRAWN],
)
def h3(t):
    drawn = H.redraw(strata_rows(t), GROUP, PERMS, SEED, method="md5")
    inside = F.when(F.col("inside"), F.col("id"))
    return drawn.groupBy(*GROUP, "perm", "y").agg(F.count_if("inside").alias("n_inside"), F.sum(inside).alias("checksum"))


@query("h4_metrics_per_redraw", f"SELECT {KP.replace('perm', 'perm::INT AS perm')}, metric, value FROM vals", PERM[:-2], "value")
def h4(t):
    return H.metrics_per_redraw(class_scores(t), GROUP, list(H.COUNT_METRICS), PERMS, SEED, method="md5")


@query("h5_shift_metrics", "SELECT endpoint, fold, perm::INT AS perm, metric, shift FROM shifts", PERM[:-1], "shift")
def h5(t):
    return perm_shifts(t)


@query(
    "h6_not_computable",
    """SELECT endpoint, fold, subset, metric FROM (
         SELECT endpoint, fold, subset, unnest(['ba', 'recall_1', 'precision_1']) AS metric,
                unnest([n < 2 OR n1 = 0 OR n0 = 0, n < 2 OR n1 = 0, n < 2 OR tp + fp = 0]) AS out FROM confusion) AS x WHERE out""",
    [*CLASS[:2], "class_subsets AS (SELECT endpoint, test_set || '/' || (id % 40) AS fold, 0 AS perm, id, y, prob, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END AS subset FROM class_scores)", PERM_CONFUSION],
)
def h6(t):
    small = F.concat_ws("/", "test_set", (F.col("id") % 40).cast("string")).alias("fold")
    subset = F.when(F.col("inside"), "Inside").otherwise("Outside").alias("subset")
    rows = class_scores(t).select("endpoint", small, "id", "y", "prob", subset)
    flags = H.class_rule_flags(rows, ["endpoint", "fold", "subset"])
    return H.not_computable(flags, ["endpoint", "fold", "subset"], ["ba", "recall_1", "precision_1"]).drop("reasons")


@query("h7_p_values", "SELECT endpoint, fold, metric, tail, shift, p FROM pvals", PERM, "shift p")
def h7(t):
    return H.shift_p_values(perm_shifts(t), GROUP)


@query(
    "h8_redraw_limits",
    "SELECT endpoint, fold, metric, quantile_cont(shift, 0.05::DOUBLE) AS low, quantile_cont(shift, 0.95::DOUBLE) AS high FROM shifts WHERE perm >= 0 GROUP BY ALL",
    PERM[:-1],
    "low high",
)
def h8(t):
    return H.redraw_limits(perm_shifts(t), GROUP)


@query("h9_aggregated_p_values", "SELECT endpoint, metric, tail, p FROM family", [*PERM, FAMILY], "p")
def h9(t):
    return family(t).select("endpoint", "metric", "tail", "p")


@query(
    "h10_average_shift_and_sign",
    "SELECT endpoint, metric, tail, average_shift, all_p, all_shifts, wrong_sign FROM family",
    [*PERM, FAMILY],
    "average_shift",
)
def h10(t):
    return family(t).drop("p")


@query("h12_adjusted_p_values", "SELECT endpoint, metric, tail, p, p_adjusted FROM adjusted", [*PERM, FAMILY, ADJUSTED], "p p_adjusted")
def h12(t):
    return H.adjust_p_values(family(t), ["tail"]).select("endpoint", "metric", "tail", "p", "p_adjusted")


@query(
    "h13_global_adjustment",
    """SELECT endpoint, fold, metric, tail, p, least(1.0::DOUBLE, min(q) OVER (PARTITION BY tail ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted
       FROM (SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)) / cume AS q FROM (
         SELECT *, count(*) OVER (PARTITION BY tail) AS m, count(*) OVER (PARTITION BY tail ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume
         FROM pvals) AS g) AS f""",
    PERM,
    "p p_adjusted",
)
def h13(t):
    return H.adjust_p_values(H.shift_p_values(perm_shifts(t), GROUP), ["tail"]).select(*GROUP, "metric", "tail", "p", "p_adjusted")


@query("d6_tails_side_by_side", "SELECT endpoint, metric, one_raw, one_adjusted, two_raw, two_adjusted, wrong_sign, average_shift FROM side", ALL, "one_raw one_adjusted two_raw two_adjusted average_shift")
def d6(t):
    return side_by_side(t)


@query(
    "h14_significance_counts",
    """SELECT endpoint, count(*) AS n, count_if(round(two_adjusted, 2) <= 0.05) AS two_tail_significant,
              count_if(round(two_adjusted, 2) <= 0.05 AND wrong_sign) AS two_tail_significant_wrong_sign,
              count_if(round(one_adjusted, 2) <= 0.05 AND NOT wrong_sign) AS one_tail_significant_right_sign FROM side GROUP BY 1""",
    ALL,
)
def h14(t):
    return H.significance_counts(side_by_side(t), ["endpoint"])


@query("h15_significance_labels", f"SELECT endpoint, metric, {LABEL} AS label FROM side", ALL)
def h15(t):
    return side_by_side(t).select("endpoint", "metric", H.significance_label().alias("label"))


@query(
    "h16_complete_subsets",
    """SELECT endpoint, fold, hour, 'Inside' AS subset, count_if(inside) AS n FROM hours GROUP BY ALL
       UNION ALL SELECT endpoint, fold, hour, 'Outside', count_if(NOT inside) FROM hours GROUP BY ALL""",
    [*CLASS[:2], "hours AS (SELECT c.endpoint, c.fold, hour(e.ts)::INT AS hour, c.inside FROM class_scores c JOIN events e ON e.event_id = c.id)"],
)
def h16(t):
    hours = t.events.select(F.col("event_id").alias("id"), F.hour("ts").alias("hour"))
    return H.complete_subsets(class_scores(t).join(hours, "id"), ["endpoint", "fold", "hour"])


# --- SQL twins of the remixed redraws ------------------------------------------------------------------


def remixed(source: str, stratum: str) -> list[str]:
    """CTEs that make all redraws of (id, endpoint, fold, inside, ...) row by row: ``redrawn`` adds perm and the new side."""
    p = R.PRIME
    part = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    return [
        f"""parted AS (
  SELECT * EXCLUDE (h), {part(0)} % {p - 1} + 1 AS ka, {part(1)} % {p} AS kb, {part(2)} % {p} AS kc
  FROM (SELECT *, md5(concat_ws('|', id, endpoint, fold, {SEED})) AS h FROM {source}) AS x)""",
        f"""redrawn AS MATERIALIZED (
  SELECT * EXCLUDE (rn, q, ka, kb, kc, inside), CASE WHEN rn <= q THEN 'Inside' ELSE 'Outside' END AS subset FROM (
    SELECT c.*, p.perm, quota.q, row_number() OVER (PARTITION BY c.endpoint, c.fold, p.perm, c.{stratum} ORDER BY {R.key_sql('ka', 'kb', 'kc', 'p.perm')}) AS rn
    FROM parted c JOIN (SELECT endpoint, fold, {stratum}, count_if(inside) AS q FROM parted GROUP BY ALL) quota
           ON quota.endpoint = c.endpoint AND quota.fold = c.fold AND quota.{stratum} = c.{stratum},
         (SELECT unnest(range({PERMS}::BIGINT)) AS perm) p) AS r
  UNION ALL BY NAME SELECT * EXCLUDE (ka, kb, kc, inside), -1 AS perm, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END AS subset FROM parted)""",
    ]


AUC_SHIFTS = """areas AS (
  SELECT endpoint, fold, perm, subset, sum(p * below) / (sum(p)::DOUBLE * sum(q)::DOUBLE) AS value FROM (
    SELECT *, sum(q) OVER (PARTITION BY endpoint, fold, perm, subset ORDER BY prob) - q / 2.0::DOUBLE AS below FROM (
      SELECT endpoint, fold, perm, subset, prob, count_if(y = 1) AS p, count_if(y = 0) AS q FROM redrawn GROUP BY ALL) AS g) AS w
  GROUP BY ALL),
shifts AS (
  SELECT endpoint, fold, perm, 'auc' AS metric, max(value) FILTER (subset = 'Inside') - max(value) FILTER (subset = 'Outside') AS shift
  FROM areas GROUP BY ALL)"""


@query(
    "h7_auc_p_values",
    "SELECT endpoint, fold, metric, tail, shift, p FROM pvals",
    [*CLASS[:2], *remixed("(SELECT id, endpoint, fold, y, prob, inside FROM class_scores)", "y"), AUC_SHIFTS, P_VALUES],
    "shift p",
)
def h7_auc(t):
    """AUC of 1,000 redraws, by prefix totals in score order."""
    return H.permutation_test(class_scores(t), GROUP, ["auc"], n=PERMS, seed=SEED)


#: Ten levels, in elevenths but for that of the statistics, so that no mean ends on a half of the last printed digit.
LEVELS = (0.32, *(i / 11 for i in range(1, 10)))
MOMENTS = ["rmse", "mad", "r2", "pearson", "validity", "efficiency", "ece"]


def _moment_sql() -> str:
    reach = lambda x: f"half * (1.5::DOUBLE - {x}::DOUBLE)"
    missed = lambda x: f"avg((y < pred - {reach(x)} OR y > pred + {reach(x)})::INT)"
    gaps = " + ".join(f"abs({missed(x)} - {x}::DOUBLE)" for x in LEVELS)
    forms = [
        "sqrt(avg((pred - y) * (pred - y)))",
        "avg(abs(pred - y))",
        "1 - avg((pred - y) * (pred - y)) / var_pop(y)",
        "corr(pred, y)",
        f"1 - {missed(0.32)}",
        f"avg((pred + {reach(0.32)}) - (pred - {reach(0.32)}))",
        f"({gaps}) / {len(LEVELS)}",
    ]
    return f"SELECT endpoint, fold, perm::INT AS perm, subset, unnest({MOMENTS}) AS metric, unnest([{', '.join(forms)}]) AS value FROM redrawn GROUP BY endpoint, fold, perm, subset"


@query(
    "h4_regression_metrics_per_redraw",
    _moment_sql(),
    [
        EVENTS_BASE,
        EVENT_PREDICTIONS,
        STRATA.replace("reg_predictions", "event_predictions"),
        *remixed("(SELECT id, endpoint, fold, y, pred, half, inside, stratum FROM strata)", "stratum"),
    ],
    "value",
)
def h4_regression(t):
    """Seven regression metrics of 1,000 redraws at all ten levels, from sums over the sides."""
    rows = with_intervals(event_predictions(t), LEVELS).drop("half")
    return H.value_metrics_per_redraw(rows, GROUP, MOMENTS, PERMS, SEED)


#: Calibration ranks the observed probabilities of every redraw anew, so it copies rows; 1,000 of these take too long here.
CALIBRATION_PERMS = 20


@query("h11_classification_family")
def h11(t):
    """All nine classification shift-metrics, one- and two-tail, over the folds of each endpoint."""
    rows = class_scores(t)
    tested = H.permutation_test(rows, GROUP, [*H.COUNT_METRICS, "auc"], n=PERMS, seed=SEED)
    calibrated = H.permutation_test(rows, GROUP, list(H.CALIBRATION_METRICS), n=CALIBRATION_PERMS, seed=SEED)
    return H.family_p_values(tested.unionByName(calibrated), ["endpoint"], ["fold"])


@query("h11_regression_family")
def h11r(t):
    """All nine regression shift-metrics over the folds of each endpoint, with 1,000 redraws and ten levels."""
    rows = with_intervals(reg_predictions(t)).drop("half")
    rows = rows.withColumn("id", F.concat_ws("/", "id", "test_set"))
    wanted = ["rmse", "r2", "pearson", "spearman", "validity", "efficiency", "ece", "ence", "scc"]
    tested = H.permutation_test(rows, ["endpoint", "fold"], wanted, n=PERMS, seed=SEED, kind="value")
    return H.family_p_values(tested, ["endpoint"], ["fold"])
