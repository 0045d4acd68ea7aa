"""Registered queries: ranking of methods, trend tables, plot inputs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import shift as H
from ..operators.clean import big_enough
from ..operators.domain import tag_subsets
from ..operators.redraws import PRIME, key_sql
from ..sources.shared import materialise
from .registry import query
from .shifts import LABEL, PERMS, SEED, SIGN
from .statistics import BA, CONFUSION, KAPPA, MCC, PRECISION_0, PRECISION_1, RECALL_0, RECALL_1, gate
from .testbed import CLASS, CLASS_RUNS, DOMAINS, REG_ALL, class_runs, class_scores, reg_predictions, reg_subsets, with_intervals

RUN = ["endpoint", "test_set", "fold", "algorithm", "ad_method"]
SCENARIO = ["endpoint", "test_set", "algorithm", "ad_method"]
METRICS = ["ba", "mcc", "kappa", "strat_brier"]
WEEKS = ["W1", "W2", "W3", "W4", "W5"]

# --- SQL twins --------------------------------------------------------------------------------------

KR = "endpoint, test_set, fold, algorithm, ad_method, subset"
RUN_CONFUSION = CONFUSION.replace("endpoint, test_set, subset", KR).replace("FROM class_subsets", "FROM run_subsets").replace("confusion AS (", "confusion AS MATERIALIZED (")
RUN_VALUES = f"""vals AS MATERIALIZED (
  SELECT {KR}, n, unnest(['ba', 'mcc', 'kappa', 'strat_brier']) AS metric,
         unnest([{gate(BA)}, {gate(MCC)}, {gate(KAPPA)}, {gate('(loss_1 + loss_0) / 2')}]) AS value FROM confusion)"""
RUN_SHIFTS = """raw_shifts AS (
  SELECT endpoint, test_set, fold, algorithm, ad_method, metric,
         max(value) FILTER (subset = 'Inside') - max(value) FILTER (subset = 'Outside') AS shift
  FROM vals WHERE subset <> 'All' GROUP BY ALL)"""
AVERAGE = "average AS MATERIALIZED (SELECT endpoint, test_set, algorithm, ad_method, metric, avg(shift) AS shift FROM raw_shifts GROUP BY ALL)"
# permutation p-values of every scenario with enough rows of both classes; folds are taken together. Scenarios of
# one endpoint and test set have the same rows, so they share one random order of them in each redraw
PER_CLASS = 25
S = "endpoint, test_set, algorithm, ad_method"
PART = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
USABLE = f"""usable AS MATERIALIZED (
  SELECT {S}, row_number() OVER (ORDER BY {S})::INT AS s FROM (SELECT {S}, count_if(y = 1) AS n1, count_if(y = 0) AS n0 FROM class_runs GROUP BY {S}) AS c
  WHERE n1 >= {PER_CLASS} AND n0 >= {PER_CLASS})"""
S_KEYS = f"""s_keys AS MATERIALIZED (
  SELECT id, endpoint, test_set, y, {PART(0)} % {PRIME - 1} + 1 AS ka, {PART(1)} % {PRIME} AS kb, {PART(2)} % {PRIME} AS kc FROM (
    SELECT DISTINCT id, endpoint, test_set, y, md5(concat_ws('|', id, endpoint, test_set, {SEED})) AS h FROM class_runs) AS x)"""
S_ORDER = f"""s_order AS MATERIALIZED (
  SELECT k.id, k.endpoint, k.test_set, p.perm,
         row_number() OVER (PARTITION BY k.endpoint, k.test_set, p.perm, k.y ORDER BY {key_sql('k.ka', 'k.kb', 'k.kc', 'p.perm')}) AS rn
  FROM s_keys k, (SELECT unnest(range({PERMS}::BIGINT)) AS perm) p)"""
S_ROWS = f"""s_rows AS MATERIALIZED (
  SELECT s, id, endpoint, test_set, y, prob, inside, count_if(inside) OVER (PARTITION BY s, y) AS q FROM class_runs JOIN usable USING ({S}))"""
S_SUBSETS = """s_subsets AS (
  SELECT s, -1 AS perm, y, prob, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END AS subset FROM s_rows
  UNION ALL SELECT s, o.perm, r.y, r.prob, CASE WHEN o.rn <= r.q THEN 'Inside' ELSE 'Outside' END
  FROM s_rows r JOIN s_order o USING (id, endpoint, test_set))"""
S_CONFUSION = CONFUSION.replace("endpoint, test_set, subset", "s, perm, subset").replace("FROM class_subsets", "FROM s_subsets").replace("confusion AS (", "s_confusion AS MATERIALIZED (")
S_VALUES = f"""s_vals AS (
  SELECT s, perm, subset, unnest(['ba', 'mcc', 'kappa', 'strat_brier']) AS metric,
         unnest([{gate(BA)}, {gate(MCC)}, {gate(KAPPA)}, {gate('(loss_1 + loss_0) / 2')}]) AS value FROM s_confusion)"""
S_SHIFTS = """s_shifts AS MATERIALIZED (
  SELECT s, perm, metric, max(value) FILTER (subset = 'Inside') - max(value) FILTER (subset = 'Outside') AS shift FROM s_vals GROUP BY ALL)"""
OWN_SIGN = SIGN.replace("metric", "o.metric")
S_P = f"""tested AS MATERIALIZED (
  SELECT {S}, x.metric, x.tail, x.p FROM usable JOIN (
    SELECT o.s, o.metric, t.tail,
           avg(CASE WHEN t.tail = 'one' THEN (r.shift * {OWN_SIGN} >= o.shift * {OWN_SIGN})::INT
                    ELSE (abs(r.shift) >= abs(o.shift))::INT END) FILTER (r.shift IS NOT NULL) AS p
    FROM s_shifts o JOIN s_shifts r ON r.s = o.s AND r.metric = o.metric AND r.perm >= 0, (VALUES ('one'), ('two')) AS t(tail)
    WHERE o.perm = -1 GROUP BY ALL) AS x USING (s))"""
ONE_TAIL = f"one_tail AS (SELECT {S}, metric, p FROM tested WHERE tail = 'one')"
P_VALUES = [USABLE, S_KEYS, S_ORDER, S_ROWS, S_SUBSETS, S_CONFUSION, S_VALUES, S_SHIFTS, S_P, ONE_TAIL]
MASKED = f"""masked AS MATERIALIZED (
  SELECT a.endpoint, a.test_set, a.algorithm, a.ad_method, a.metric,
         CASE WHEN coalesce(round(p.p, 2) <= 0.05, false) AND coalesce(a.shift * {SIGN.replace('metric', 'a.metric')} > 0, false) THEN a.shift
              ELSE -{SIGN.replace('metric', 'a.metric')} * 'infinity'::DOUBLE END AS shift
  FROM average a LEFT JOIN one_tail p USING ({S}, metric))"""


def gaps_cte(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * EXCLUDE (best), CASE WHEN isinf(best) THEN NULL WHEN {SIGN} > 0 THEN best - shift ELSE shift - best END AS gap FROM (
    SELECT *, CASE WHEN {SIGN} > 0 THEN max(shift) OVER w ELSE min(shift) OVER w END AS best FROM {source}
    WINDOW w AS (PARTITION BY endpoint, test_set, algorithm, metric)) AS x)"""


RUN_SUBSETS = """run_subsets AS (SELECT *, 'All' AS subset FROM class_runs
  UNION ALL SELECT *, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END FROM class_runs)"""
STATS = [CLASS[0], CLASS_RUNS, RUN_SUBSETS, RUN_CONFUSION, RUN_VALUES]
SHIFT = [*STATS, RUN_SHIFTS]
AVG = [*SHIFT, AVERAGE]
GAPS = gaps_cte("average", "gaps")
WINS = """wins AS (
  SELECT endpoint, test_set, ad_method, count_if(coalesce(gap <= 0.01, false)) AS raw_wins,
         100 * count_if(coalesce(gap <= 0.01, false)) / (4 * count(DISTINCT algorithm))::DOUBLE AS percent_wins
  FROM gaps GROUP BY 1, 2, 3)"""


# --- Spark side ---------------------------------------------------------------------------------------


def statistics_long(t):
    rows = tag_subsets(class_runs(t))
    wide = M.confusion(rows, [*RUN, "subset"])
    forms = {"ba": M.balanced_accuracy(), "mcc": M.mcc(), "kappa": M.kappa(), "strat_brier": M.stratified_brier()}
    wide = wide.select(*RUN, "subset", "n", *[M.gated(v).alias(k) for k, v in forms.items()])
    return M.to_long(wide, [*RUN, "subset", "n"], METRICS)


def raw_shifts(t):
    sides = statistics_long(t).where("subset <> 'All'")
    return H.shift_metrics(sides, RUN).select(*RUN, "metric", "shift")


def average_shifts(t):
    return R.average_over(raw_shifts(t), SCENARIO)


def scenario_p_values(t):
    """(scenario, metric, tail, p) by redraws within the classes of every scenario that has enough rows of both."""
    rows = class_runs(t)
    usable = big_enough(rows, SCENARIO, "y", PER_CLASS).where("usable").select(*SCENARIO)
    rows = rows.join(usable, SCENARIO, "left_semi")
    tested = H.permutation_test(rows, SCENARIO, METRICS, PERMS, SEED, drawn_by=["endpoint", "test_set"])
    return materialise(tested.drop("shift"), "tested")


def one_tail(t):
    return scenario_p_values(t).where("tail = 'one'").drop("tail")


def masked_shifts(t):
    average = materialise(average_shifts(t), "average")
    return R.mask_losers(average, one_tail(t), SCENARIO)


def method_gaps(t):
    return R.gap_to_best(average_shifts(t), ["endpoint", "test_set", "algorithm"])


def method_wins(t):
    return R.wins(method_gaps(t), ["endpoint", "test_set", "ad_method"], "algorithm", len(METRICS), 0.01)


@query("i1_raw_shift_metrics", "SELECT endpoint, test_set, fold, algorithm, ad_method, metric, shift FROM raw_shifts", SHIFT, "shift")
def i1(t):
    return raw_shifts(t)


@query(
    "d2_inside_outside_join",
    """SELECT endpoint, test_set, fold, algorithm, ad_method, metric, i.value AS inside_value, o.value AS outside_value, i.value - o.value AS shift
       FROM (SELECT * FROM vals WHERE subset = 'Inside') i JOIN (SELECT * FROM vals WHERE subset = 'Outside') o
       USING (endpoint, test_set, fold, algorithm, ad_method, metric)""",
    STATS,
    "inside_value outside_value shift",
)
def d2(t):
    wide = H.shift_metrics(statistics_long(t).where("subset <> 'All'"), RUN)
    both = statistics_long(t).where("subset <> 'All'").groupBy(*RUN, "metric").agg(F.count(F.lit(1)).alias("sides"))
    return wide.join(both.where("sides = 2").drop("sides"), [*RUN, "metric"])


@query("i2_average_shift_metrics", "SELECT endpoint, test_set, algorithm, ad_method, metric, shift FROM average", AVG, "shift")
def i2(t):
    return average_shifts(t)


@query(
    "i2_average_statistics_per_subset",
    "SELECT endpoint, test_set, algorithm, ad_method, subset, metric, avg(value) AS value FROM vals GROUP BY ALL",
    STATS,
    "value",
)
def i2s(t):
    return R.average_over(statistics_long(t), [*SCENARIO, "subset"], "value")


@query("i3_gap_to_best_method", "SELECT endpoint, test_set, algorithm, ad_method, metric, shift, gap FROM gaps", [*AVG, GAPS], "shift gap")
def i3(t):
    return method_gaps(t)


@query(
    "i3_gap_to_best_algorithm",
    f"""SELECT endpoint, test_set, ad_method, algorithm, metric, shift, CASE WHEN {SIGN} > 0 THEN best - shift ELSE shift - best END AS gap FROM (
          SELECT *, CASE WHEN {SIGN} > 0 THEN max(shift) OVER w ELSE min(shift) OVER w END AS best FROM (
            SELECT endpoint, test_set, ad_method, algorithm, metric, avg(value) AS shift FROM vals WHERE subset = 'All' GROUP BY ALL) AS a
          WINDOW w AS (PARTITION BY endpoint, test_set, ad_method, metric)) AS x""",
    STATS,
    "shift gap",
)
def i3a(t):
    whole = statistics_long(t).where("subset = 'All'")
    average = R.average_over(whole, ["endpoint", "test_set", "ad_method", "algorithm"], "value").withColumnRenamed("value", "shift")
    return R.gap_to_best(average, ["endpoint", "test_set", "ad_method"])


@query("i4_wins", "SELECT endpoint, test_set, ad_method, raw_wins, percent_wins FROM wins", [*AVG, GAPS, WINS], "percent_wins")
def i4(t):
    return method_wins(t)


@query(
    "i4_wins_of_best_algorithm",
    """SELECT endpoint, test_set, ad_method, count_if(coalesce(gap <= 0, false)) AS raw_wins, 100 * count_if(coalesce(gap <= 0, false)) / 4.0::DOUBLE AS percent_wins
       FROM gaps WHERE algorithm = 'CVAP' GROUP BY 1, 2, 3""",
    [*AVG, GAPS],
    "percent_wins",
)
def i4b(t):
    gaps = R.best_algorithm_only(method_gaps(t), "algorithm", "CVAP")
    return R.wins(gaps, ["endpoint", "test_set", "ad_method"], "algorithm", len(METRICS), 0.0)


@query(
    "i5_masked_shifts",
    "SELECT endpoint, test_set, algorithm, ad_method, metric, CASE WHEN isinf(shift) THEN NULL ELSE shift END AS shift, isinf(shift) AS lost FROM masked",
    [*AVG, *P_VALUES, MASKED],
    "shift",
)
def i5(t):
    lost = F.abs("shift") == F.lit(float("inf"))
    return masked_shifts(t).withColumn("lost", lost).withColumn("shift", F.when(~lost, F.col("shift")))


@query(
    "i5_wins_with_p_values",
    """SELECT endpoint, test_set, ad_method, count_if(coalesce(gap <= 0.01, false)) AS raw_wins,
              100 * count_if(coalesce(gap <= 0.01, false)) / (4 * count(DISTINCT algorithm))::DOUBLE AS percent_wins
       FROM masked_gaps GROUP BY 1, 2, 3""",
    [*AVG, *P_VALUES, MASKED, gaps_cte("masked", "masked_gaps")],
    "percent_wins",
)
def i5w(t):
    gaps = R.gap_to_best(masked_shifts(t), ["endpoint", "test_set", "algorithm"])
    return R.wins(gaps, ["endpoint", "test_set", "ad_method"], "algorithm", len(METRICS), 0.01)


@query(
    "d3_shifts_with_p_values",
    "SELECT a.endpoint, a.test_set, a.algorithm, a.ad_method, a.metric, a.shift, p.p FROM average a JOIN one_tail p USING (endpoint, test_set, algorithm, ad_method, metric)",
    [*AVG, *P_VALUES],
    "shift p",
)
def d3(t):
    return average_shifts(t).join(one_tail(t), [*SCENARIO, "metric"])


@query(
    "d4_scenarios_without_p_value",
    "SELECT a.endpoint, a.test_set, a.algorithm, a.ad_method, a.metric FROM average a ANTI JOIN one_tail p USING (endpoint, test_set, algorithm, ad_method, metric)",
    [*AVG, *P_VALUES],
)
def d4(t):
    return average_shifts(t).join(one_tail(t), [*SCENARIO, "metric"], "left_anti").drop("shift")


@query(
    "i6_average_wins_table",
    f"SELECT ad_method, {', '.join(f'coalesce(sum(percent_wins) FILTER (test_set = {chr(39)}{w}{chr(39)}) / 5.0::DOUBLE, 0) AS {w}' for w in WEEKS)} FROM wins GROUP BY 1",
    [*AVG, GAPS, WINS],
    " ".join(WEEKS),
)
def i6(t):
    return R.average_wins(method_wins(t), "ad_method", "test_set", WEEKS, 5)


@query(
    "i7_win_sums",
    "SELECT endpoint, test_set, round(sum(percent_wins), 2) AS total, round(sum(percent_wins), 2) >= 100 AS ok, round(sum(percent_wins), 2) > 100 AS shared FROM wins GROUP BY 1, 2",
    [*AVG, GAPS, WINS],
    "total",
)
def i7(t):
    return R.win_sums(method_wins(t), ["endpoint", "test_set"], complete=True)


@query(
    "i7_win_sums_with_missing",
    """SELECT endpoint, test_set, round(sum(percent_wins), 2) AS total, round(sum(percent_wins), 2) <= 100 AS ok, round(sum(percent_wins), 2) > 100 AS shared FROM (
         SELECT endpoint, test_set, ad_method, 100 * count_if(coalesce(gap <= 0.01, false)) / (4 * count(DISTINCT algorithm))::DOUBLE AS percent_wins
         FROM masked_gaps GROUP BY 1, 2, 3) AS w GROUP BY 1, 2""",
    [*AVG, *P_VALUES, MASKED, gaps_cte("masked", "masked_gaps")],
    "total",
)
def i7m(t):
    gaps = R.gap_to_best(masked_shifts(t), ["endpoint", "test_set", "algorithm"])
    won = R.wins(gaps, ["endpoint", "test_set", "ad_method"], "algorithm", len(METRICS), 0.01)
    return R.win_sums(won, ["endpoint", "test_set"], complete=False)


@query(
    "i8_complete_scenarios",
    "SELECT endpoint, test_set, fold, algorithm, count(DISTINCT ad_method) AS methods, count(DISTINCT ad_method) = 4 AS complete FROM class_runs GROUP BY ALL",
    STATS[:2],
)
def i8(t):
    return R.complete_scenarios(class_runs(t), ["endpoint", "test_set", "fold", "algorithm"], "ad_method", len(DOMAINS))


@query(
    "i9_unsplit_consistency",
    """SELECT endpoint, test_set, fold, algorithm, metric, max(value) - min(value) AS spread, count(value) AS n, coalesce(max(value) - min(value) <= 1e-9, true) AS consistent
       FROM vals WHERE subset = 'All' GROUP BY ALL""",
    STATS,
    "spread",
)
def i9(t):
    whole = statistics_long(t).where("subset = 'All'")
    return R.unsplit_consistency(whole, ["endpoint", "test_set", "fold", "algorithm"])


@query("i9_unsplit_rows", "SELECT endpoint, test_set, fold, algorithm, 'No splitting!' AS ad_method, metric, any_value(value) AS value FROM vals WHERE subset = 'All' AND ad_method = 'UNC' GROUP BY ALL", STATS, "value")
def i9r(t):
    whole = statistics_long(t).where("subset = 'All' AND ad_method = 'UNC'")
    missing = whole.withColumn("ad_method", F.lit(None).cast("string")).na.fill("No splitting!", ["ad_method"])
    return missing.select(*RUN, "metric", "value")


@query(
    "i10_sign_fractions",
    f"SELECT ad_method, test_set, metric, count_if(shift IS NULL) AS blanks, count_if(coalesce(shift * {SIGN} > 0, false)) AS right_sign, count(shift) AS n FROM raw_shifts GROUP BY 1, 2, 3",
    SHIFT,
)
def i10(t):
    return R.sign_fractions(raw_shifts(t), ["ad_method", "test_set"])


@query(
    "i11_better_than_chance",
    """SELECT ad_method, algorithm, subset, metric, count_if(value IS NULL) AS blanks, count_if(coalesce(value > CASE metric WHEN 'ba' THEN 0.5 ELSE 0 END, false)) AS better, count(value) AS n
       FROM vals WHERE metric IN ('ba', 'mcc', 'kappa') GROUP BY 1, 2, 3, 4""",
    STATS,
)
def i11(t):
    return R.better_than(statistics_long(t), ["ad_method", "algorithm", "subset"], {m: R.CHANCE[m] for m in ("ba", "mcc", "kappa")})


LABELLED = [
    f"""judged AS (
  SELECT t.*, a.shift AS average_shift, CASE WHEN t.tail = 'one' THEN a.shift * {SIGN.replace('metric', 't.metric')} <= 0 END AS wrong_sign
  FROM tested t JOIN average a USING ({S}, metric))""",
    f"""judged_adjusted AS (
  SELECT f.*, least(1.0::DOUBLE, min(q) OVER (PARTITION BY tail ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM (
    SELECT *, p * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) AS r(i)) / cume AS q FROM (
      SELECT *, count(*) OVER (PARTITION BY tail) AS m, count(*) OVER (PARTITION BY tail ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume
      FROM judged WHERE p IS NOT NULL) AS g) AS f)""",
    f"""sides_of AS (
  SELECT {S}, metric, max(p) FILTER (tail = 'one') AS one_raw, max(p_adjusted) FILTER (tail = 'one') AS one_adjusted,
         max(p) FILTER (tail = 'two') AS two_raw, max(p_adjusted) FILTER (tail = 'two') AS two_adjusted, bool_or(wrong_sign) AS wrong_sign
  FROM judged_adjusted GROUP BY ALL)""",
    f"""labelled AS (SELECT a.*, coalesce({LABEL}, '') AS label FROM average a LEFT JOIN sides_of USING ({S}, metric))""",
]


def labelled_shifts(t):
    """Average shifts with the label of their raw and adjusted p-values."""
    average = materialise(average_shifts(t), "average")
    judged = scenario_p_values(t).join(average.withColumnRenamed("shift", "average_shift"), [*SCENARIO, "metric"])
    flag = F.when((F.col("tail") == "one") & F.col("average_shift").isNotNull(), H.wrong_sign())
    adjusted = H.adjust_p_values(judged.withColumn("wrong_sign", flag), ["tail"])
    wide = H.tails_side_by_side(adjusted, SCENARIO)
    labels = wide.select(*SCENARIO, "metric", H.significance_label().alias("label"))
    joined = average.join(labels, [*SCENARIO, "metric"], "left")
    return joined.withColumn("label", F.coalesce("label", F.lit("")))


TREND_COLS = "right_sign one_tail_raw one_tail_adjusted two_tail_raw two_tail_adjusted"


@query(
    "i12_trend_table",
    f"""SELECT *, {', '.join(f'round(100 * {c}::DOUBLE / nullif(n, 0), 2) AS {c}_percent' for c in TREND_COLS.split())} FROM (
          SELECT test_set, ad_method, metric, count(shift) AS n, count_if(coalesce(shift * {SIGN} > 0, false)) AS right_sign,
                 count_if(shift IS NOT NULL AND label = '*') AS one_tail_raw, count_if(shift IS NOT NULL AND label = '**') AS one_tail_adjusted,
                 count_if(shift IS NOT NULL AND label = 'x') AS two_tail_raw, count_if(shift IS NOT NULL AND label = 'xx') AS two_tail_adjusted
          FROM labelled GROUP BY 1, 2, 3) AS c""",
    [*AVG, *P_VALUES, *LABELLED],
    " ".join(f"{c}_percent" for c in TREND_COLS.split()),
)
def i12(t):
    return R.trend_table(labelled_shifts(t), ["test_set", "ad_method"])


@query(
    "i13_axis_limits",
    """SELECT metric, min(value) AS min, max(value) AS max, CASE metric WHEN 'ba' THEN 0 WHEN 'mcc' THEN -1 WHEN 'kappa' THEN -1 ELSE 0 END::DOUBLE AS lower_limit,
              CASE WHEN metric IN ('ba', 'mcc', 'kappa') THEN 1.0::DOUBLE ELSE max(value) END AS upper_limit FROM vals WHERE subset <> 'All' GROUP BY metric""",
    STATS,
    "min max lower_limit upper_limit",
)
def i13(t):
    return R.axis_limits(R.observed_limits(statistics_long(t).where("subset <> 'All'"), []))


@query(
    "i13_shift_limits",
    """SELECT metric, min(shift) AS min, max(shift) AS max, CASE metric WHEN 'ba' THEN -1 WHEN 'strat_brier' THEN min(shift) ELSE -2 END::DOUBLE AS lower_limit,
              CASE metric WHEN 'ba' THEN 1 WHEN 'strat_brier' THEN max(shift) ELSE 2 END::DOUBLE AS upper_limit FROM raw_shifts GROUP BY metric""",
    SHIFT,
    "min max lower_limit upper_limit",
)
def i13s(t):
    return R.axis_limits(R.observed_limits(raw_shifts(t), [], "shift"), shifts=True)


@query(
    "i14_plot_table",
    """SELECT endpoint, test_set, fold, algorithm, ad_method, subset, metric, value FROM vals
       WHERE subset <> 'All' AND (endpoint, test_set, ad_method, metric) IN (
         SELECT endpoint, test_set, ad_method, metric FROM (SELECT endpoint, test_set, ad_method, metric, subset, count(value) AS c FROM vals WHERE subset <> 'All' GROUP BY ALL) AS g
         GROUP BY ALL HAVING count(*) >= 2 AND min(c) > 0)""",
    STATS,
    "value",
)
def i14(t):
    rows = statistics_long(t).where("subset <> 'All'")
    return R.plot_table(rows, ["endpoint", "test_set", "ad_method"]).select(*RUN, "subset", "metric", "value")


@query(
    "i14_percentile_bands",
    """SELECT endpoint, algorithm, ad_method, subset, metric, avg(value) AS mean, quantile_cont(value, 0.025::DOUBLE) AS low, quantile_cont(value, 0.975::DOUBLE) AS high
       FROM vals GROUP BY ALL""",
    STATS,
    "mean low high",
)
def i14b(t):
    return R.percentile_bands(statistics_long(t), ["endpoint", "algorithm", "ad_method", "subset"])


MERGED = ["endpoint", "test_set", "fold", "algorithm", "ad_method", "subset", "n", "ba", "mcc", "kappa", "strat_brier", "recall_1", "recall_0", "precision_1", "precision_0"]


def wide_statistics(t):
    base = M.confusion(tag_subsets(class_runs(t)), [*RUN, "subset"])
    return base.select(
        *RUN, "subset", "n", M.balanced_accuracy().alias("ba"), M.mcc().alias("mcc"), M.kappa().alias("kappa"),
        M.stratified_brier().alias("strat_brier"), M.recall_1().alias("recall_1"), M.recall_0().alias("recall_0"),
        M.precision_1().alias("precision_1"), M.precision_0().alias("precision_0"),
    )


@query(
    "i15_merged_statistics",
    f"""SELECT {KR}, n, round({BA}, 6) + 0.0 AS "Balanced Accuracy", round({MCC}, 6) + 0.0 AS "MCC", round({KAPPA}, 6) + 0.0 AS "Kappa",
        round((loss_1 + loss_0) / 2, 6) + 0.0 AS "Stratified Brier Score", round({RECALL_1}, 6) + 0.0 AS "Recall (class 1)", round({RECALL_0}, 6) + 0.0 AS "Recall (class 0)",
        round({PRECISION_1}, 6) + 0.0 AS "Precision (class 1)", round({PRECISION_0}, 6) + 0.0 AS "Precision (class 0)" FROM confusion""",
    STATS[:4],
)
def i15(t):
    stats = wide_statistics(t)
    exemplar = F.col("endpoint").isin("click", "view")
    return R.merge_statistics([stats.where(exemplar), stats.where(~exemplar)], MERGED)


@query("b15_default_methods", "SELECT endpoint, test_set, fold, algorithm, ad_method, subset, metric, value FROM vals WHERE ad_method = 'UNC' AND algorithm = 'CVAP'", STATS, "value")
def b15(t):
    defaults = {"ad_method": "UNC", "algorithm": "CVAP"}
    out = statistics_long(t)
    for name, value in defaults.items():
        out = out.where(F.col(name) == value)
    return out.select(*RUN, "subset", "metric", "value")


@query(
    "i16_missing_metric_reasons",
    """SELECT endpoint, test_set, fold, algorithm, ad_method, subset, metric, n < 2 AS too_few, n1 = 0 OR n0 = 0 AS one_class FROM vals v
       JOIN (SELECT endpoint, test_set, fold, algorithm, ad_method, subset, n1, n0 FROM confusion) c USING (endpoint, test_set, fold, algorithm, ad_method, subset)
       WHERE n < 2 OR n1 = 0 OR n0 = 0""",
    STATS,
)
def i16(t):
    flags = H.class_rule_flags(tag_subsets(class_runs(t)), [*RUN, "subset"])
    out = H.not_computable(flags, [*RUN, "subset"], METRICS)
    return out.select(
        *RUN, "subset", "metric", F.array_contains("reasons", "too_few").alias("too_few"), F.array_contains("reasons", "one_class").alias("one_class")
    )


@query(
    "i16_unexpected_missing",
    """SELECT count_if(value IS NULL) AS missing, count_if(value IS NULL AND NOT (n < 2 OR n1 = 0 OR n0 = 0)) AS unexpected FROM (
         SELECT CASE WHEN metric = 'kappa' AND fold = 4 AND subset = 'All' THEN NULL ELSE value END AS value, c.n, n1, n0
         FROM vals v JOIN (SELECT endpoint, test_set, fold, algorithm, ad_method, subset, n, n1, n0 FROM confusion) c
           USING (endpoint, test_set, fold, algorithm, ad_method, subset)) AS x""",
    STATS,
)
def i16u(t):
    keys = [*RUN, "subset"]
    flags = H.class_rule_flags(tag_subsets(class_runs(t)), keys)
    # one metric of one fold is lost on the way: that must come to light
    lost = (F.col("metric") == "kappa") & (F.col("fold") == 4) & (F.col("subset") == "All")
    long = statistics_long(t).withColumn("value", F.when(~lost, F.col("value")))
    ruled_out = H.not_computable(flags, keys, METRICS)
    odd = H.unexpected_missing(long, ruled_out, keys).select(F.lit(0).alias("m"), F.lit(1).alias("u"))
    missing = long.where("value IS NULL").select(F.lit(1).alias("m"), F.lit(0).alias("u"))
    return missing.unionByName(odd).agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing"), F.coalesce(F.sum("u"), F.lit(0)).alias("unexpected")
    )


@query(
    "i16_regression_rule_flags",
    """SELECT endpoint, test_set, subset, count(*) < 2 AS too_few, min(y) = max(y) AS constant_y, min(pred) = max(pred) AS constant_prediction,
              min(upper - lower) = max(upper - lower) AS constant_width, max(upper - lower) = 0 AS zero_width, bool_or(upper - lower = 0) AS some_zero_width
       FROM reg_intervals WHERE sig_level = 0.32::DOUBLE GROUP BY 1, 2, 3""",
    REG_ALL,
)
def i16r(t):
    return H.value_rule_flags(with_intervals(reg_subsets(t), (0.32,)), ["endpoint", "test_set", "subset"])


@query(
    "i18_training_statistics_per_time_point",
    """SELECT t.time_point, endpoint, count(*) AS n, count_if(y = 1) AS actives, count_if(y = 0) AS inactives
       FROM class_scores c JOIN (VALUES ('T1', 'W1'), ('T2', 'W2'), ('T3', 'W3'), ('T4', 'W4'), ('T5', 'W5')) AS t(time_point, w) ON c.test_set <= t.w GROUP BY 1, 2""",
    CLASS[:2],
)
def i18(t):
    """Training rows of time point Ti: everything up to week i."""
    points = F.explode(F.sequence(F.substring("test_set", 2, 1).cast("int"), F.lit(5))).alias("w")
    rows = class_scores(t).select("endpoint", "y", points)
    rows = rows.withColumn("time_point", F.concat(F.lit("T"), F.col("w").cast("string")))
    return M.class_summary(rows, ["time_point", "endpoint"])


@query(
    "i18_regression_statistics_per_time_point",
    """SELECT 'T' || t.n AS time_point, endpoint, count(*) AS n, min(y) AS min, max(y) AS max, avg(y) AS mean, stddev_pop(y) AS sd, median(y) AS median
       FROM reg_predictions r JOIN (SELECT unnest(range(1, 8)) AS n) AS t ON r.fold <= t.n GROUP BY 1, 2""",
    REG_ALL[:1],
    "min max mean sd median",
)
def i18r(t):
    """The same for values: training rows of time point Ti are those of the first i line numbers."""
    points = F.explode(F.sequence(F.col("fold").cast("int"), F.lit(7))).alias("w")
    rows = reg_predictions(t).select("endpoint", "y", points)
    rows = rows.withColumn("time_point", F.concat(F.lit("T"), F.col("w").cast("string"))).drop("w")
    return M.activity_summary(rows, ["time_point", "endpoint"], "y")


CLEAN = """stages AS (SELECT 'before' AS stage, o_custkey AS key, o_totalprice AS v FROM orders
  UNION ALL SELECT 'after', o_custkey, avg(o_totalprice) FROM orders GROUP BY o_custkey)"""


@query(
    "i19_before_and_after_cleaning",
    "SELECT stage, count(*) AS n, min(v) AS min, max(v) AS max, median(v) AS median, avg(v) AS mean, stddev_pop(v) AS sd FROM stages GROUP BY 1",
    [CLEAN],
    "min max median mean sd",
    digits=3,
)
def i19(t):
    before = t.orders.select(F.lit("before").alias("stage"), F.col("o_totalprice").alias("v"))
    after = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v")).select(F.lit("after").alias("stage"), "v")
    return M.activity_summary(before.unionByName(after), ["stage"], "v")


@query(
    "i21_reference_values",
    """SELECT metric, CASE metric WHEN 'ba' THEN 0.5 WHEN 'mcc' THEN 0 WHEN 'kappa' THEN 0 END::DOUBLE AS reference, 0.0::DOUBLE AS shift_reference, count(value) AS n
       FROM vals GROUP BY metric""",
    STATS,
    "reference shift_reference",
)
def i21(t):
    counts = statistics_long(t).groupBy("metric").agg(F.count("value").alias("n"))
    return counts.select("metric", R.reference_value().alias("reference"), R.reference_value(shifts=True).alias("shift_reference"), "n")


@query(
    "m_scenario_labels",
    "SELECT DISTINCT endpoint || '_' || test_set || '_' || algorithm || '_' || ad_method AS label, endpoint, test_set, algorithm, ad_method FROM class_runs",
    STATS[:2],
)
def labels(t):
    label = class_runs(t).select(R.scenario_label(SCENARIO).alias("label")).distinct()
    return label.select("label", *R.split_scenario("label", SCENARIO))
