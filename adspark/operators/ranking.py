"""Ranking of domain methods and algorithms, trend tables and plot inputs.

Statistics are long tables (scenario keys, metric, value). A scenario has few methods, so windows
within one scenario stay tiny whatever the number of scenarios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.joining import join_on
from ..functions.scalar import is_infinite, ratio
from .shift import expected_sign, is_significant

INFINITY = float("inf")

# Metric groups of the winners analysis (fixed values).
PERFORMANCE = {"class": ["ba", "mcc", "auc", "kappa"], "value": ["r2", "rmse", "pearson", "spearman"]}
UNCERTAINTY = {
    "class": ["strat_brier", "r2_cal", "rmse_cal", "pearson_cal", "spearman_cal"],
    "value": ["ence", "ece", "scc", "efficiency", "validity"],
}

# Value a useless model would reach, by metric (fixed values); error metrics have none.
CHANCE = {
    "ba": 0.5, "auc": 0.5, "mcc": 0.0, "kappa": 0.0, "r2": 0.0, "pearson": 0.0, "spearman": 0.0,
    "scc": 0.0, "r2_cal": 0.0, "pearson_cal": 0.0, "spearman_cal": 0.0,
}

# Names shown in reports (fixed values).
PRETTY = {
    "ba": "Balanced Accuracy", "mcc": "MCC", "kappa": "Kappa", "auc": "AUC",
    "precision_1": "Precision (class 1)", "precision_0": "Precision (class 0)",
    "recall_1": "Recall (class 1)", "recall_0": "Recall (class 0)",
    "strat_brier": "Stratified Brier Score", "brier": "Brier Score",
    "rmse_cal": "RMSE (cal)", "mad_cal": "MAD (cal)", "r2_cal": "R2 (cal)",
    "pearson_cal": "Pearson coefficient (cal)", "spearman_cal": "Spearman coefficient (cal)",
    "rmse": "RMSE", "mad": "MAD", "r2": "R2", "pearson": "Pearson coefficient",
    "spearman": "Spearman coefficient", "validity": "Validity", "efficiency": "Efficiency",
    "ece": "ECE", "ence": "ENCE", "scc": "Spearman coefficient (PIs vs. residuals)",
}


def lookup(table: dict, key="metric") -> Column:
    """Constant lookup by metric name; NULL for other names."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), F.col(key) if isinstance(key, str) else key)


def average_over(df: DataFrame, keys: list[str], value: str = "shift") -> DataFrame:
    """Mean over folds and seeds; missing runs do not count."""
    return df.groupBy(*keys, "metric").agg(F.avg(value).alias(value))


# --- winners -------------------------------------------------------------------------------------


def mask_losers(avg: DataFrame, p_values: DataFrame, keys: list[str], value: str = "shift", level: float = 0.05) -> DataFrame:
    """Shifts that are not significant or have the wrong sign become the worst possible value.

    ``p_values`` holds (keys, metric, p) of the one-tail test; a missing p is not significant.
    """
    joined = join_on(avg, p_values.select(*keys, "metric", "p"), [*keys, "metric"], "left")
    sign = expected_sign()
    fits = is_significant(F.col("p"), level) & F.coalesce(F.col(value) * sign > 0, F.lit(False))
    worst = -sign * F.lit(INFINITY)
    return joined.withColumn(value, F.when(fits, F.col(value)).otherwise(worst)).drop("p")


def gap_to_best(df: DataFrame, within: list[str], value: str = "shift") -> DataFrame:
    """Add ``gap`` >= 0 to the best value of the same group and metric.

    Best is the maximum of metrics with expected sign +1 and the minimum of the others; NULL when
    even the best value is the worst possible one.
    """
    group = W.partitionBy(*within, "metric")
    higher = expected_sign() > 0
    best = F.when(higher, F.max(value).over(group)).otherwise(F.min(value).over(group))
    gap = F.when(higher, best - F.col(value)).otherwise(F.col(value) - best)
    hopeless = is_infinite(best)
    return df.withColumn("gap", F.when(~hopeless, gap))


def wins(gaps: DataFrame, keys: list[str], algorithm: str, n_metrics: int, threshold: float = 0.0) -> DataFrame:
    """(keys, raw_wins, percent_wins): how often a method is within the threshold of the best.

    100 % means a win for every metric and algorithm of the group.
    """
    hit = F.coalesce(F.col("gap") <= threshold, F.lit(False))
    counts = gaps.groupBy(*keys).agg(
        F.count_if(hit).alias("raw_wins"), F.count_distinct(algorithm).alias("_algs")
    )
    percent = 100 * F.col("raw_wins") / (n_metrics * F.col("_algs"))
    return counts.select(*keys, "raw_wins", percent.alias("percent_wins"))


def best_algorithm_only(df: DataFrame, algorithm: str, winner: str) -> DataFrame:
    return df.where(F.col(algorithm) == winner)


def average_wins(df: DataFrame, method: str, test_set: str, test_sets: list[str], endpoints: list[str] | int) -> DataFrame:
    """Method x test-set table of mean percentages over endpoints; a missing cell counts as 0."""
    n = endpoints if isinstance(endpoints, int) else len(endpoints)
    total = df.groupBy(method).pivot(test_set, test_sets).agg(F.sum("percent_wins") / n)
    return total.na.fill(0.0)


def win_sums(df: DataFrame, keys: list[str], complete: bool) -> DataFrame:
    """Sum of percentages per test set, whether it is plausible, and whether methods shared wins.

    Without missing differences some method wins everything, so the sum is at least 100; with some
    missing it stays at 100 or below. More than 100 means that methods tied for a win.
    """
    sums = df.groupBy(*keys).agg(F.round(F.sum("percent_wins"), 2).alias("total"))
    ok = F.col("total") >= 100 if complete else F.col("total") <= 100
    return sums.withColumns({"ok": ok, "shared": F.col("total") > 100})


def complete_scenarios(df: DataFrame, keys: list[str], method: str, expected: int) -> DataFrame:
    """Scenarios with the number of methods found and whether all are present."""
    found = df.groupBy(*keys).agg(F.count_distinct(method).alias("methods"))
    return found.withColumn("complete", F.col("methods") == expected)


def unsplit_consistency(df: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Values of subset All must not depend on the domain method: spread per scenario and metric."""
    spread = df.groupBy(*keys, "metric").agg((F.max("value") - F.min("value")).alias("spread"), F.count("value").alias("n"))
    return spread.withColumn("consistent", F.coalesce(F.col("spread") <= tolerance, F.lit(True)))


# --- trends ----------------------------------------------------------------------------------------


def sign_fractions(df: DataFrame, keys: list[str], value: str = "shift") -> DataFrame:
    """Missing values, values with the expected sign, and all values, per metric."""
    return df.groupBy(*keys, "metric").agg(
        F.count_if(F.col(value).isNull()).alias("blanks"),
        F.count_if(F.coalesce(F.col(value) * expected_sign() > 0, F.lit(False))).alias("right_sign"),
        F.count(value).alias("n"),
    )


def better_than(df: DataFrame, keys: list[str], bounds: dict[str, float], value: str = "value") -> DataFrame:
    """Values above the metric's bound (at the bound counts for validity)."""
    bound = lookup(bounds)
    above = F.when(F.col("metric") == "validity", F.col(value) >= bound).otherwise(F.col(value) > bound)
    known = df.where(F.col("metric").isin(*bounds))
    return known.groupBy(*keys, "metric").agg(
        F.count_if(F.col(value).isNull()).alias("blanks"),
        F.count_if(F.coalesce(above, F.lit(False))).alias("better"),
        F.count(value).alias("n"),
    )


LABELS = {"one_tail_raw": "*", "one_tail_adjusted": "**", "two_tail_raw": "x", "two_tail_adjusted": "xx"}


def trend_table(df: DataFrame, keys: list[str], value: str = "shift", label: str = "label") -> DataFrame:
    """Per metric: share of average shifts with the right sign and of each significance label."""
    kept = F.col(value).isNotNull()
    counts = df.groupBy(*keys, "metric").agg(
        F.count(value).alias("n"),
        F.count_if(F.coalesce(F.col(value) * expected_sign() > 0, F.lit(False))).alias("right_sign"),
        *[F.count_if(kept & (F.col(label) == text)).alias(name) for name, text in LABELS.items()],
    )
    percent = lambda c: F.round(100 * ratio(c, "n"), 2).alias(f"{c}_percent")
    return counts.select("*", *[percent(c) for c in ("right_sign", *LABELS)])


# --- plot inputs -------------------------------------------------------------------------------------


def observed_limits(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Global minimum and maximum per metric."""
    return df.groupBy(*keys, "metric").agg(F.min(value).alias("min"), F.max(value).alias("max"))


def axis_limits(limits: DataFrame, shifts: bool = False) -> DataFrame:
    """Axis limits per metric: fixed ranges where a metric is bounded, observed ones elsewhere."""
    m = F.col("metric")
    unit = m.isin("validity", "ba", "auc")
    signed = m.isin("pearson", "spearman", "scc", "mcc", "kappa", "pearson_cal", "spearman_cal")
    squared = m.isin("r2", "r2_cal")
    if shifts:
        low = F.when(unit, -1.0).when(signed, -2.0).otherwise(F.col("min"))
        high = F.when(unit, 1.0).when(signed, 2.0).otherwise(F.col("max"))
    else:
        low = F.when(unit, 0.0).when(signed, -1.0).when(squared, F.col("min")).otherwise(0.0)
        high = F.when(unit | squared | signed, 1.0).otherwise(F.col("max"))
    return limits.select("*", low.alias("lower_limit"), high.alias("upper_limit"))


def reference_value(level: float = 0.32, shifts: bool = False) -> Column:
    """Noteworthy value of a metric on a plot: 0 for shifts, chance or nominal level otherwise."""
    if shifts:
        return F.lit(0.0)
    return F.when(F.col("metric") == "validity", F.lit(1.0 - level)).otherwise(lookup(CHANCE))


def plot_table(df: DataFrame, x: list[str], subset: str = "subset", value: str = "value") -> DataFrame:
    """Rows whose x value has data in every subset of the metric."""
    filled = df.groupBy(*x, "metric", subset).agg(F.count(value).alias("_n"))
    sides = filled.groupBy(*x, "metric").agg(F.count_if(F.col("_n") > 0).alias("_s"), F.count(F.lit(1)).alias("_t"))
    kept = sides.where((F.col("_s") == F.col("_t")) & (F.col("_t") >= 2)).select(*x, "metric")
    return join_on(df, kept, [*x, "metric"], "left_semi")


def percentile_bands(df: DataFrame, keys: list[str], value: str = "value", cover: float = 0.95) -> DataFrame:
    """Central percentile band over the runs (folds and seeds) of a scenario."""
    lo, hi = (1 - cover) / 2, 1 - (1 - cover) / 2
    return df.groupBy(*keys, "metric").agg(
        F.avg(value).alias("mean"),
        F.expr(f"percentile({value}, {lo}D)").alias("low"),
        F.expr(f"percentile({value}, {hi}D)").alias("high"),
    )


def merge_statistics(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of wide statistics with pretty metric names in a fixed column order."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    renamed = merged.withColumnsRenamed({k: v for k, v in PRETTY.items() if k in merged.columns})
    wanted = [PRETTY.get(c, c) for c in order]
    return renamed.select(*[F.col(f"`{c}`") for c in wanted]).distinct()


def scenario_label(keys: list[str]) -> Column:
    """Scenario keys joined with underscores."""
    return F.concat_ws("_", *keys)


def split_scenario(label: str, names: list[str]) -> list[Column]:
    """Scenario keys parsed back from a label; a label with another number of parts is an error."""
    parts = F.split(F.col(label), "_")
    wrong = F.raise_error(F.concat(F.lit("unexpected scenario label: "), F.col(label)))
    safe = F.when(F.size(parts) == len(names), parts).otherwise(wrong.cast("array<string>"))
    return [safe[i].alias(n) for i, n in enumerate(names)]
