"""Prediction intervals: ensemble spread, tree percentiles and conformal regression.

Trees come as an array column of per-tree predictions. Calibration sets and scenarios are group
keys, significance levels are rows, so a sweep over levels never fits or scores a model again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joining import join_on
from ..functions.ordered import running_totals
from ..functions.scalar import is_infinite
from .domain import mean_of, spread_of

# Two-sided normal quantiles by confidence in percent (fixed values).
NORMAL_HALF_WIDTH = {
    10: 0.12566134685507416,
    20: 0.2533471031357997,
    30: 0.38532046640756773,
    40: 0.5244005127080407,
    50: 0.6744897501960817,
    60: 0.8416212335729143,
    68: 0.9944578832097532,
    80: 1.2815515655446004,
    90: 1.6448536269514722,
    95: 1.959963984540054,
}


def array_percentile(values, q: float) -> Column:
    """Linear-interpolation percentile (q in [0, 1]) of an array column."""
    values = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(float(q))
    lo = F.element_at(values, (F.floor(at) + 1).cast("int"))
    hi = F.element_at(values, (F.ceil(at) + 1).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def ensemble_interval(pred: Column, trees: Column, confidence: int = 68) -> Column:
    """pred -/+ z * sd(trees), the half width rounded to three decimals."""
    half = F.round(F.lit(NORMAL_HALF_WIDTH[confidence]) * spread_of(trees), 3)
    return F.struct((pred - half).alias("lower"), (pred + half).alias("upper"))


def percentile_interval(pred: Column, trees: Column, confidence: float) -> Column:
    """Interval centred on the prediction, half as wide as the central range of the trees."""
    tail = (100 - confidence) / 2 / 100
    half = F.abs(array_percentile(trees, 1 - tail) - array_percentile(trees, tail)) / 2
    return F.struct((pred - half).alias("lower"), (pred + half).alias("upper"))


def scaling(trees) -> Column:
    """exp of the spread of the trees: the expected difficulty of a row."""
    return F.exp(spread_of(trees))


def nonconformity(y="y", pred="pred", scale="scale") -> Column:
    """|y - pred| / scale."""
    return F.abs(F.col(y) - F.col(pred)) / F.col(scale)


def with_levels(df: DataFrame, levels) -> DataFrame:
    """One row per significance level."""
    return df.withColumn("sig_level", F.explode(F.array(*[F.lit(float(s)) for s in levels])))


def conformal_quantiles(calibration: DataFrame, keys: list[str], levels, alpha: str = "alpha") -> DataFrame:
    """(keys, sig_level, alpha_s): the floor(level * (n + 1))-th largest calibration score.

    Position 0 gives the largest score and positions beyond n the smallest one. One distributed
    ranking serves all levels.
    """
    values = calibration.groupBy(*keys, alpha).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(values, keys, [alpha], {"_cum": "_c"}, totals={"_n": "_c"})
    swept = with_levels(ranked, levels)
    from_top = F.floor(F.col("sig_level") * (F.col("_n") + 1))
    from_top = F.least(F.greatest(from_top, F.lit(1)), F.col("_n"))
    target = F.col("_n") + 1 - from_top
    hit = (F.col("_cum") - F.col("_c") < target) & (target <= F.col("_cum"))
    return swept.groupBy(*keys, "sig_level").agg(F.max(F.when(hit, F.col(alpha))).alias("alpha_s"))


def conformal_intervals(test: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """pred -/+ alpha_s * scale for every test row and significance level of its calibration set."""
    joined = join_on(test, quantiles, keys)
    half = F.col("alpha_s") * F.col("scale")
    return joined.select(
        *test.columns, "sig_level", (F.col("pred") - half).alias("lower"), (F.col("pred") + half).alias("upper")
    )


def icp(calibration: DataFrame, test: DataFrame, keys: list[str], levels) -> DataFrame:
    """Inductive conformal regression on scored rows.

    ``calibration`` has keys, y, pred, scale; ``test`` has keys, id, pred, scale. Keys identify the
    calibration set and must not be empty.
    """
    scored = calibration.select(*keys, nonconformity().alias("alpha"))
    return conformal_intervals(test, conformal_quantiles(scored, keys, levels), keys)


def midpoint(lower: Column, upper: Column) -> Column:
    """Middle of an interval; an interval without bounds has the middle 0."""
    return F.when(is_infinite(lower) & is_infinite(upper), F.lit(0.0)).otherwise((lower + upper) / 2)


def midpoint_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, unbounded, mismatched): intervals without bounds, and where a missing mid-point does not go with one.

    The mid-point of an interval is missing (NaN) exactly when the interval has no bound on either
    side; a bound that is NULL counts as a mismatch.
    """
    lower, upper = F.col("lower"), F.col("upper")
    unbounded = (lower == F.lit(float("-inf"))) & (upper == F.lit(float("inf")))
    missing = F.isnan((lower + upper) / 2)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(unbounded, F.lit(False))).alias("unbounded"),
        F.count_if(F.coalesce(unbounded != missing, F.lit(True)) | lower.isNull() | upper.isNull()).alias("mismatched"),
    )


def acp(per_split: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregated conformal intervals: medians of the bounds over the splits (a small, fixed number).

    ``keys`` identify a test row (with its scenario); the prediction is the middle of the interval.
    """
    merged = per_split.groupBy(*keys, "sig_level").agg(
        F.expr("percentile(lower, 0.5D)").alias("lower"), F.expr("percentile(upper, 0.5D)").alias("upper")
    )
    return merged.withColumn("pred", midpoint(F.col("lower"), F.col("upper")))


def scp(calibration: DataFrame, test: DataFrame, keys: list[str], levels, id_col: str = "id") -> DataFrame:
    """Synergy conformal regression: scores averaged over the training parts.

    Both inputs have one row per (row id, part); ``calibration`` carries alpha, ``test`` pred and
    ``spread`` (of the trees).
    """
    mean_alpha = calibration.groupBy(*keys, id_col).agg(F.avg("alpha").alias("alpha"))
    mean_test = test.groupBy(*keys, id_col).agg(
        F.avg("pred").alias("pred"), F.exp(F.avg("spread")).alias("scale")
    )
    return conformal_intervals(mean_test, conformal_quantiles(mean_alpha, keys, levels), keys)


def interval_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of intervals that are upside down or miss their own prediction."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("upper") < F.col("lower")).alias("reversed"),
        F.count_if((F.col("pred") < F.col("lower")) | (F.col("pred") > F.col("upper"))).alias("outside"),
    )


def prediction_consistency(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose prediction differs between significance levels."""
    spread = df.groupBy(*keys).agg((F.max("pred") - F.min("pred")).alias("gap"))
    return spread.where("gap > 0")


def tree_mean(trees) -> Column:
    """Prediction of a forest from its trees."""
    return mean_of(trees)
