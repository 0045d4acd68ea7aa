"""Performance and uncertainty statistics per group of predictions.

All functions take a predictions table and the grouping columns and return one row per group.
Classification rows carry ``y`` (0/1) and ``prob`` (of class 1); regression rows ``y``, ``pred``
and, for intervals, ``lower``, ``upper`` and ``sig_level``. Groups with fewer than two rows keep
their counts and get NULL statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ordered
from ..functions.joining import join_on
from ..functions.scalar import (
    correlation_two_tail_p,
    count_where,
    is_infinite,
    one_tail_p,
    ratio,
    share,
    strict_reach,
)
from ..sources.shared import materialise

MIN_ROWS = 2
ENCE_BIN_ROWS = 20


def predicted_class(prob) -> Column:
    """1 when the probability is above one half, otherwise 0 (also for exactly one half)."""
    return ((F.col(prob) if isinstance(prob, str) else prob) > 0.5).cast("int")


def _y(value: int) -> Column:
    return F.col("y") == value


# --- classification: counts -------------------------------------------------------------------


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts tp, fp, tn, fn, class sizes and squared losses in one pass."""
    hit = F.coalesce(F.col("pred_class"), predicted_class("prob")) if "pred_class" in df.columns else predicted_class("prob")
    loss = (F.col("prob") - F.col("y")) * (F.col("prob") - F.col("y"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(_y(1)).alias("n1"),
        count_where(_y(0)).alias("n0"),
        count_where(_y(1) & (hit == 1)).alias("tp"),
        count_where(_y(0) & (hit == 1)).alias("fp"),
        count_where(_y(0) & (hit == 0)).alias("tn"),
        count_where(_y(1) & (hit == 0)).alias("fn"),
        F.avg(loss).alias("brier"),
        F.avg(F.when(_y(1), loss)).alias("loss_1"),
        F.avg(F.when(_y(0), loss)).alias("loss_0"),
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def recall_1() -> Column:
    return ratio("tp", F.col("tp") + F.col("fn"))


def recall_0() -> Column:
    return ratio("tn", F.col("tn") + F.col("fp"))


def precision_1() -> Column:
    return ratio("tp", F.col("tp") + F.col("fp"))


def precision_0() -> Column:
    return ratio("tn", F.col("tn") + F.col("fn"))


def balanced_accuracy() -> Column:
    return (recall_1() + recall_0()) / 2


def both_classes() -> Column:
    return (F.col("n1") > 0) & (F.col("n0") > 0)


def mcc() -> Column:
    """Matthews correlation; 0 when one class is never predicted, NULL with one observed class."""
    tp, fp, tn, fn = (_d(c) for c in ("tp", "fp", "tn", "fn"))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(both_classes(), F.coalesce(ratio(tp * tn - fp * fn, scale), F.lit(0.0)))


def kappa() -> Column:
    """Cohen's kappa from the confusion counts."""
    n = _d("n")
    agree = (_d("tp") + _d("tn")) / n
    chance = (
        (_d("tp") + _d("fp")) * (_d("tp") + _d("fn")) + (_d("tn") + _d("fn")) * (_d("tn") + _d("fp"))
    ) / (n * n)
    return F.when(both_classes(), ratio(agree - chance, 1 - chance))


def stratified_brier() -> Column:
    """Unweighted mean of the per-class losses; NULL when a class is missing."""
    return (F.col("loss_1") + F.col("loss_0")) / 2


def gated(value: Column, n: str = "n") -> Column:
    """NULL for groups that are too small for statistics."""
    return F.when(F.col(n) >= MIN_ROWS, value)


# --- classification: ranks, kappa with order, K classes ----------------------------------------


def auc(df: DataFrame, keys: list[str], score: str = "prob", label: str = "y") -> DataFrame:
    """Area under the ROC curve: concordant pairs plus half the ties over all pairs."""
    per_score = df.groupBy(*keys, score).agg(
        count_where(F.col(label) == 1).alias("_p"), count_where(F.col(label) == 0).alias("_q")
    )
    ranked = ordered.running_totals(per_score, keys, [score], {"_cq": "_q"})
    below = F.col("_cq") - F.col("_q") / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("_p") * below).alias("_u"), F.sum(_d("_p")).alias("_n1"), F.sum(_d("_q")).alias("_n0")
    )
    return sums.select(*keys, ratio("_u", F.col("_n1") * F.col("_n0")).alias("auc"))


def probability_sum(probs) -> Column:
    """Sum of a row's class probabilities."""
    return F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)


def checked_probabilities(probs, tolerance: float = 0.02) -> Column:
    """Class probabilities as they are; an error where they miss the sum 1 by more than the tolerance."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    fine = F.assert_true(F.abs(probability_sum(probs) - 1) <= tolerance, F.lit("class probabilities do not add up to 1"))
    return F.when(fine.isNull(), probs)


def renormalised(probs) -> Column:
    """Class probabilities divided by their sum."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return F.transform(probs, lambda p: p / probability_sum(probs))


def pairwise_auc(df: DataFrame, keys: list[str], classes: list, probs: str = "probs", label: str = "label") -> DataFrame:
    """Mean over unordered class pairs of the AUC of both directions (more than two classes).

    ``probs`` is the array of class probabilities in the order of ``classes``; they are checked and
    divided by their sum first.
    """
    df = df.withColumn(probs, renormalised(checked_probabilities(probs)))
    pairs = [(i, j) for i in range(len(classes)) for j in range(len(classes)) if i != j]
    entries = F.array(*[
        F.struct(F.lit(f"{min(i, j)}-{max(i, j)}").alias("pair"), F.lit(i).alias("i"), F.lit(j).alias("j"))
        for i, j in pairs
    ])
    values = F.array(*[F.lit(c) for c in classes])
    at = F.array_position(values, F.col(label)).cast("int") - 1
    long = df.withColumn("_at", at).withColumn("_e", F.explode(F.filter(entries, lambda e: (e["i"] == F.col("_at")) | (e["j"] == F.col("_at")))))
    long = long.select(
        *keys,
        F.col("_e.pair").alias("_pair"),
        F.col("_e.i").alias("_i"),
        F.element_at(probs, F.col("_e.i") + 1).alias("_score"),
        (F.col("_at") == F.col("_e.i")).cast("int").alias("_hit"),
    )
    each = auc(long, [*keys, "_pair", "_i"], "_score", "_hit")
    return each.groupBy(*keys).agg(F.avg("auc").alias("auc"))


def weighted_kappa(df: DataFrame, keys: list[str], observed: str, predicted: str, n_classes: int, unweighted: bool = False) -> DataFrame:
    """Kappa for ordered classes 0 .. n_classes-1 with linear agreement weights."""
    cells = df.groupBy(*keys, observed, predicted).agg(F.count(F.lit(1)).alias("_c"))
    weight = lambda a, b: (
        (a == b).cast("double") if unweighted else 1 - F.abs(a - b) / F.lit(float(n_classes - 1))
    )
    # at most n_classes^2 cells per group: gather the margins of each group as small arrays
    cell = F.struct(F.col(observed).alias("o"), F.col(predicted).alias("p"), F.col("_c").alias("c"))
    grouped = cells.groupBy(*keys).agg(F.collect_list(cell).alias("_m"), F.sum("_c").cast("double").alias("_n"))
    classes = F.array(*[F.lit(i) for i in range(n_classes)])

    def margin(side):
        return F.transform(
            classes,
            lambda k: F.aggregate(
                F.filter("_m", lambda m: m[side] == k), F.lit(0.0), lambda s, m: s + m["c"]
            ),
        )

    agree = F.aggregate("_m", F.lit(0.0), lambda s, m: s + m["c"] * weight(m["o"], m["p"])) / F.col("_n")
    chance = reduce(
        lambda a, b: a + b,
        [
            F.col("_o")[i] * F.col("_p")[j] * weight(F.lit(i), F.lit(j))
            for i in range(n_classes)
            for j in range(n_classes)
        ],
    ) / (F.col("_n") * F.col("_n"))
    sized = grouped.select("*", margin("o").alias("_o"), margin("p").alias("_p"), agree.alias("_agree"))
    return sized.select(*keys, ratio(F.col("_agree") - chance, 1 - chance).alias("kappa"))


def one_hot_brier(probs, label_index) -> Column:
    """Sum of squared differences between class probabilities and the one-hot label."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    label_index = F.col(label_index) if isinstance(label_index, str) else label_index
    terms = F.transform(probs, lambda p, i: F.pow(p - (i == label_index).cast("double"), 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def log_loss(probs, label_index, n_classes: int, ordinal: bool = False, eps: float = 1e-15) -> Column:
    """Log loss of a row: sum over classes of -w ln(p + eps).

    The weight is one-hot; the ordinal form uses 1 - |i - j| / (K - 1).
    """
    probs = F.col(probs) if isinstance(probs, str) else probs
    label_index = F.col(label_index) if isinstance(label_index, str) else label_index
    if not ordinal:
        return -F.ln(F.element_at(probs, label_index + 1) + eps)
    terms = F.transform(
        probs, lambda p, i: -(1 - F.abs(i - label_index) / F.lit(float(n_classes - 1))) * F.ln(p + eps)
    )
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def stratified_loss(df: DataFrame, keys: list[str], loss: Column, label: str, n_classes: int, out: str = "loss") -> DataFrame:
    """Mean over the true classes of the mean loss; NULL when a class does not occur."""
    per_class = df.groupBy(*keys, label).agg(F.avg(loss).alias("_l"))
    return per_class.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == n_classes, F.avg("_l")).alias(out)
    )


# --- classification: calibration ----------------------------------------------------------------


def observed_probability(df: DataFrame, keys: list[str], delta: str = "delta") -> DataFrame:
    """Distinct probabilities with the share of class 1 among rows closer than ``delta``.

    Result: keys (with delta), ``prob``, ``rows`` at that probability and ``observed``. Running
    totals replace the band join: the class counts up to the far end of the band minus those
    before its near end.
    """
    keys = [*keys, delta] if delta not in keys else keys
    return _banded(df, keys, delta).select(*keys, "prob", "rows", "observed")


def _banded(df: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """Observed probabilities with the centred average rank ``_rp`` of each probability."""
    points = df.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("ones"))
    band = points.withColumn("_b", strict_reach(F.col("prob"), F.col(delta)))
    # at equal positions: band starts (0) before points (1) before band ends (2)
    events = F.array(
        F.struct(F.col("prob").alias("at"), F.lit(1).alias("kind"), F.col("rows").alias("r"), F.col("ones").alias("o")),
        F.struct(F.col("_b.lo").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("o")),
        F.struct(F.col("_b.hi").alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("o")),
    )
    line = band.select(*keys, "prob", "rows", F.explode(events).alias("_e")).select(
        *keys, "prob", "rows", F.col("_e.at").alias("at"), F.col("_e.kind").alias("kind"), F.col("_e.r").alias("r"), F.col("_e.o").alias("o")
    )
    total = ordered.running_totals(
        line, keys, ["at", "kind"], {"_cr": "r", "_co": "o"}, totals={"_n": "r"}
    )
    sign = F.col("kind") - 1
    rank = F.col("_cr") - (F.col("rows") - 1) / 2 - (F.col("_n") + 1) / 2
    return (
        total.groupBy(*keys, "prob", "rows")
        .agg(
            F.sum(sign * F.col("_cr")).alias("_r"),
            F.sum(sign * F.col("_co")).alias("_o"),
            F.max(F.when(F.col("kind") == 1, rank)).alias("_rp"),
        )
        .select(*keys, "prob", "rows", ratio("_o", "_r").alias("observed"), "_rp")
    )


def weighted_fit(points: DataFrame, keys: list[str], truth: str, estimate: str, weight: str) -> DataFrame:
    """RMSE, MAD, R2 and Pearson of an estimate for rows that stand for ``weight`` copies."""
    w = F.col(weight).cast("double")
    mean = points.groupBy(*keys).agg(
        (F.sum(w * F.col(truth)) / F.sum(w)).alias("_mt"),
        (F.sum(w * F.col(estimate)) / F.sum(w)).alias("_me"),
    )
    t, e = F.col(truth) - F.col("_mt"), F.col(estimate) - F.col("_me")
    diff = F.col(truth) - F.col(estimate)
    joined = join_on(points, mean, keys) if keys else ordered.with_scalars(points, mean)
    sums = joined.groupBy(*keys).agg(
        F.sum(w).alias("_w"),
        F.sum(w * diff * diff).alias("_sse"),
        F.sum(w * F.abs(diff)).alias("_sad"),
        F.sum(w * t * t).alias("_tt"),
        F.sum(w * e * e).alias("_ee"),
        F.sum(w * t * e).alias("_te"),
        (F.max(truth) > F.min(truth)).alias("_vt"),
        (F.max(estimate) > F.min(estimate)).alias("_ve"),
    )
    return sums.select(
        *keys,
        F.sqrt(F.col("_sse") / F.col("_w")).alias("rmse"),
        (F.col("_sad") / F.col("_w")).alias("mad"),
        F.when(F.col("_vt"), 1 - ratio("_sse", "_tt")).alias("r2"),
        F.when(F.col("_vt") & F.col("_ve"), ratio("_te", F.sqrt("_tt") * F.sqrt("_ee"))).alias("pearson"),
        F.col("_w").cast("bigint").alias("n"),
    )


def calibration(df: DataFrame, keys: list[str], deltas=(0.05,), p_values: bool = True) -> DataFrame:
    """Calibration statistics of observed versus predicted probability per delta."""
    swept = df.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    keys = [*keys, "delta"]
    points = materialise(_banded(swept, keys, "delta"), "calibration")
    fit = weighted_fit(points, keys, "observed", "prob", "rows")
    ro = ordered.average_ranks(points, keys, "observed", "_ro", weight="rows").drop("_n", "c")
    ranked = join_on(points, ro, [*keys, "observed"])
    rho = ordered.weighted_pearson(ranked, keys, "_ro", "_rp", "rows", "spearman")
    out = join_on(fit, rho, keys)
    if p_values:
        for name in ("pearson", "spearman"):
            # a positive correlation is expected
            out = out.withColumn("_p2", correlation_two_tail_p(F.col(name), F.col("n").cast("double")))
            out = out.withColumn(f"{name}_p", one_tail_p(F.col(name), F.col("_p2"), "greater")).drop("_p2")
    return out


def class_statistics(df: DataFrame, keys: list[str], delta: float = 0.05, p_values: bool = True) -> DataFrame:
    """All classification statistics of every group, one wide row each."""
    base = confusion(df, keys).select(
        *keys,
        "n",
        "n1",
        "n0",
        gated(precision_1()).alias("precision_1"),
        gated(precision_0()).alias("precision_0"),
        gated(recall_1()).alias("recall_1"),
        gated(recall_0()).alias("recall_0"),
        gated(balanced_accuracy()).alias("ba"),
        gated(mcc()).alias("mcc"),
        gated(kappa()).alias("kappa"),
        gated(F.col("brier")).alias("brier"),
        gated(stratified_brier()).alias("strat_brier"),
    )
    cal = calibration(df, keys, (delta,), p_values).drop("delta")
    names = ["rmse", "mad", "r2", "pearson", "spearman"] + (["pearson_p", "spearman_p"] if p_values else [])
    cal = cal.select(*keys, *[F.col(c).alias(f"{c}_cal") for c in names])
    wide = join_on(join_on(base, auc(df, keys), keys), cal, keys)
    return wide.select(
        *keys, "n", "n1", "n0", *[gated(F.col(c)).alias(c) for c in wide.columns if c not in {*keys, "n", "n1", "n0"}]
    )


# --- regression ----------------------------------------------------------------------------------


def regression_fit(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, RMSE, MAD, R2 and Pearson in one pass; infinite predictions give infinite errors."""
    diff = F.col("pred") - F.col("y")
    finite = ~is_infinite("pred")
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mad"),
        F.var_pop("y").alias("_vy"),
        F.avg(diff * diff).alias("_mse"),
        F.covar_pop(F.when(finite, F.col("pred")), F.when(finite, F.col("y"))).alias("_cov"),
        F.stddev_pop(F.when(finite, F.col("pred"))).alias("_sp"),
        F.stddev_pop("y").alias("_sy"),
        (F.min("y") < F.max("y")).alias("_vary"),
        (F.min("pred") < F.max("pred")).alias("_varp"),
        F.bool_or(is_infinite("pred")).alias("_inf"),
    )
    varies = F.col("_vary")
    return sums.select(
        *keys,
        "n",
        gated(F.col("rmse")).alias("rmse"),
        gated(F.col("mad")).alias("mad"),
        gated(F.when(varies, F.when(F.col("_inf"), F.lit(float("-inf"))).otherwise(1 - ratio("_mse", "_vy")))).alias("r2"),
        gated(
            F.when(varies & F.col("_varp") & ~F.col("_inf"), ratio("_cov", F.col("_sp") * F.col("_sy")))
        ).alias("pearson"),
    )


def with_correlation_p(stats: DataFrame, name: str, alternative: str = "greater") -> DataFrame:
    """Add the one-tail p-value of a correlation column (needs ``n``)."""
    two = correlation_two_tail_p(F.col(name), F.col("n").cast("double"))
    return (
        stats.withColumn("_p2", two)
        .withColumn(f"{name}_p", one_tail_p(F.col(name), F.col("_p2"), alternative))
        .drop("_p2")
    )


def residual() -> Column:
    return F.abs(F.col("y") - F.col("pred"))


def width() -> Column:
    return F.col("upper") - F.col("lower")


def missed() -> Column:
    """The observation is strictly outside its interval."""
    return (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))


def estimated_variance() -> Column:
    return F.pow(width() / 2, 2)


def interval_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Error rate, validity and efficiency (mean width) per group and significance level."""
    return df.groupBy(*keys, "sig_level").agg(
        share(missed()).alias("error_rate"),
        (1 - share(missed())).alias("validity"),
        F.avg(width()).alias("efficiency"),
    )


def expected_calibration_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """ECE: mean over significance levels of |error rate - level|."""
    per_level = interval_statistics(df, keys)
    return per_level.groupBy(*keys).agg(F.avg(F.abs(F.col("error_rate") - F.col("sig_level"))).alias("ece"))


def ence_bins(df: DataFrame, keys: list[str], id_col: str = "id", bin_rows: int = ENCE_BIN_ROWS) -> DataFrame:
    """RMSE and root mean variance per variance-ordered bin of about ``bin_rows`` rows."""
    rows = df.select(
        *keys, id_col, (F.col("pred") - F.col("y")).alias("_err"), estimated_variance().alias("_var")
    )
    placed = ordered.row_positions(rows, keys, "_var", id_col, "_rn").withColumnRenamed("_rn_n", "_n")
    bins = F.greatest(F.floor(F.col("_n") / bin_rows), F.lit(1))
    size, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    at = F.col("_rn") - 1
    # the first n mod b bins hold one row more
    bin_no = F.when(at < extra * (size + 1), F.floor(at / (size + 1))).otherwise(
        extra + F.floor((at - extra * (size + 1)) / size)
    )
    return (
        placed.withColumn("bin", bin_no.cast("bigint"))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(F.col("_err") * F.col("_err"))).alias("rmse"),
            F.sqrt(F.avg("_var")).alias("rmv"),
        )
    )


def ence(df: DataFrame, keys: list[str], id_col: str = "id", bin_rows: int = ENCE_BIN_ROWS) -> DataFrame:
    """Expected normalised calibration error; NULL with infinite variances.

    A bin of zero variances gives inf, but one whose errors are zero as well does not count.
    """
    gap = F.abs(F.col("rmse") - F.col("rmv"))
    term = F.when(F.col("rmv") > 0, gap / F.col("rmv")).when(F.col("rmse") > 0, F.lit(float("inf")))
    return ence_bins(df, keys, id_col, bin_rows).groupBy(*keys).agg(
        F.when(~F.bool_or(is_infinite("rmv")), F.avg(term)).alias("ence")
    )


def width_residual_spearman(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman correlation of interval width and absolute residual; NULL for constant widths."""
    pairs = df.select(*keys, width().alias("_width"), residual().alias("_res"))
    return ordered.spearman(pairs.where(~is_infinite("_width")), keys, "_width", "_res", "scc")


def regression_statistics(df: DataFrame, keys: list[str], level: float = 0.32, id_col: str = "id", p_values: bool = True) -> DataFrame:
    """All regression statistics; ``df`` holds one row per test row and significance level."""
    # five of the six parts need the rows of one level only: they are written once, and narrow
    at_level = df.where(F.abs(F.col("sig_level") - level) < 1e-9)
    at_level = materialise(at_level.select(*keys, id_col, "sig_level", "y", "pred", "lower", "upper"), "level")
    fit = regression_fit(at_level, keys)
    rho = ordered.spearman(at_level, keys, "pred", "y", "spearman")
    of_level = interval_statistics(at_level, keys).drop("sig_level")
    wide = fit
    for part in (rho, of_level, expected_calibration_error(df, keys), ence(at_level, keys, id_col), width_residual_spearman(at_level, keys)):
        wide = join_on(wide, part, keys, "left")
    if p_values:
        wide = with_correlation_p(with_correlation_p(wide, "pearson"), "spearman")
    stats = [c for c in wide.columns if c not in {*keys, "n"}]
    return wide.select(*keys, "n", *[gated(F.col(c)).alias(c) for c in stats])


# --- summaries -----------------------------------------------------------------------------------


def mean_and_deviation(df: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """Mean and sample standard deviation of statistics over folds, per AD status."""
    return df.groupBy(*keys).agg(
        *[F.avg(s).alias(f"{s}_mean") for s in stats], *[F.stddev_samp(s).alias(f"{s}_sd") for s in stats]
    )


def activity_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, median, mean and population standard deviation of a numeric endpoint."""
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
    )
    return join_on(basic, ordered.exact_quantiles(df, keys, value, {"median": 0.5}), keys)


def class_summary(df: DataFrame, keys: list[str], label: str = "y") -> DataFrame:
    """n, actives and inactives of a binary endpoint."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col(label) == 1).alias("actives"),
        count_where(F.col(label) == 0).alias("inactives"),
    )


def fold_and_merged_distribution(df: DataFrame, keys: list[str], fold: str, value: str) -> DataFrame:
    """Mean and sd of a value per fold and over all folds (fold ``merged``), with a text label."""
    both = df.withColumn(fold, F.explode(F.array(F.col(fold).cast("string"), F.lit("merged"))))
    out = both.groupBy(*keys, fold).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    label = F.concat_ws(", ", F.format_number("mean", 2), F.format_number("sd", 2))
    return out.withColumn("label", label)


def to_long(stats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide statistics to (keys, metric, value)."""
    return stats.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        keys, names, "metric", "value"
    )
