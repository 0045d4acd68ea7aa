"""Shift-metrics (Inside minus Outside) and their stratified permutation test.

Scenarios, folds, seeds and redraws are columns: one family of tests is one job. Redraw number -1
is the original split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import order_bucket, order_key
from ..functions.joining import join_on
from ..functions.ordered import running_totals, value_buckets
from ..functions.scalar import is_infinite
from ..sources.shared import materialise, spread
from . import metrics as M, redraws as R

ORIGINAL = -1
MAX_TRIES = 10
STRATA_BINS = 5
# half width of the band in which the quota of a redraw ends: standard deviations, and rows on top
BAND = (6.0, 10.0)

# Expected sign of Inside minus Outside when the domain works (fixed values).
EXPECTED_SIGN = {
    "ba": 1, "mcc": 1, "auc": 1, "kappa": 1,
    "strat_brier": -1, "rmse_cal": -1, "r2_cal": 1, "pearson_cal": 1, "spearman_cal": 1,
    "r2": 1, "pearson": 1, "spearman": 1, "rmse": -1,
    "validity": 1, "efficiency": -1, "ence": -1, "ece": -1, "scc": 1,
}

COUNT_METRICS = ("ba", "mcc", "kappa", "strat_brier")
CALIBRATION_METRICS = ("rmse_cal", "r2_cal", "pearson_cal", "spearman_cal")
VALUE_METRICS = ("rmse", "mad", "r2", "pearson", "spearman", "validity", "efficiency", "ece", "ence", "scc")


def expected_sign(metric="metric") -> Column:
    """Expected sign looked up by metric name."""
    pairs = [F.lit(v) for item in EXPECTED_SIGN.items() for v in item]
    return F.create_map(*pairs)[F.col(metric) if isinstance(metric, str) else metric]


# --- metrics in long form ------------------------------------------------------------------------


def class_metrics(df: DataFrame, keys: list[str], wanted: list[str], delta: float = 0.05) -> DataFrame:
    """(keys, metric, value) of the requested classification metrics; nothing else is computed."""
    unknown = set(wanted) - {*COUNT_METRICS, "auc", *CALIBRATION_METRICS}
    if unknown:
        raise ValueError(f"unknown classification metrics {sorted(unknown)}")
    wide = _count_metrics(M.confusion(df, keys), keys, wanted)
    if "auc" in wanted:
        wide = join_on(wide, M.auc(df, keys), keys, "left")
    calibrated = [m for m in wanted if m in CALIBRATION_METRICS]
    if calibrated:
        cal = M.calibration(df, keys, (delta,), p_values=False)
        wide = join_on(wide, cal.select(*keys, *[F.col(m[: -len("_cal")]).alias(m) for m in calibrated]), keys, "left")
    gated = wide.select(*keys, *[M.gated(F.col(m)).alias(m) for m in wanted])
    return M.to_long(gated, keys, wanted)


def _count_metrics(confusion: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """(keys, n, metrics) of those wanted that follow from the confusion counts and squared losses."""
    forms = {"ba": M.balanced_accuracy(), "mcc": M.mcc(), "kappa": M.kappa(), "strat_brier": M.stratified_brier()}
    return confusion.select(*keys, "n", *[M.gated(forms[m]).alias(m) for m in wanted if m in forms])


def value_metrics(df: DataFrame, keys: list[str], wanted: list[str], level: float = 0.32) -> DataFrame:
    """(keys, metric, value) of the requested regression metrics; rows as in regression_statistics."""
    at_level = df.where(F.abs(F.col("sig_level") - level) < 1e-9)
    if set(wanted) & {"spearman", "ence", "scc"}:  # several passes over the rows
        at_level = materialise(at_level.select(*keys, "id", "sig_level", "y", "pred", "lower", "upper"), "level")
    parts = {
        "fit": (("rmse", "mad", "r2", "pearson"), lambda: M.regression_fit(at_level, keys)),
        "rank": (("spearman",), lambda: M.ordered.spearman(at_level, keys, "pred", "y", "spearman")),
        "level": (("validity", "efficiency"), lambda: M.interval_statistics(at_level, keys).drop("sig_level")),
        "ece": (("ece",), lambda: M.expected_calibration_error(df, keys)),
        "ence": (("ence",), lambda: M.ence(at_level, keys)),
        "scc": (("scc",), lambda: M.width_residual_spearman(at_level, keys)),
    }
    known = {m for names, _ in parts.values() for m in names}
    if set(wanted) - known:
        raise ValueError(f"unknown regression metrics {sorted(set(wanted) - known)}")
    wide = at_level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for names, make in parts.values():
        chosen = [m for m in names if m in wanted]
        if chosen:
            wide = join_on(wide, make().select(*keys, *chosen), keys, "left")
    return M.to_long(wide.select(*keys, *[M.gated(F.col(m)).alias(m) for m in wanted]), keys, wanted)


def metrics_of(kind: str):
    return {"class": class_metrics, "value": value_metrics}[kind]


# --- strata and redraws --------------------------------------------------------------------------


def merge_subsets(inside: DataFrame, outside: DataFrame, id_col: str = "id") -> DataFrame:
    """One id-keyed table with the flag ``inside``; an id on both sides or twice is an error."""
    both = inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))
    counts = both.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    checked = counts.where(F.assert_true(F.col("_n") == 1, F.lit("ids of the subsets overlap")).isNull())
    return join_on(both, checked.drop("_n"), [id_col])


def value_strata(df: DataFrame, keys: list[str], value: str = "y", bins: int = STRATA_BINS) -> DataFrame:
    """Add ``stratum``: equal-width bins of the Inside values, applied to both sides.

    Fewer bins when Inside has fewer distinct values (at least two); outside values are clipped.
    """
    inside = F.when(F.col("inside"), F.col(value))
    span = df.groupBy(*keys).agg(
        F.min(inside).alias("_lo"),
        F.max(inside).alias("_hi"),
        F.greatest(F.lit(2), F.least(F.lit(bins), F.count_distinct(inside))).alias("_b"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("_b")
    at = F.floor((F.col(value) - F.col("_lo")) / width)
    clipped = F.least(F.greatest(at, F.lit(0)), F.col("_b") - 1)
    stratum = F.when(F.col("_hi") > F.col("_lo"), clipped).otherwise(0).cast("int")
    return join_on(df, span, keys).withColumn("stratum", stratum).drop("_lo", "_hi", "_b")


def _one_sided(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Redraws where a side lacks variety in y or in the score."""

    def varied(col: str, side: Column) -> Column:
        v = F.when(side, F.col(col))
        return F.coalesce(F.min(v) < F.max(v), F.lit(False))

    checks = [varied(c, s) for c in ("y", score) for s in (F.col("inside"), ~F.col("inside"))]
    ok = df.groupBy(*keys).agg(reduce(lambda a, b: a & b, checks).alias("_ok"))
    return ok.where(~F.col("_ok")).drop("_ok")


def _constant_observed(df: DataFrame, keys: list[str], delta: float) -> DataFrame:
    """Redraws where the observed probabilities of a side are constant."""
    points = M.observed_probability(df.withColumn("delta", F.lit(delta)), [*keys, "inside"])
    side = points.groupBy(*keys, "inside").agg((F.min("observed") < F.max("observed")).alias("_ok"))
    return side.where(~F.col("_ok")).select(*keys).distinct()


def redraw(
    df: DataFrame,
    keys: list[str],
    n: int,
    seed: int,
    score: str = "prob",
    id_col: str = "id",
    method: str = "xxhash64",
    delta: float | None = None,
) -> DataFrame:
    """``n`` random re-assignments of Inside / Outside that keep every stratum's Inside size.

    ``df`` has the keys, id, y, score, ``stratum`` and ``inside``; the result has ``perm`` and the
    new ``inside``. A redraw without variety on a side is drawn again, at most ten times in all;
    with ``delta`` also one with constant observed probabilities.
    """
    group = [*keys, "perm"]
    sizes = df.groupBy(*keys, "stratum").agg(
        F.count_if(F.col("inside")).alias("_quota"), F.count(F.lit(1)).alias("_size")
    )
    quota = materialise(sizes, "quota")
    largest = quota.agg(F.max("_size")).first()[0] or 0
    digits = 1 if largest < 100_000 else 3  # 16 or 4096 hash buckets per group
    quota = quota.drop("_size")
    rows = spread(df.drop("inside"))
    wanted = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kept = []
    for attempt in range(MAX_TRIES):
        parts = [F.col(id_col), *[F.col(k) for k in group], F.lit(seed), F.lit(attempt)]
        keyed = wanted.withColumn("_h", order_key(parts, method))
        drawn = materialise(smallest_by_hash(keyed, [*group, "stratum"], quota, [*keys, "stratum"], id_col, digits), "redraw")
        failed = _one_sided(drawn, group, score)
        if delta is not None:
            failed = failed.unionByName(_constant_observed(drawn, group, delta)).distinct()
        failed = materialise(failed, "failed")
        if attempt == MAX_TRIES - 1 or failed.isEmpty():
            kept.append(drawn)
            break
        kept.append(join_on(drawn, failed, group, "left_anti"))
        wanted = join_on(rows, failed, keys)
    return reduce(lambda a, b: a.unionByName(b), kept)


def smallest_by_hash(keyed: DataFrame, group: list[str], quota: DataFrame, quota_keys: list[str], id_col: str, digits: int = 2) -> DataFrame:
    """Mark the ``_quota`` rows of each group with the smallest hash ``_h`` as ``inside``.

    Counts per hash bucket show in which bucket a quota ends. Rows of other buckets are decided
    where they are; only the rows of that one bucket are ranked, so a group's rows are neither
    shuffled nor sorted as a whole.
    """
    columns = [c for c in keyed.columns if c != "_h"]
    cut = keyed.withColumn("_b", order_bucket(F.col("_h"), digits))
    counts = cut.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("_cum", F.sum("_c").over(order))
    upto = join_on(upto, quota, quota_keys)
    # the first bucket whose running count reaches the quota (none for a quota of zero)
    before = F.col("_cum") - F.col("_c")
    edge = upto.where((before < F.col("_quota")) & (F.col("_quota") <= F.col("_cum"))).select(
        *group, F.col("_b").alias("_edge"), (F.col("_quota") - before).alias("_left")
    )
    placed = join_on(cut, materialise(edge, "edges"), group, "left")
    sure = placed.where(F.col("_edge").isNull() | (F.col("_b") != F.col("_edge"))).select(
        *columns, F.coalesce(F.col("_b") < F.col("_edge"), F.lit(False)).alias("inside")
    )
    rank = F.row_number().over(W.partitionBy(*group).orderBy("_h", id_col))
    split = placed.where(F.col("_b") == F.col("_edge")).withColumn("_rn", rank)
    return sure.unionByName(split.select(*columns, (F.col("_rn") <= F.col("_left")).alias("inside")))


def permuted_confusion(
    strata: DataFrame, keys: list[str], n: int, seed: int, score: str = "prob", id_col: str = "id", method: str = "xxhash64"
) -> DataFrame:
    """Confusion counts and losses of both sides of ``n`` redraws: (keys, perm, subset, n, n1, ...).

    The same redraws as ``redraw`` makes, but no copy of a row is written or shuffled: ``redraws`` works out
    the hashes of its rows in all redraws within a task, as a matrix, and adds up there.
    """
    y, hit = F.col("y").cast("int"), M.predicted_class(score)
    loss = (F.col(score) - F.col("y")) * (F.col(score) - F.col("y"))
    sums = {"s1": F.when(y == 1, loss), "s0": F.when(y == 0, loss)}
    for name, (a, b) in {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}.items():
        sums[name] = ((y == a) & (hit == b)).cast("int")
    varied = {"_y": y, "_score": F.col(score)}
    lay = R.layout(strata, keys, sums | varied, seed, id_col, order=R.Hashed(method, n, seed), optional=tuple(varied))
    drawn = R.draw(lay, keys, n, list(sums), list(varied), band=BAND)

    def counts(c):
        out = {x: c(x).cast("bigint") for x in ("tp", "fp", "tn", "fn")}
        n1, n0 = out["tp"] + out["fn"], out["fp"] + out["tn"]
        brier = F.try_divide(c("s1") + c("s0"), (n1 + n0).cast("double"))
        losses = {"brier": brier, "loss_1": F.try_divide(c("s1"), n1.cast("double")), "loss_0": F.try_divide(c("s0"), n0.cast("double"))}
        return {"n": n1 + n0, "n1": n1, "n0": n0} | out | losses

    return _for_sides(drawn.sums, keys, counts).where(F.col("n") > 0)


def with_original(df: DataFrame, redraws: DataFrame | None) -> DataFrame:
    """Original split (perm -1) and redraws, with ``subset`` Inside / Outside."""
    both = df.withColumn("perm", F.lit(ORIGINAL))
    both = both if redraws is None else both.unionByName(redraws)
    return both.withColumn("subset", F.when(F.col("inside"), "Inside").otherwise("Outside"))


# --- shifts and p-values ---------------------------------------------------------------------------


def shift_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, inside_value, outside_value, shift) from values per subset.

    NULL when a side is missing or both are infinite; one infinite side stays infinite.
    """
    side = lambda name: F.max(F.when(F.col("subset") == name, F.col("value")))
    wide = long.groupBy(*keys, "metric").agg(side("Inside").alias("inside_value"), side("Outside").alias("outside_value"))
    a, b = F.col("inside_value"), F.col("outside_value")
    return wide.withColumn("shift", F.when(~(is_infinite(a) & is_infinite(b)), a - b))


def shift_p_values(shifts: DataFrame, keys: list[str], tails=("one", "two")) -> DataFrame:
    """(keys, metric, tail, shift, p): share of redraws at least as extreme as the original.

    One tail counts in the expected direction, two tails by absolute value. Missing redraws do not
    count; p is NULL without an original shift.
    """
    original = shifts.where(F.col("perm") == ORIGINAL).select(*keys, "metric", F.col("shift").alias("_orig"))
    random = shifts.where(F.col("perm") != ORIGINAL).select(*keys, "metric", F.col("shift").alias("_rand"))
    tail = F.explode(F.array(*[F.lit(t) for t in tails])).alias("tail")
    pairs = join_on(original, random, [*keys, "metric"], "left").select("*", tail)
    one = F.col("tail") == "one"
    seen = F.when(one, F.col("_rand") * expected_sign()).otherwise(F.abs("_rand"))
    own = F.when(one, F.col("_orig") * expected_sign()).otherwise(F.abs("_orig"))
    extreme = F.when(F.col("_rand").isNotNull(), (seen >= own).cast("double"))
    return pairs.groupBy(*keys, "metric", "tail").agg(F.max("_orig").alias("shift"), F.avg(extreme).alias("p"))


def redraw_limits(shifts: DataFrame, keys: list[str], two_tail: bool = False) -> DataFrame:
    """Box-plot limits of the random shifts: 5 / 95 %, or 2.5 / 97.5 % for two tails.

    A group holds one value per redraw, a fixed small number.
    """
    lo, hi = (0.025, 0.975) if two_tail else (0.05, 0.95)
    random = shifts.where(F.col("perm") != ORIGINAL)
    return random.groupBy(*keys, "metric").agg(
        F.expr(f"percentile(shift, {lo}D)").alias("low"), F.expr(f"percentile(shift, {hi}D)").alias("high")
    )


def aggregate_p(p="p") -> Column:
    """Aggregate over folds and seeds: twice the mean, at most 1; missing values are ignored."""
    return F.least(F.lit(1.0), 2 * F.avg(p))


def wrong_sign(shift="average_shift", metric="metric") -> Column:
    """The average shift does not have the expected sign (zero counts as wrong)."""
    return F.col(shift) * expected_sign(metric) <= 0


def family_p_values(p_values: DataFrame, scenario: list[str], runs: list[str]) -> DataFrame:
    """One row per scenario, metric and tail over all its folds and seeds (few per scenario)."""
    entry = lambda c: F.struct(*runs, F.coalesce(F.format_string("%.6f", c), F.lit("nan")).alias("v"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(entry(c))), lambda e: e["v"]), ";")
    out = p_values.groupBy(*scenario, "metric", "tail").agg(
        aggregate_p().alias("p"),
        F.avg("shift").alias("average_shift"),
        text("p").alias("all_p"),
        text("shift").alias("all_shifts"),
    )
    flag = F.when((F.col("tail") == "one") & F.col("average_shift").isNotNull(), wrong_sign())
    return out.withColumn("wrong_sign", flag)


def permutation_test(
    df: DataFrame,
    keys: list[str],
    wanted: list[str],
    n: int = 1000,
    seed: int = 42,
    kind: str = "class",
    method: str = "remix",
    tails=("one", "two"),
    delta: float = 0.05,
    drawn_by: list[str] | None = None,
) -> DataFrame:
    """p-values of the requested shift-metrics for every group: (keys, metric, tail, shift, p).

    With the method ``remix`` no row is copied for a redraw, but for the calibration metrics; groups of one
    ``drawn_by`` (some of the keys, by default all) then share the order in which rows are drawn. Groups in
    which no requested metric can be computed are dropped before any redraw.
    """
    return shift_p_values(permuted_shifts(df, keys, wanted, n, seed, kind, method, delta, drawn_by), keys, tails)


def permuted_shifts(df, keys, wanted, n=1000, seed=42, kind="class", method="xxhash64", delta=0.05, drawn_by=None) -> DataFrame:
    """Shift-metrics of the original split and of all redraws: (keys, perm, metric, shift)."""
    score = "prob" if kind == "class" else "pred"
    extra = [] if kind == "class" else [c for c in ("lower", "upper", "sig_level") if c in df.columns]
    rows = df.select(*keys, "id", "y", score, "inside", *extra)
    per_row = rows if not extra else _per_row(rows, keys)
    strata = per_row.withColumn("stratum", F.col("y")) if kind == "class" else value_strata(per_row, keys)
    sizes = strata.groupBy(*keys).agg(
        F.count_if(F.col("inside")).alias("_i"), F.count_if(~F.col("inside")).alias("_o")
    )
    usable = sizes.where((F.col("_i") >= M.MIN_ROWS) & (F.col("_o") >= M.MIN_ROWS)).select(*keys)
    strata = join_on(strata, usable, keys, "left_semi")
    if method == "remix":
        copied = [m for m in wanted if m in CALIBRATION_METRICS]
        others = [m for m in wanted if m not in copied]
        found = [permuted_shifts(df, keys, copied, n, seed, kind, "xxhash64", delta)] if copied else []
        if others:
            values = drawn_class_values(strata, keys, others, n, seed, drawn_by) if kind == "class" else drawn_value_metrics(strata, rows, keys, others, n, seed)
            found.append(shift_metrics(values, [*keys, "perm"]).select(*keys, "perm", "metric", "shift"))
        return materialise(reduce(lambda a, b: a.unionByName(b), found), "shifts")
    if kind == "class" and set(wanted) <= set(COUNT_METRICS):
        values = _counted_values(strata, keys, wanted, n, seed, score, method)
        return materialise(shift_metrics(values, [*keys, "perm"]).select(*keys, "perm", "metric", "shift"), "shifts")
    check = delta if kind == "class" and set(wanted) & set(CALIBRATION_METRICS) - {"rmse_cal"} else None
    drawn = redraw(strata, keys, n, seed, score, method=method, delta=check)
    both = with_original(strata, drawn).drop("stratum", "inside")
    group = [*keys, "perm", "subset"]
    if extra:  # intervals per significance level come back by row id
        both = join_on(both.select(*keys, "id", "perm", "subset"), rows.drop("inside").hint("merge"), [*keys, "id"])
    values = metrics_of(kind)(both, group, wanted)
    return materialise(shift_metrics(values, [*keys, "perm"]).select(*keys, "perm", "metric", "shift"), "shifts")


def _counted_values(strata: DataFrame, keys: list[str], wanted: list[str], n: int, seed: int, score: str, method: str) -> DataFrame:
    group = [*keys, "perm", "subset"]
    own = with_original(strata.select(*keys, "id", "y", score, "inside"), None)
    counted = M.confusion(own, group).unionByName(permuted_confusion(strata, keys, n, seed, score, method=method))
    return M.to_long(_count_metrics(counted, group, wanted), group, wanted)


def _for_sides(sums: DataFrame, keys: list[str], columns) -> DataFrame:
    """(keys, perm, subset, columns) of both sides; ``columns`` makes them from a function of a sum's name."""
    sides = []
    for side, subset in (("in", "Inside"), ("out", "Outside")):
        made = columns(lambda name, side=side: F.col(f"{side}_{name}"))
        sides.append(sums.select(*keys, "perm", F.lit(subset).alias("subset"), *[v.alias(k) for k, v in made.items()]))
    return sides[0].unionByName(sides[1])


def drawn_class_values(strata: DataFrame, keys: list[str], wanted: list[str], n: int, seed: int, drawn_by: list[str] | None = None) -> DataFrame:
    """(keys, perm, subset, metric, value) of count metrics and AUC, original split and redraws, by ``redraws``."""
    group = [*keys, "perm", "subset"]
    own = class_metrics(with_original(strata.select(*keys, "id", "y", "prob", "inside"), None), group, wanted)
    hit, y = M.predicted_class("prob"), F.col("y")
    loss = (F.col("prob") - y) * (F.col("prob") - y)
    values = {"y": y, "prob": F.col("prob"), "s1": F.when(y == 1, loss), "s0": F.when(y == 0, loss)}
    for name, (a, b) in {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}.items():
        values[name] = ((y == a) & (hit == b)).cast("int")
    drawn = R.draw(R.layout(strata, keys, values, seed, drawn_by=drawn_by), keys, n, [v for v in values if v not in ("y", "prob")], ["y", "prob"], by_stratum=True)

    def confusion(c):
        counts = {x: c(x).cast("long") for x in ("tp", "fp", "tn", "fn")}
        n1, n0 = counts["tp"] + counts["fn"], counts["fp"] + counts["tn"]
        out = counts | {"n": c("n").cast("long"), "n1": n1, "n0": n0}
        return out | {"loss_1": F.try_divide(c("s1"), n1.cast("double")), "loss_0": F.try_divide(c("s0"), n0.cast("double"))}

    counted = _for_sides(drawn.sums, keys, confusion)
    some = [m for m in wanted if m in COUNT_METRICS]
    parts = [own]
    if some:
        parts.append(M.to_long(_count_metrics(counted, group, some), group, some))
    if "auc" in wanted:
        ranked = join_on(R.auc_per_redraw(drawn, keys), counted.select(*group, "n"), group)
        parts.append(ranked.select(*group, F.lit("auc").alias("metric"), M.gated(F.col("value")).alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def drawn_value_metrics(strata: DataFrame, rows: DataFrame, keys: list[str], wanted: list[str], n: int, seed: int, level: float = 0.32) -> DataFrame:
    """(keys, perm, subset, metric, value) of regression metrics, original split and redraws, by ``redraws``.

    ``rows`` has one row per id and significance level, ``strata`` one per id.
    """
    if set(wanted) - set(VALUE_METRICS):
        raise ValueError(f"unknown regression metrics {sorted(set(wanted) - set(VALUE_METRICS))}")
    group = [*keys, "perm", "subset"]
    split = with_original(strata.select(*keys, "id", "inside"), None).select(*keys, "id", "perm", "subset")
    # tables of all ids look small to the planner, as compressed files are, and would be broadcast
    own = value_metrics(join_on(split, rows.drop("inside").hint("merge"), [*keys, "id"]), group, wanted, level)
    # levels are a parameter of the intervals, a few numbers
    levels = sorted(r[0] for r in rows.select("sig_level").distinct().collect() if r[0] is not None)
    at = {k: F.abs(F.col("sig_level") - x) < 1e-9 for k, x in enumerate(levels)}
    wide = M.width()
    per_level = []
    for k, here in at.items():
        per_level += [
            F.max(F.when(here, 1).otherwise(0)).alias(f"held{k}"),
            F.max(F.when(here, M.missed().cast("int"))).alias(f"missed{k}"),
            F.max(F.when(here & ~is_infinite(wide), wide)).alias(f"width{k}"),
            F.max(F.when(here, is_infinite(wide).cast("int"))).alias(f"endless{k}"),
        ]
    chosen = next((k for k, x in enumerate(levels) if abs(x - level) < 1e-9), None)
    if chosen is None:
        return own
    pivoted = rows.groupBy(*keys, "id").agg(*per_level)
    # sums of squares lose nothing if values lie around zero
    finite = F.when(~is_infinite("pred"), F.col("pred"))
    means = strata.groupBy(*keys).agg(F.avg("y").alias("_my"), F.avg(finite).alias("_mp"))
    table = join_on(join_on(strata, pivoted.hint("merge"), [*keys, "id"]), materialise(means, "means"), keys)
    held, infinite = F.col(f"held{chosen}"), is_infinite("pred")
    y, p, d = F.col("y") - F.col("_my"), F.when(infinite, 0.0).otherwise(F.col("pred") - F.col("_mp")), F.col("pred") - F.col("y")
    error = F.when(infinite, 0.0).otherwise(d)
    sums = {
        "held": held, "infinite": held * infinite.cast("int"), "dd": held * error * error, "d": held * F.abs(error),
        "y1": held * y, "yy": held * y * y, "p1": held * p, "pp": held * p * p, "yp": held * y * p,
    } | {f"{name}{k}": F.col(f"{name}{k}") for k in at for name in ("held", "missed", "width", "endless")}
    half = F.when(F.col(f"endless{chosen}") == 1, float("inf")).otherwise(F.col(f"width{chosen}") / 2)
    tie = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    values = sums | {"y": F.col("y"), "pred": F.col("pred"), "error": d, "variance": half * half, "residual": F.abs(d), "tie": tie}
    drawn = R.draw(R.layout(table, keys, values, seed), keys, n, list(sums), ["y", "pred"])

    def statistics(c):
        n = c("held")

        def mean(name):
            return F.try_divide(c(name), n)

        vy, vp = mean("yy") - mean("y1") * mean("y1"), mean("pp") - mean("p1") * mean("p1")
        vary, some = c("y_low") < c("y_high"), c("infinite") > 0
        endless = lambda value, flag: F.when(flag, float("inf")).otherwise(value)
        gaps = F.array(*[F.abs(F.try_divide(c(f"missed{k}"), c(f"held{k}")) - F.lit(x)) for k, x in enumerate(levels)])
        gaps = F.filter(gaps, lambda x: x.isNotNull())
        return {
            "n": n,
            "rmse": endless(F.sqrt(mean("dd")), some),
            "mad": endless(mean("d"), some),
            "r2": F.when(vary, F.when(some, float("-inf")).otherwise(1 - F.try_divide(mean("dd"), vy))),
            "pearson": F.when(vary & (c("pred_low") < c("pred_high")) & ~some, F.try_divide(mean("yp") - mean("y1") * mean("p1"), F.sqrt(vp) * F.sqrt(vy))),
            "validity": 1 - F.try_divide(c(f"missed{chosen}"), n),
            "efficiency": endless(F.try_divide(c(f"width{chosen}"), n), c(f"endless{chosen}") > 0),
            "ece": F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(gaps).cast("double"))),
        }

    wide = materialise(_for_sides(drawn.sums, keys, statistics), "side-metrics")
    summed = [m for m in wanted if m in wide.columns]
    parts = [own]
    if summed:
        parts.append(M.to_long(wide.select(*group, *[M.gated(F.col(m)).alias(m) for m in summed]), group, summed))
    here = F.col("held") == 1
    ranked = {
        "spearman": lambda: R.spearman_per_redraw(drawn, keys, "pred", "y", here),
        "scc": lambda: R.spearman_per_redraw(drawn, keys, "variance", "residual", here & ~is_infinite("variance")),
        "ence": lambda: R.ence_per_redraw(drawn, keys, "variance", "error", "tie", M.ENCE_BIN_ROWS, here),
    }
    for name, make in ranked.items():
        if name in wanted:
            found = join_on(make(), wide.select(*group, "n"), group)
            parts.append(found.select(*group, F.lit(name).alias("metric"), M.gated(F.col("value")).alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def metrics_per_redraw(df: DataFrame, keys: list[str], wanted: list[str], n: int = 1000, seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """Count metrics of both sides of the original split (perm -1) and of every redraw: (keys, perm, subset, metric, value)."""
    if not set(wanted) <= set(COUNT_METRICS):
        raise ValueError("only metrics of the confusion counts and losses")
    strata = df.select(*keys, "id", "y", "prob", "inside", F.col("y").alias("stratum"))
    return _counted_values(strata, keys, wanted, n, seed, "prob", method)


def value_metrics_per_redraw(df: DataFrame, keys: list[str], wanted: list[str], n: int = 1000, seed: int = 42, level: float = 0.32) -> DataFrame:
    """Regression metrics of both sides of the original split (perm -1) and of every redraw: (keys, perm, subset, metric, value).

    ``df`` has one row per id and significance level.
    """
    rows = df.select(*keys, "id", "y", "pred", "inside", "lower", "upper", "sig_level")
    return drawn_value_metrics(value_strata(_per_row(rows, keys), keys), rows, keys, wanted, n, seed, level)


def _per_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per id of a table with one row per id and significance level."""
    return rows.groupBy(*keys, "id").agg(
        F.any_value("y").alias("y"), F.any_value("pred").alias("pred"), F.any_value("inside").alias("inside")
    )


# --- metrics that cannot be computed -----------------------------------------------------------------


def class_rule_flags(df: DataFrame, keys: list[str], delta: float = 0.05) -> DataFrame:
    """Reasons why classification metrics may be missing, as flags per group."""
    base = M.confusion(df, keys)
    points = M.observed_probability(df.withColumn("delta", F.lit(delta)), keys)
    same = points.groupBy(*keys).agg((F.min("observed") == F.max("observed")).alias("constant_observed"))
    return join_on(base, same, keys, "left").select(
        *keys,
        (F.col("n") < M.MIN_ROWS).alias("too_few"),
        ((F.col("n1") == 0) | (F.col("n0") == 0)).alias("one_class"),
        (F.col("n1") == 0).alias("no_class_1"),
        (F.col("n0") == 0).alias("no_class_0"),
        (F.col("tp") + F.col("fp") == 0).alias("no_predicted_1"),
        (F.col("tn") + F.col("fn") == 0).alias("no_predicted_0"),
        F.coalesce("constant_observed", F.lit(True)).alias("constant_observed"),
    )


def value_rule_flags(df: DataFrame, keys: list[str], level: float = 0.32) -> DataFrame:
    """Reasons why regression metrics may be missing or infinite, as flags per group."""
    rows = df.where(F.abs(F.col("sig_level") - level) < 1e-9)
    wide = M.width()
    return rows.groupBy(*keys).agg(
        (F.count(F.lit(1)) < M.MIN_ROWS).alias("too_few"),
        (F.min("y") == F.max("y")).alias("constant_y"),
        (F.min("pred") == F.max("pred")).alias("constant_prediction"),
        (F.min(wide) == F.max(wide)).alias("constant_width"),
        (F.max(wide) == 0).alias("zero_width"),
        F.bool_or(wide == 0).alias("some_zero_width"),
    )


# Flags that explain a missing value of a metric, besides too_few (fixed values).
MISSING_RULES = {
    "ba": ["one_class"], "mcc": ["one_class"], "auc": ["one_class"], "kappa": ["one_class"],
    "strat_brier": ["one_class"], "rmse_cal": [],
    "r2_cal": ["one_class", "constant_observed"], "pearson_cal": ["one_class", "constant_observed"],
    "spearman_cal": ["one_class", "constant_observed"],
    "recall_1": ["no_class_1"], "recall_0": ["no_class_0"],
    "precision_1": ["no_predicted_1"], "precision_0": ["no_predicted_0"],
    "rmse": [], "validity": [], "efficiency": [], "ece": [], "ence": [],
    "r2": ["constant_y"], "pearson": ["constant_y", "constant_prediction"],
    "spearman": ["constant_y", "constant_prediction"], "scc": ["zero_width", "constant_width"],
}


def not_computable(flags: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """(keys, metric, reasons) for every metric that the flags rule out."""
    known = set(flags.columns)
    entries = []
    for metric in wanted:
        rules = [r for r in ["too_few", *MISSING_RULES[metric]] if r in known]
        reasons = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules]), lambda r: r.isNotNull())
        entries.append(F.struct(F.lit(metric).alias("metric"), reasons.alias("reasons")))
    long = flags.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.metric", "_e.reasons")
    return long.where(F.size("reasons") > 0)


def unexpected_missing(long: DataFrame, ruled_out: DataFrame, keys: list[str]) -> DataFrame:
    """Missing metric values that no rule explains."""
    return join_on(long.where(F.col("value").isNull()), ruled_out, [*keys, "metric"], "left_anti")


def unexpected_infinite(long: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Infinite values; only ENCE may be infinite, and only with zero-width intervals."""
    infinite = join_on(long.where(is_infinite("value")), flags.select(*keys, "some_zero_width"), keys, "left")
    expected = (F.col("metric") == "ence") & F.coalesce("some_zero_width", F.lit(False))
    return infinite.where(~expected).drop("some_zero_width")


# --- false discovery ---------------------------------------------------------------------------------


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: the series of the digamma function at n + 20, less the last 20 terms."""
    x = n.cast("double") + 20
    y = 1 / (x * x)
    series = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - y / 12 + y * y / 120 - y * y * y / 252 + y * y * y * y / 240
    return series - reduce(lambda a, b: a + b, [1 / (n + i) for i in range(1, 21)])


def adjust_p_values(df: DataFrame, keys: list[str], p: str = "p", out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Yekutieli adjustment within each family; missing p-values stay missing.

    Works on the distinct p-values: equal ones share the adjustment of their last rank.
    """
    values = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    placed = value_buckets(values, keys, p).withColumnRenamed("_bucket", "_b")
    ranked = running_totals(placed, keys, [p], {"_rank": "_c"}, bucket=F.col("_b"), totals={"_m": "_c"})
    bucketed = ranked.withColumn("_q", F.col(p) * F.col("_m") * harmonic(F.col("_m")) / F.col("_rank"))
    # smallest value from here to the largest p: later buckets, then the rest of the own bucket
    least = bucketed.groupBy(*keys, "_b").agg(F.min("_q").alias("_min"))
    after = W.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = least.select(*keys, "_b", F.min("_min").over(after).alias("_later"))
    inside = W.partitionBy(*keys, "_b").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    own = join_on(bucketed.withColumn("_own", F.min("_q").over(inside)), later, [*keys, "_b"])
    adjusted = own.select(*keys, p, F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias(out))
    return join_on(df, adjusted, [*keys, p], "left").select(*df.columns, out)


def is_significant(p: Column, level: float = 0.05) -> Column:
    """p-values are compared after rounding to two decimals; missing ones are not significant."""
    return F.coalesce(F.round(p, 2) <= level, F.lit(False))


def tails_side_by_side(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per scenario and metric with raw and adjusted p of both tails and the sign flag."""
    pick = lambda c, tail: F.max(F.when(F.col("tail") == tail, F.col(c)))
    return adjusted.groupBy(*keys, "metric").agg(
        pick("p", "one").alias("one_raw"),
        pick("p_adjusted", "one").alias("one_adjusted"),
        pick("p", "two").alias("two_raw"),
        pick("p_adjusted", "two").alias("two_adjusted"),
        F.bool_or("wrong_sign").alias("wrong_sign"),
        F.max("average_shift").alias("average_shift"),
    )


def significance_counts(wide: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Scenarios with p-values, and how many are significant with the right or wrong sign."""
    one, two = is_significant(F.col("one_adjusted")), is_significant(F.col("two_adjusted"))
    return wide.where(F.col("two_adjusted").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(two).alias("two_tail_significant"),
        F.count_if(two & F.col("wrong_sign")).alias("two_tail_significant_wrong_sign"),
        F.count_if(one & ~F.col("wrong_sign")).alias("one_tail_significant_right_sign"),
    )


def significance_label(level: float = 0.05) -> Column:
    """``**`` / ``*`` adjusted / raw one-tail, ``xx`` / ``x`` two-tail with the wrong sign."""
    right, wrong = ~F.col("wrong_sign"), F.col("wrong_sign")
    one = lambda c: is_significant(F.when(right, F.col(c)), level)
    two = lambda c: is_significant(F.when(wrong, F.col(c)), level)
    return (
        F.when(one("one_raw") & one("one_adjusted"), "**")
        .when(one("one_raw"), "*")
        .when(two("two_raw") & two("two_adjusted"), "xx")
        .when(two("two_raw"), "x")
        .otherwise("")
    )


def complete_subsets(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subset, n) with a zero row for a side that has no rows."""
    counts = df.groupBy(*keys).agg(
        F.count_if(F.col("inside")).alias("Inside"), F.count_if(~F.col("inside")).alias("Outside")
    )
    return counts.unpivot(keys, ["Inside", "Outside"], "subset", "n")
