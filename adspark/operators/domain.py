"""Applicability domain: inside / outside status of test rows against training rows.

Four methods: a 1-NN similarity threshold, dk-NN (per-row distance thresholds), nUNC (p-value of
the mean neighbour distance) and RDN (dk-NN thresholds weighted by model agreement).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joining import join_on
from ..functions.ordered import exact_quantiles
from ..functions.scalar import Z_UPPER_5_PERCENT, normal_upper_tail, ratio
from ..sources.shared import materialise
from .neighbours import (
    Layout,
    Space,
    any_within,
    attach,
    back_to_rows,
    distinct_points,
    lay_out,
    nearest_points,
    sum_within,
)


def mean_of(values) -> Column:
    """Mean of an array column."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def nearest_distances(train: DataFrame, test: DataFrame | None, space: Space, k: int) -> DataFrame:
    """(keys, id, dists): ascending distances to the k nearest (other) training rows."""
    reference = lay_out(train, space)
    queries = None if test is None else lay_out(test, space, reference.pivots)
    near = nearest_points(reference, queries, k)
    rows, layout = (train, reference) if test is None else (test, queries)
    return back_to_rows(rows, layout, near, ["dists"])


def nearest_mean(train: DataFrame, test: DataFrame | None, space: Space, k: int) -> DataFrame:
    """Mean distance to the k nearest (other) training rows: (keys, id, d_mean)."""
    near = nearest_distances(train, test, space, k)
    return near.select(*space.keys, space.id, mean_of("dists").alias("d_mean"))


@dataclass
class Prepared:
    """Layouts and neighbour lists of a training and a test side, worked out once for several methods."""

    train: Layout
    test: Layout
    own: DataFrame
    new: DataFrame


def prepare(train: DataFrame, test: DataFrame, space: Space, k: int) -> Prepared:
    """What the methods share: points of both sides and the ``k`` nearest training rows of every point."""
    reference = lay_out(train, space)
    queries = lay_out(test, space, reference.pivots)
    return Prepared(reference, queries, nearest_points(reference, None, k), nearest_points(reference, queries, k))


# --- 1-NN similarity -------------------------------------------------------------------------


def nearest_status(train: DataFrame, test: DataFrame, space: Space, thresholds: list[float]) -> DataFrame:
    """(keys, id, ad_param, inside): some training row is strictly nearer than the threshold."""
    near = nearest_distances(train, test, space, 1)
    param = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("ad_param")
    nearest = F.element_at("dists", 1)
    return near.select(*space.keys, space.id, nearest.alias("_d"), param).select(
        *space.keys, space.id, "ad_param", (F.col("_d") < F.col("ad_param")).alias("inside")
    )


# --- nUNC ------------------------------------------------------------------------------------


def nunc_training_stats(near: DataFrame, space: Space, value: Column, weight: Column | None = None) -> DataFrame:
    """Mean and population standard deviation of the training rows' mean distances.

    Rows may stand for ``weight`` copies; the deviation is taken around the mean in a second
    pass, so that it does not lose digits.
    """
    w = F.lit(1) if weight is None else weight
    base = near.select(*space.keys, value.alias("_v"), w.alias("_w"))
    mean = base.groupBy(*space.keys).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("mu"))
    dev = (F.col("_v") - F.col("mu")) * (F.col("_v") - F.col("mu"))
    return (
        attach(base, mean, space.keys)
        .groupBy(*space.keys, "mu")
        .agg(F.sqrt(F.sum(dev * F.col("_w")) / F.sum("_w")).alias("sigma"))
    )


def nunc_status(train: DataFrame, test: DataFrame, space: Space, ks: list[int], shared: Prepared | None = None) -> DataFrame:
    """(keys, id, ad_param, d_mean, z, inside): inside iff the upper tail of z exceeds 5 %."""
    shared = shared or prepare(train, test, space, max(ks))
    own = shared.own
    new = back_to_rows(test, shared.test, shared.new, ["dists"])
    means = lambda: F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), mean_of(F.slice("dists", 1, k)).alias("m")) for k in ks])
    ).alias("_m")
    long = own.select(*space.keys, "weight", means()).select(*space.keys, "weight", "_m.k", "_m.m")
    by_k = replace(space, by=(*space.by, "k"))
    stats = nunc_training_stats(long, by_k, F.col("m"), F.col("weight"))
    scored = new.select(*space.keys, space.id, means()).select(*space.keys, space.id, "_m.k", "_m.m")
    scored = join_on(scored, stats, [*space.keys, "k"])
    sigma = F.when(F.col("sigma") == 0, F.lit(1e-10)).otherwise(F.col("sigma"))
    z = (F.col("m") - F.col("mu")) / sigma
    return scored.select(
        *space.keys,
        space.id,
        F.col("k").alias("ad_param"),
        F.col("m").alias("d_mean"),
        z.alias("z"),
        (z < Z_UPPER_5_PERCENT).alias("inside"),
    )


def with_p_value(status: DataFrame, z: str = "z", out: str = "p_value") -> DataFrame:
    """Add the p-value of a z-score."""
    return status.withColumn(out, normal_upper_tail(F.col(z)))


# --- dk-NN -----------------------------------------------------------------------------------


def reference_values(near: DataFrame, space: Space, ks: list[int]) -> DataFrame:
    """(keys, radii): Q3 + 1.5 (Q3 - Q1) of the training rows' mean distances, one per k."""
    means = F.array(*[mean_of(F.slice("dists", 1, k)) for k in ks])
    long = near.select(*space.keys, "weight", F.posexplode(means).alias("j", "_v"))
    quart = exact_quantiles(long, [*space.keys, "j"], "_v", {"q1": 0.25, "q3": 0.75}, weight="weight")
    radius = F.struct("j", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("r"))
    per_group = quart.groupBy(*space.keys).agg(F.sort_array(F.collect_list(radius)).alias("_rs"))
    return materialise(per_group.select(*space.keys, F.transform("_rs", lambda s: s["r"]).alias("radii")), "radii")


def point_limits(train: Layout, ks: list[int], nearest_only: bool = False, fill_zero: bool = True, own: DataFrame | None = None) -> DataFrame:
    """(keys, point, limits): one distance threshold per k for every training point.

    The threshold is the mean distance to *all* other training rows within the reference value
    (only the k nearest when ``nearest_only``); 0 if there are none, then replaced by the
    smallest non-zero threshold of the group.
    """
    space = train.space
    near = nearest_points(train, None, max(ks)) if own is None else own
    radii = reference_values(near, space, ks)
    if nearest_only:

        def within(j, k):
            return F.filter(F.slice("dists", 1, k), lambda d: d <= F.col("radii")[j])

        kept = [within(j, k) for j, k in enumerate(ks)]
        means = F.array(*[F.when(F.size(v) > 0, mean_of(v)).otherwise(0.0) for v in kept])
        limits = attach(near, radii, space.keys).select(*space.keys, "point", means.alias("limits"))
    else:
        sums = sum_within(train, radii)
        entry = F.struct("j", F.coalesce(ratio("total", "near"), F.lit(0.0)).alias("t"))
        found = sums.groupBy(*space.keys, "point").agg(F.sort_array(F.collect_list(entry)).alias("_l"))
        none = F.array(*[F.lit(0.0)] * len(ks))
        limits = join_on(near.select(*space.keys, "point"), found, [*space.keys, "point"], "left").select(
            *space.keys, "point", F.coalesce(F.transform("_l", lambda s: s["t"]), none).alias("limits")
        )
    limits = materialise(limits, "limits")
    return replace_zero_limits(limits, space, len(ks)) if fill_zero else limits


def replace_zero_limits(limits: DataFrame, space: Space, width: int) -> DataFrame:
    """Zero thresholds become the smallest non-zero one of the group (all zero: unchanged)."""
    smallest = limits.groupBy(*space.keys).agg(
        F.array(
            *[F.coalesce(F.min(F.nullif(F.col("limits")[j], F.lit(0.0))), F.lit(0.0)) for j in range(width)]
        ).alias("_least")
    )
    fixed = F.zip_with("limits", "_least", lambda t, s: F.when(t == 0, s).otherwise(t))
    rest = [c for c in limits.columns if c != "limits"]
    return attach(limits, smallest, space.keys).select(*rest, fixed.alias("limits"))


def dknn_thresholds(train: DataFrame, space: Space, ks: list[int], nearest_only: bool = False, fill_zero: bool = True) -> DataFrame:
    """(keys, id, limits): dk-NN thresholds of every training row, one per k."""
    layout = lay_out(train, space)
    return back_to_rows(train, layout, point_limits(layout, ks, nearest_only, fill_zero), ["limits"])


def status_from_limits(train: Layout, limits: DataFrame, test: DataFrame, params: list, queries: Layout | None = None) -> DataFrame:
    """(keys, id, ad_param, inside): some training point has ``limit >= distance``."""
    space = train.space
    queries = lay_out(test, space, train.pivots) if queries is None else queries
    flags = back_to_rows(test, queries, any_within(train, queries, limits, len(params)), ["inside"])
    never = F.array(*[F.lit(False)] * len(params))
    values = F.arrays_zip(
        F.array(*[F.lit(p) for p in params]).alias("p"), F.coalesce("inside", never).alias("i")
    )
    return flags.select(*space.keys, space.id, F.explode(values).alias("_e")).select(
        *space.keys, space.id, F.col("_e.p").alias("ad_param"), F.col("_e.i").alias("inside")
    )


def dknn_status(
    train: DataFrame, test: DataFrame, space: Space, ks: list[int], nearest_only: bool = False, shared: Prepared | None = None
) -> DataFrame:
    """dk-NN status for every requested k: (keys, id, ad_param, inside)."""
    if shared:
        limits = point_limits(shared.train, ks, nearest_only, own=shared.own)
        return status_from_limits(shared.train, limits, test, ks, shared.test)
    layout = lay_out(train, space)
    return status_from_limits(layout, point_limits(layout, ks, nearest_only), test, ks)


# --- RDN -------------------------------------------------------------------------------------


def agreement_classification(tree_probs, y) -> tuple[Column, Column]:
    """(A, STD) of P(true class) over the trees: share above 0.5, population spread."""
    tree_probs = F.col(tree_probs) if isinstance(tree_probs, str) else tree_probs
    y = F.col(y) if isinstance(y, str) else y
    true_prob = F.transform(tree_probs, lambda p: F.when(y == 1, p).otherwise(1 - p))
    agree = mean_of(F.transform(true_prob, lambda p: (p > 0.5).cast("double")))
    return agree, spread_of(true_prob)


def agreement_regression(tree_preds, y) -> tuple[Column, Column]:
    """(A, STD): mean exp(-|pred - y|) and the spread squeezed to [0, 1)."""
    tree_preds = F.col(tree_preds) if isinstance(tree_preds, str) else tree_preds
    y = F.col(y) if isinstance(y, str) else y
    agree = mean_of(F.transform(tree_preds, lambda p: F.exp(-F.abs(p - y))))
    decay = F.exp(-spread_of(tree_preds))
    return agree, (1 - decay) / (1 + decay)


def spread_of(values) -> Column:
    """Population standard deviation of an array column."""
    values = F.col(values) if isinstance(values, str) else values
    # the mean as a variable, or it would be worked out anew for every value
    spread = lambda centre: F.sqrt(mean_of(F.transform(values, lambda v: (v - centre) * (v - centre))))
    return F.get(F.transform(F.array(mean_of(values)), spread), F.lit(0))


def agreement_weight(agree: Column, std: Column) -> Column:
    """W = (1 - STD) * A; zero is a legal weight."""
    return (1 - std) * agree


def scale_by_k(k: int) -> float:
    """Optional scaling of RDN thresholds by the neighbourhood size (fixed values)."""
    return 1 / 3 if k < 31 else 1 / 2 if k < 41 else 1.0


def rdn_status(train: DataFrame, test: DataFrame, space: Space, k: int, scale: float = 1.0, shared: Prepared | None = None) -> DataFrame:
    """RDN status; ``train`` carries the agreement weight W of each row in ``weight``.

    Rows with equal features may differ in W; the largest threshold decides for their point.
    """
    layout = shared.train if shared else lay_out(train.select(*space.keys, space.id, space.features), space)
    limits = back_to_rows(train, layout, point_limits(layout, [k], own=shared.own if shared else None), ["limits"])
    weighted = weighted_limits(limits, train.select(*space.keys, space.id, "weight"), space, scale)
    rows = join_on(train.select(*space.keys, space.id, space.features), weighted, [*space.keys, space.id])
    largest = F.array(F.max(F.col("limits")[0])).alias("limits")
    per_point = rows.groupBy(*space.keys, space.features).agg(F.min(space.id).alias("point"), largest)
    per_point = materialise(per_point.select(*space.keys, "point", "limits"), "limits")
    return status_from_limits(layout, per_point, test, [k], shared.test if shared else None)


def weighted_limits(limits: DataFrame, weights: DataFrame, space: Space, scale: float = 1.0) -> DataFrame:
    """dk-NN thresholds times the row's agreement weight (keys, id, weight)."""
    return join_on(limits, weights, [*space.keys, space.id]).select(
        *space.keys,
        space.id,
        F.transform("limits", lambda t: t * F.col("weight") * scale).alias("limits"),
    )


# --- all methods -----------------------------------------------------------------------------


def inside_outside(method: str, train: DataFrame, test: DataFrame, space: Space, param, shared: Prepared | None = None) -> DataFrame:
    """(keys, id, inside) by one of ``Tanimoto``, ``dkNN``, ``UNC`` or ``RDN``.

    RDN needs a ``weight`` column on the training rows (see ``models.agreement_weights``). ``shared``
    holds what several methods on the same rows have in common.
    """
    if method == "Tanimoto":
        status = nearest_status(train, test, space, [param])
    elif method == "UNC":
        status = nunc_status(train, test, space, [param], shared)
    elif method == "dkNN":
        status = dknn_status(train, test, space, [param], shared=shared)
    elif method == "RDN":
        status = rdn_status(train, test, space, param, shared=shared)
    else:
        raise ValueError(f"unknown domain method {method!r}")
    return status.select(*space.keys, space.id, "inside")


def tag_subsets(rows: DataFrame, inside: str = "inside") -> DataFrame:
    """Every row twice: subset ``All`` and subset ``Inside`` or ``Outside``."""
    status = F.when(F.col(inside), F.lit("Inside")).otherwise(F.lit("Outside"))
    return rows.withColumn("subset", F.explode(F.array(F.lit("All"), status)))


def percent_inside(status: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded percentage of test rows inside the domain per method and parameter."""
    pct = F.round(100 * F.avg(F.col("inside").cast("double")), 0)
    return status.groupBy(*keys).agg(pct.alias("percent_inside"), F.count(F.lit(1)).alias("n"))


def all_copies(train: DataFrame, space: Space) -> DataFrame:
    """(keys, all_duplicated): whether every training row has a twin with equal features."""
    points = distinct_points(train, space)
    return points.groupBy(*space.keys).agg((F.min("weight") > 1).alias("all_duplicated"))
