"""Exact, reproducible splits: quotas over a hash order of the row ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.hashing import order_key
from ..functions.joining import join_on
from ..functions.ordered import hash_rank


def temporal_split(df: DataFrame, thresholds: DataFrame, endpoint: str = "endpoint", year: str = "year") -> DataFrame:
    """Train / update1 / update2 / holdout by per-endpoint year thresholds."""
    y = F.col(year)
    part = (
        F.when(y <= F.col("train_thresh"), F.lit("train"))
        .when(y <= F.col("update1_thresh"), F.lit("update1"))
        .when(y <= F.col("update2_thresh"), F.lit("update2"))
        .otherwise(F.lit("holdout"))
    )
    joined = df.where(y.isNotNull()).join(thresholds, endpoint)
    return joined.withColumn("part", part).drop("train_thresh", "update1_thresh", "update2_thresh")


def flag_split(df: DataFrame, ids: list[str], flags: list[str]) -> DataFrame:
    """Membership flags to rows (ids, part); a row may belong to several parts."""
    long = df.select(*ids, *flags).unpivot(ids, flags, "part", "_member")
    return long.where("_member").drop("_member")


def stratum_quotas(df: DataFrame, keys: list[str], stratum: str, fraction: float) -> DataFrame:
    """Rows per stratum for the held-out part: ceil(n * fraction) shared by largest remainder."""
    counts = df.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("_c"))
    # one row per stratum
    whole = W.partitionBy(*keys)
    total = counts.withColumn("_n", F.sum("_c").over(whole))
    exact = F.ceil(F.round(F.col("_n") * fraction, 9)) * F.col("_c") / F.col("_n")
    shared = total.withColumn("_q", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    short = F.ceil(F.round(F.col("_n") * fraction, 9)) - F.sum("_q").over(whole)
    order = W.partitionBy(*keys).orderBy(F.col("_rest").desc(), stratum)
    extra = (F.row_number().over(order) <= F.col("_short")).cast("bigint")
    return shared.withColumn("_short", short).select(*keys, stratum, (F.col("_q") + extra).alias("quota"))


def stratified_split(df: DataFrame, id_col: str, stratum: str, fraction: float, seed: int, keys: list[str] = (), method: str = "md5") -> DataFrame:
    """Add ``role`` (train / test): an exact stratified shuffle split."""
    keys = list(keys)
    hashed = df.withColumn("_h", order_key([F.col(id_col), F.lit(seed), *[F.col(k) for k in keys]], method))
    ranked = hash_rank(hashed, [*keys, stratum], "_h", id_col, "_rn")
    quotas = stratum_quotas(df, keys, stratum, fraction)
    role = F.when(F.col("_rn") <= F.col("quota"), F.lit("test")).otherwise(F.lit("train"))
    return join_on(ranked, quotas, [*keys, stratum]).select(*df.columns, role.alias("role"))


def random_split(df: DataFrame, id_col: str, fraction: float, seed: int, keys: list[str] = ()) -> DataFrame:
    """Exact random split without strata."""
    out = stratified_split(df.withColumn("_all", F.lit(0)), id_col, "_all", fraction, seed, keys)
    return out.drop("_all")


def repeated_splits(df: DataFrame, id_col: str, stratum: str, fraction: float, seed: int, n: int) -> DataFrame:
    """``n`` independent stratified splits of the same rows, numbered in ``split``."""
    copies = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return stratified_split(copies, id_col, stratum, fraction, seed, ["split"])


def value_bins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``bin``: n/10 (at most 100) linear edges over the range of a continuous endpoint."""
    span = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.least(F.floor(F.count(F.lit(1)) / 10), F.lit(100)).alias("_edges"),
    )
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (F.col("_edges") - 1)) + 1
    binned = F.when((F.col("_edges") >= 2) & (F.col("_hi") > F.col("_lo")), at).otherwise(1)
    return join_on(df, span, keys).withColumn("bin", binned.cast("int")).drop("_lo", "_hi", "_edges")


def _merged_bins(sizes: dict[int, int]) -> dict[int, int]:
    """New bin of every bin so that no bin holds a single row (at most 101 bins).

    The order of the steps is part of the rule: single bins join each other first, then neighbours.
    """
    single = sorted(b for b, n in sizes.items() if n == 1)
    target = {b: b for b in sizes}
    if not single:
        return target

    def touching(bins, others):
        near = set()
        for b in bins:
            near |= {x for o in (b - 1, b + 1) if o in others for x in (b, o)}
        return near

    paired = touching(single, set(single)) or touching(single, set(sizes))
    paired |= touching(set(single) - paired, set(sizes))
    chain = sorted(paired)
    if chain:
        groups = len(chain) // 2
        long = len(chain) % groups  # the first groups take the rows that do not divide evenly
        start = 0
        for g in range(groups):
            step = len(chain) // groups + (1 if g < long else 0)
            for b in chain[start : start + step]:
                target[b] = chain[start]
            start += step
    for b in [s for s in single if s not in paired]:
        candidates = sorted({t for o, t in target.items() if o not in single or o in paired})
        if candidates:
            target[b] = min(candidates, key=lambda t: abs(t - b))
    return target


def merge_single_bins(binned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, stratum): bins that hold one row join a neighbour; works on bin counts only."""
    sizes = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    known = {f.name: f.dataType for f in sizes.schema.fields}
    schema = T.StructType(
        [T.StructField(k, known[k]) for k in keys]
        + [T.StructField("bin", T.IntegerType()), T.StructField("stratum", T.IntegerType())]
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        target = _merged_bins(dict(zip(pdf["bin"], pdf["n"])))
        return pdf.assign(stratum=pdf["bin"].map(target).astype("int32"))[schema.fieldNames()]

    return sizes.groupBy(*keys).applyInPandas(merge, schema)


def continuous_split(df: DataFrame, id_col: str, value: str, fraction: float, seed: int, keys: list[str] = ()) -> DataFrame:
    """Stratified split of a continuous endpoint."""
    keys = list(keys)
    strata = with_value_strata(df, keys, value)
    return stratified_split(strata, id_col, "stratum", fraction, seed, keys).drop("stratum")


def with_value_strata(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add the ``stratum`` of a continuous endpoint."""
    grouped = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    binned = value_bins(rows, grouped, value)
    merged = merge_single_bins(binned, grouped)
    return join_on(binned, merged, [*grouped, "bin"]).select(*df.columns, "stratum")


def k_folds(df: DataFrame, id_col: str, stratum: str, k: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """Add ``fold`` 0..k-1; every stratum is spread evenly. Training rows are the other folds."""
    keys = list(keys)
    hashed = df.withColumn("_h", order_key([F.col(id_col), F.lit(seed), *[F.col(c) for c in keys]]))
    ranked = hash_rank(hashed, [*keys, stratum], "_h", id_col, "_rn")
    return ranked.select(*df.columns, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias("fold"))


def fold_roles(folds: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every row k times: test in its own fold, train in the others."""
    each = folds.withColumnRenamed(fold, "_own").withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("_own") == F.col(fold), F.lit("test")).otherwise(F.lit("train"))
    return each.withColumn("role", role).drop("_own")


def contiguous_parts(df: DataFrame, id_col: str, k: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """Add ``part`` 0..k-1: equal disjoint parts of the hash order, the rest goes to the last."""
    keys = list(keys)
    hashed = df.withColumn("_h", order_key([F.col(id_col), F.lit(seed), *[F.col(c) for c in keys]]))
    ranked = hash_rank(hashed, keys, "_h", id_col, "_rn")
    size = F.greatest(F.floor(F.col("_rn_n") / k), F.lit(1))
    part = F.least(F.floor((F.col("_rn") - 1) / size), F.lit(k - 1)).cast("int")
    return ranked.select(*df.columns, part.alias("part"))


def split_report(df: DataFrame, keys: list[str], value: str, role: str = "role", test_fraction: float = 0.2, tolerance: float = 0.1) -> DataFrame:
    """Per split: sizes, means, deviations, and whether they agree within the tolerance."""

    def of(name: str, fn) -> Column:
        return fn(F.when(F.col(role) == name, F.col(value)))

    stats = df.groupBy(*keys).agg(
        F.count_if(F.col(role) == "train").alias("n_train"),
        F.count_if(F.col(role) == "test").alias("n_test"),
        of("train", F.avg).alias("mean_train"),
        of("test", F.avg).alias("mean_test"),
        of("train", F.stddev_pop).alias("sd_train"),
        of("test", F.stddev_pop).alias("sd_test"),
    )
    share = F.col("n_test") / (F.col("n_train") + F.col("n_test"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance * F.abs(F.col(a))
    return (
        stats.withColumn("test_share", share)
        .withColumn("size_ok", F.abs(share - test_fraction) <= 0.02)
        .withColumn("mean_ok", near("mean_train", "mean_test"))
        .withColumn("sd_ok", near("sd_train", "sd_test"))
    )


def time_order_report(df: DataFrame, keys: list[str], year: str = "year", part: str = "part") -> DataFrame:
    """First and last year per part of a temporal split, and whether the parts follow in time."""
    names = ("train", "update1", "update2", "holdout")
    stats = df.groupBy(*keys).agg(
        *[F.min(F.when(F.col(part) == p, F.col(year))).alias(f"{p}_first") for p in names],
        *[F.max(F.when(F.col(part) == p, F.col(year))).alias(f"{p}_last") for p in names],
    )
    ordered = F.lit(True)
    for earlier, later in zip(names, names[1:]):
        ordered = ordered & F.coalesce(F.col(f"{earlier}_last") < F.col(f"{later}_first"), F.lit(True))
    return stats.withColumn("ordered", ordered)
