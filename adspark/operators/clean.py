"""Projections, filters, de-duplication and integrity checks of labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.joining import join_on
from ..functions.ordered import with_scalars
from ..functions.scalar import count_where
from ..sources.shared import materialise


def canonical(df: DataFrame, names: dict[str, str], subset: str | None = None) -> DataFrame:
    """Project to canonical column names, optionally with a constant subset column."""
    cols = [F.col(old).alias(new) for new, old in names.items()]
    return df.select(*cols, *([F.lit(subset).alias("subset")] if subset is not None else []))


def endpoints_to_rows(df: DataFrame, ids: list[str], endpoints: list[str], valid=("0", "1")) -> DataFrame:
    """Wide multi-endpoint table to (ids, endpoint, label), only rows with a valid label."""
    text = df.select(*ids, *[F.col(e).cast("string").alias(e) for e in endpoints])
    return text.unpivot(ids, endpoints, "endpoint", "label").where(F.col("label").isin(*valid))


def encode_label(label, positive: str, negative: str) -> Column:
    """1 / 0; any other label is an error, not a NULL."""
    label = F.col(label) if isinstance(label, str) else label
    unknown = F.raise_error(F.concat(F.lit("unknown class label: "), F.coalesce(label, F.lit("NULL"))))
    return F.when(label == positive, 1).when(label == negative, 0).otherwise(unknown.cast("int"))


def dense_ids(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """0..n-1 in the sorted order of the distinct keys; equal keys get the same id.

    A global sort numbers the rows of every partition; only the per-partition counts are
    accumulated, so no task sees all keys.
    """
    keys = df.select(key).distinct().orderBy(key).withColumn("_at", F.monotonically_increasing_id())
    numbered = materialise(keys, "ids").select(
        key, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_i")
    )
    sizes = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    ids = numbered.join(offsets, "_p").select(key, (F.col("_i") + F.col("_o")).alias(out))
    return join_on(df.drop(out), ids, [key]) if out != key else ids


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with the names of the rules that fired).

    A rule that cannot be evaluated (NULL) counts as fired.
    """
    fired = F.filter(
        F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]),
        lambda r: r.isNotNull(),
    )
    tagged = df.withColumn("reasons", fired)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def split_unparsed(df: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parsed column is present, rejected rows)."""
    return df.where(F.col(parsed).isNotNull()), df.where(F.col(parsed).isNull()).drop(parsed)


def dedup_classes(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; keys with different labels are dropped whole."""
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
        F.min(label).alias("_lo"),
        F.max(label).alias("_hi"),
    )
    kept = grouped.where(F.col("_lo") == F.col("_hi"))
    return kept.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def without_outliers(df: DataFrame, keys: list[str], value: str, n_sd: float = 3.0) -> DataFrame:
    """Drop values far from the *other* values of their key, repeatedly.

    A value goes when it lies more than ``n_sd`` population standard deviations of the other
    values from their mean; only keys with at least three values are tested, all values at once.
    Keys that lost a value and keep more than two are tested again, always with 3 deviations.
    Leave-one-out moments follow from the group's own, so a pass is one aggregation and one join.
    """
    columns = df.columns
    finished, active, limit = [], df, n_sd
    while True:
        moments = active.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg(value).alias("_m"),
            F.var_pop(value).alias("_v"),
            (F.min(value) < F.max(value)).alias("_varies"),
        )
        c, n = F.col(value) - F.col("_m"), F.col("_n")
        gap = F.abs(c) * n / (n - 1)
        spread = F.greatest(F.col("_v") * n - c * c * n / (n - 1), F.lit(0.0)) / (n - 1)
        out = F.when((n >= 3) & F.col("_varies"), gap > limit * F.sqrt(spread)).otherwise(False)
        tested = materialise(join_on(active, moments, keys).select(*columns, out.alias("_out")), "outliers")
        changed = tested.where("_out").select(*keys).distinct()
        kept = tested.where(~F.col("_out")).select(*columns)
        if changed.isEmpty():
            finished.append(kept)
            return reduce(lambda a, b: a.unionByName(b), finished)
        finished.append(join_on(kept, changed, keys, "left_anti"))
        active, limit = join_on(kept, changed, keys, "left_semi"), 3.0


def dedup_values(df: DataFrame, key: str, value: str, order: list[str], n_sd: float = 3.0, max_deviation: float | None = None) -> DataFrame:
    """One row per key with the outlier-free mean of its values.

    Keys whose deviation exceeds ``max_deviation`` and keys without any value left are dropped.
    """
    kept = without_outliers(df.select(key, value), [key], value, n_sd)
    mean = kept.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    mean = mean.where(F.col("_mean").isNotNull())
    if max_deviation is not None:
        mean = mean.where(F.col("_sd") <= max_deviation)
    rest = [c for c in df.columns if c not in (key, value)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    joined = join_on(mean, first, [key])
    return joined.select(
        key, F.col("_mean").alias(value), *[F.col(f"_first.{c}").alias(c) for c in rest]
    ).select(*df.columns)


def only_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; every duplicated key is dropped entirely."""
    rest = [c for c in df.columns if c != key]
    single = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    return single.where("_n = 1").select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct by key, keeping the first row by ``order``."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return picked.select(key, *[F.col(f"_f.{c}").alias(c) for c in rest]).select(*df.columns)


def integrity(train: DataFrame, test: DataFrame, id_col: str, required: list[str]) -> DataFrame:
    """One row of check counters: sizes, distinct ids, ids on both sides, missing values."""

    def side(df, name):
        per_id = df.groupBy(id_col).agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in required])).alias("_miss"),
        )
        return per_id.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias(f"{name}_rows"),
            F.count(F.lit(1)).alias(f"{name}_ids"),
            F.coalesce(F.sum("_miss"), F.lit(0)).alias(f"{name}_missing"),
        )

    shared = join_on(train.select(id_col).distinct(), test.select(id_col), [id_col], "left_semi")
    overlap = shared.agg(F.count(F.lit(1)).alias("shared_ids"))
    return with_scalars(with_scalars(side(train, "train"), side(test, "test")), overlap)


def assert_integrity(checks: DataFrame) -> DataFrame:
    """Fail the job unless ids are unique and disjoint and nothing is missing."""
    ok = (
        (F.col("train_rows") == F.col("train_ids"))
        & (F.col("test_rows") == F.col("test_ids"))
        & (F.col("shared_ids") == 0)
        & (F.col("train_missing") + F.col("test_missing") == 0)
    )
    return checks.where(F.assert_true(ok, F.lit("train / test integrity check failed")).isNull())


def big_enough(df: DataFrame, keys: list[str], label: str | None = None, per_class: int = 25, rows: int = 50) -> DataFrame:
    """Groups that reach the minimum size: ``per_class`` rows of both classes, or ``rows`` rows."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *(
            [count_where(F.col(label) == 1).alias("n1"), count_where(F.col(label) == 0).alias("n0")]
            if label
            else []
        ),
    )
    ok = (F.col("n1") >= per_class) & (F.col("n0") >= per_class) if label else F.col("n") >= rows
    return counts.withColumn("usable", ok)


def min_max_scale(train: DataFrame, test: DataFrame, features: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Scale every descriptor to [0, 1] by the training minimum and maximum.

    A constant descriptor becomes value - minimum, i.e. 0 on the training side.
    """
    limits = train.agg(
        F.array(*[F.min(F.col(features)[i]) for i in range(width)]).alias("_lo"),
        F.array(*[F.max(F.col(features)[i]) for i in range(width)]).alias("_hi"),
    )

    def scale(df):
        span = F.zip_with("_hi", "_lo", lambda h, l: F.when(h > l, h - l).otherwise(F.lit(1.0)))
        shifted = F.zip_with(features, "_lo", lambda v, l: v - l)
        scaled = F.zip_with(shifted, span, lambda v, s: v / s)
        return with_scalars(df, limits).withColumn(features, scaled).drop("_lo", "_hi")

    return scale(train), scale(test)


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange the contents of two columns."""
    swapped = {a: b, b: a}
    return df.select(*[F.col(swapped.get(c, c)).alias(c) for c in df.columns])


def fill_fold(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Results without folds count as fold 0."""
    return df.withColumn(fold, F.coalesce(F.col(fold), F.lit(0)))
