"""Distributed order statistics.

A plain ``Window.partitionBy(group).orderBy(value)`` sorts a whole group in one task. Here a
group is cut into order-preserving buckets: every bucket is ordered on its own, and the bucket
totals are accumulated separately. A group has no more buckets than its rows can fill. The borders of the buckets are quantiles of the group's own
values, so buckets hold about equal shares however skewed the values are, infinite ones included.
Running totals work on equal values merged into counts, so a value that very many rows share is one
row. Positions and rank correlations of whole rows shuffle each row once for each order; a value that
fills buckets by itself has its rows dealt over as many. Groups whose key is NULL are groups like any
other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import materialise
from .hashing import order_bucket, order_key
from .joining import join_on

#: Most buckets of a group, a power of two.
MOST_BUCKETS = 1024
#: Rows that fill a bucket: smaller groups have fewer buckets, so there are far fewer buckets than rows.
BUCKET_ROWS = 2_000
#: Rank error of the quantiles that serve as borders: one in this many rows.
ACCURACY = 10_000


def _borders(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, ``_rows``, a list per value): quantiles of each group's values, fewer for a smaller group."""
    shares = F.array(*[F.lit(i / MOST_BUCKETS) for i in range(1, MOST_BUCKETS)])
    every = [F.percentile_approx(v.cast("double"), shares, ACCURACY).alias(name) for name, v in values.items()]
    table = df.groupBy(*keys).agg(*every, F.count(next(iter(values.values()))).alias("_rows"))
    # a smaller group takes every so many of the quantiles
    own = F.least(F.ceil(F.col("_rows") / BUCKET_ROWS), F.lit(MOST_BUCKETS))
    fewer = lambda b, i: F.floor((i + 1) * own / MOST_BUCKETS) > F.floor(i * own / MOST_BUCKETS)
    return table.select(*keys, "_rows", *[F.filter(name, fewer).alias(name) for name in values])


def _count_before(df: DataFrame, borders: str, value: Column, out: str, equal: bool = False) -> DataFrame:
    """Add the number of ``borders`` below the value (with ``equal`` also of those like it), by halving."""
    df = df.withColumn(out, F.lit(0))
    step = MOST_BUCKETS // 2
    while step:
        border = F.get(borders, F.col(out) + (step - 1))
        before = border <= value if equal else border < value
        df = df.withColumn(out, F.col(out) + F.when(before, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def value_buckets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``_bucket``: place of the value among at most MOST_BUCKETS - 1 quantiles of its group.

    The borders are written once, so that every use of the result sees the same ones.
    """
    number = F.col(value).cast("double")
    table = materialise(_borders(df, keys, {"_fine": number}).drop("_rows"), "borders")
    joined = join_on(df, table, keys) if keys else with_scalars(df, table)
    return _count_before(joined, "_fine", number, "_bucket").drop("_fine")


def _runs(df: DataFrame, borders: str, value: Column, salt: Column, name: str) -> DataFrame:
    """Add ``_run<name>``, which follows the order of the value, and ``_salt<name>`` below ``_times<name>``.

    A value that fills buckets by itself is a run of its own, an odd one, and has the salts 0, 1, ... of
    as many tasks; ``salt`` is a function of their number.
    """
    df = _count_before(df, borders, value, "_first")
    df = _count_before(df, borders, value, "_last", equal=True)
    times = F.col("_last") - F.col("_first") - 1
    hot = times > 0
    return df.withColumns(
        {
            f"_run{name}": 2 * F.col("_first") + hot.cast("int"),
            f"_salt{name}": F.when(hot, salt(times)).otherwise(0).cast("int"),
            f"_times{name}": F.greatest(times, F.lit(1)),
        }
    ).drop("_first", "_last")


def _ahead(counts: DataFrame, task: list[str]) -> DataFrame:
    """(task, ``_is_row`` = 0, ``_before``, ``_c``): one row for each task with the rows ``_c`` of its group before it."""
    order = W.partitionBy("_group").orderBy(*task[1:]).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns({"_is_row": F.lit(0), "_before": F.coalesce(F.sum("_c").over(order), F.lit(0))})


def _line(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    """Rows and the rows ahead of them: totals are neither joined nor broadcast."""
    return rows.withColumn("_is_row", F.lit(1)).unionByName(ahead, allowMissingColumns=True)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str],
    bucket: Column | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``.

    ``sums`` maps new column -> summed column, ``totals`` maps new column -> column summed over
    the whole group. ``order[0]`` is the numeric value whose quantiles part the buckets unless
    ``bucket`` gives the bucket directly.
    """
    totals = totals or {}
    df = value_buckets(df, keys, order[0]) if bucket is None else df.withColumn("_bucket", bucket)

    summed = sorted(set(sums.values()) | set(totals.values()))
    part = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_part_{c}") for c in summed])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = part.select(
        *keys,
        "_bucket",
        *[F.sum(f"_part_{c}").over(before).alias(f"_off_{c}") for c in summed],
        *[F.sum(f"_part_{c}").over(whole).alias(name) for name, c in totals.items()],
    )
    # the totals before a bucket go ahead of its rows, as one more row: no join, however many buckets there are
    columns = df.drop("_bucket").columns
    rows = df.select("*", F.lit(1).alias("_is_row"), *[F.col(c).alias(f"_off_{c}") for c in summed])
    ahead = offsets.withColumn("_is_row", F.lit(0))
    line = rows.unionByName(ahead, allowMissingColumns=True)
    inside = W.partitionBy(*keys, "_bucket").orderBy("_is_row", *order).rowsBetween(W.unboundedPreceding, 0)
    local = line.select(
        *columns,
        "_is_row",
        *[F.sum(f"_off_{c}").over(inside).alias(f"_run_{name}") for name, c in sums.items()],
        *[F.first(name).over(inside).alias(f"_whole_{name}") for name in totals],
    )
    return local.where("_is_row = 1").select(
        *columns, *[F.col(f"_run_{name}").alias(name) for name in sums], *[F.col(f"_whole_{name}").alias(name) for name in totals]
    )


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame as scalar subqueries (no join, no shuffle)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s"))
    return df.select("*", packed.scalar().alias("_s")).select(
        *df.columns, *[F.col(f"_s.{c}").alias(c) for c in one_row.columns]
    )


def hash_rank(df: DataFrame, keys: list[str], order_col: str, id_col: str, out: str = "rn") -> DataFrame:
    """Position 1..n of every row in the hash order of its group, plus the group size ``<out>_n``."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(
        ones,
        keys,
        [order_col, id_col],
        {out: "_one"},
        bucket=order_bucket(F.col(order_col)),
        totals={f"{out}_n": "_one"},
    ).drop("_one")


def distinct_values(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values per group with their number of rows ``c``, written once."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.cast("long").alias("c"))
    return materialise(values, "values")


def average_ranks(
    df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None
) -> DataFrame:
    """Distinct values with their tie-averaged rank, centred on the mean rank of the group."""
    ranked = running_totals(
        distinct_values(df, keys, value, weight), keys, [value], {"_cum": "c"}, totals={"_n": "c"}
    )
    rank = F.col("_cum") - (F.col("c") - 1) / 2
    return ranked.select(*keys, value, (rank - (F.col("_n") + 1) / 2).alias(out), "_n", "c")


def row_positions(df: DataFrame, keys: list[str], value: str, id_col: str, out: str) -> DataFrame:
    """Position 1..n of every row with a ``value``, ties in the hash order of the id; ``<out>_n`` = n.

    Rows are shuffled once, to buckets of their values; the rows of a value that fills buckets by
    itself are parted by their hash.
    """
    rows = df.where(F.col(value).isNotNull())
    table = _borders(rows, keys, {"_fine": F.col(value)}).withColumn("_group", F.monotonically_increasing_id())
    placed = join_on(rows, materialise(table, "borders"), keys)
    # a share of 65,536 of the hash order, and the whole hash for the order itself
    share = F.conv(F.substring(order_key([F.col(id_col)]), 1, 4), 16, 10).cast("int")
    placed = _runs(placed, "_fine", F.col(value).cast("double"), lambda times: F.floor(share * times / 65536), "")
    task = ["_group", "_run", "_salt"]
    hashed = F.unhex(order_key([F.col(id_col)])).alias("_h")
    placed = placed.select(*df.columns, F.col("_rows").alias(f"{out}_n"), *task, hashed)
    line = _line(placed, _ahead(placed.groupBy(*task).agg(F.count(F.lit(1)).alias("_c")), task).drop("_c"))
    own = W.partitionBy(*task).orderBy("_is_row", value, "_h", id_col)
    at = F.first("_before").over(own.rowsBetween(W.unboundedPreceding, 0)) + F.row_number().over(own) - 1
    return line.withColumn(out, at).where("_is_row = 1").select(*df.columns, f"{out}_n", out)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group; same values as the exact ``percentile``."""
    ranked = running_totals(
        distinct_values(df, keys, value, weight), keys, [value], {"_cum": "c"}, totals={"_n": "c"}
    )

    def at(position: Column) -> Column:
        # value covering the 0-based position in the sorted multiset
        hit = (F.col("_cum") - F.col("c") <= position) & (position < F.col("_cum"))
        return F.max(F.when(hit, F.col(value)))

    picked, final = [], []
    for name, q in quantiles.items():
        target = (F.col("_n") - 1) * F.lit(float(q))
        picked += [
            at(F.floor(target)).alias(f"_lo_{name}"),
            at(F.ceil(target)).alias(f"_hi_{name}"),
            F.max(target - F.floor(target)).alias(f"_w_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((lo + (hi - lo) * F.col(f"_w_{name}")).alias(name))
    return ranked.groupBy(*keys).agg(*picked).select(*keys, *final)


def kth_smallest(df: DataFrame, keys: list[str], value: str, position: Column, out: str) -> DataFrame:
    """Value at the 1-based ``position`` of the ascending order (may use the group size ``n``)."""
    ranked = running_totals(
        distinct_values(df, keys, value), keys, [value], {"_cum": "c"}, totals={"n": "c"}
    )
    hit = (F.col("_cum") - F.col("c") < position) & (position <= F.col("_cum"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(hit, F.col(value))).alias(out), F.max("n").alias("n")
    )


def weighted_pearson(df: DataFrame, keys: list[str], a: str, b: str, weight: str, out: str) -> DataFrame:
    """Correlation of two centred columns given with row weights."""
    w = F.col(weight)
    sums = df.groupBy(*keys).agg(
        F.sum(w * F.col(a) * F.col(b)).alias("_ab"),
        F.sum(w * F.col(a) * F.col(a)).alias("_aa"),
        F.sum(w * F.col(b) * F.col(b)).alias("_bb"),
    )
    return sums.select(*keys, F.try_divide(F.col("_ab"), F.sqrt("_aa") * F.sqrt("_bb")).alias(out))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """Spearman correlation with average ranks; NULL when one side is constant.

    Rows are shuffled twice, to the buckets of one value and of the other.
    """
    values = {"x": F.col(x).cast("double"), "y": F.col(y).cast("double")}
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *[v.alias(f"_{k}") for k, v in values.items()])
    table = _borders(pairs, keys, {"_bx": F.col("_x"), "_by": F.col("_y")}).withColumn("_group", F.monotonically_increasing_id())
    table = materialise(table, "borders")
    placed = {}
    for name in values:
        own = table.select(*keys, "_group", "_rows", f"_b{name}")
        joined = join_on(pairs, own, keys) if keys else with_scalars(pairs, own)
        # any even share of the rows will do: ranks within a run of one value are alike
        placed[name] = _runs(joined, f"_b{name}", F.col(f"_{name}"), lambda times: F.monotonically_increasing_id() % times, "")
    rows, task = placed["x"].select("_group", "_rows", "_x", "_y", "_run", "_salt"), ["_group", "_run", "_salt"]
    for name in values:
        if name == "y":
            # borders of both values at once would be too much for the generated code of one stage
            again = join_on(rows, table.select("_group", "_by"), ["_group"])
            again = _runs(again, "_by", F.col("_y"), lambda times: F.monotonically_increasing_id() % times, "")
            rows = again.select("_group", "_rows", "_y", "_rx", "_run", "_salt")
        counts = placed[name].groupBy("_group", "_run").agg(F.count(F.lit(1)).alias("_c"), F.max("_times").alias("_t"))
        # every salt has its row ahead, whichever rows fall to it
        every = F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_salt")
        ahead = _ahead(counts, ["_group", "_run"]).select("_group", "_run", every, "_is_row", "_before", F.col("_c").alias("_own"))
        own = W.partitionBy(*task).orderBy("_is_row", f"_{name}")
        before, size = (F.first(c).over(own.rowsBetween(W.unboundedPreceding, 0)) for c in ("_before", "_own"))
        # the frame of an ordered window ends with the equal rows; the row ahead counts in both
        rank = (F.rank().over(own) + F.count(F.lit(1)).over(own)) / 2 - 1
        rank = F.when(F.col("_run") % 2 == 1, (size + 1) / 2).otherwise(rank)
        ranked = _line(rows, ahead).withColumn(f"_r{name}", before + rank - (F.col("_rows") + 1) / 2).where("_is_row = 1")
        rows = ranked.drop("_is_row", "_before", "_own", f"_{name}", "_run", "_salt")
    sums = weighted_pearson(rows.withColumn("_w", F.lit(1.0)), ["_group"], "_rx", "_ry", "_w", out)
    return join_on(sums, table.select(*keys, "_group"), ["_group"]).select(*keys, out)


