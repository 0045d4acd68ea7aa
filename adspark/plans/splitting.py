"""Registered queries: temporal, stratified, repeated and k-fold splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from .registry import query
from .testbed import DESCRIPTORS, REG, descriptors, reg_predictions

# year thresholds per endpoint (fixed values)
THRESHOLDS = [
    ("1-URGENT", 1997, 1998, 2000),
    ("2-HIGH", 1996, 1998, 1999),
    ("3-MEDIUM", 1998, 1999, 2000),
    ("4-NOT SPECIFIED", 1997, 1999, 2000),
    ("5-LOW", 1996, 1997, 1999),
]
TEMPORAL = f"""temporal AS (
  SELECT o_orderkey, o_orderpriority AS endpoint, year(o_orderdate) AS year,
         CASE WHEN year(o_orderdate) <= a THEN 'train' WHEN year(o_orderdate) <= b THEN 'update1'
              WHEN year(o_orderdate) <= c THEN 'update2' ELSE 'holdout' END AS part
  FROM orders JOIN (VALUES {', '.join(str(r) for r in THRESHOLDS)}) AS h(p, a, b, c) ON p = o_orderpriority)"""


def temporal_parts(t):
    limits = t.spark.createDataFrame(
        THRESHOLDS, "endpoint string, train_thresh int, update1_thresh int, update2_thresh int"
    )
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("endpoint"), F.year("o_orderdate").alias("year"))
    return S.temporal_split(rows, limits)


@query("c1_temporal_split", "SELECT o_orderkey, endpoint, part FROM temporal", [TEMPORAL])
def c1(t):
    return temporal_parts(t).select("o_orderkey", "endpoint", "part")


@query(
    "c2_flag_split",
    """SELECT o_orderkey, 'Train T1' AS part FROM orders WHERE year(o_orderdate) <= 1997
       UNION ALL SELECT o_orderkey, 'Train T2' FROM orders WHERE year(o_orderdate) <= 1999
       UNION ALL SELECT o_orderkey, 'Test T1' FROM orders WHERE year(o_orderdate) = 1998
       UNION ALL SELECT o_orderkey, 'Test T2' FROM orders WHERE year(o_orderdate) >= 2000""",
)
def c2(t):
    year = F.year("o_orderdate")
    flags = {"Train T1": year <= 1997, "Train T2": year <= 1999, "Test T1": year == 1998, "Test T2": year >= 2000}
    return S.flag_split(t.orders.select("o_orderkey", *[c.alias(n) for n, c in flags.items()]), ["o_orderkey"], list(flags))


def quota_ctes(source: str, keys: str, stratum: str, fraction: float, seed: int, hash_parts: str) -> list[str]:
    """SQL twin of the exact stratified split over ``source(id, keys, stratum)``."""
    ks = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    on = " AND ".join([f"q.{k.strip()} = r.{k.strip()}" for k in (keys.split(",") if keys else [])] + [f"q.{stratum} = r.{stratum}"])
    return [
        f"""quota AS (
  SELECT {ks}{stratum}, q + CASE WHEN row_number() OVER ({part} ORDER BY rest DESC, {stratum}) <= want - sum(q) OVER ({part}) THEN 1 ELSE 0 END AS quota
  FROM (SELECT *, floor(want * c / n::DOUBLE)::BIGINT AS q, round(want * c / n::DOUBLE - floor(want * c / n::DOUBLE), 9) AS rest
        FROM (SELECT *, ceil(round(n * {fraction}::DOUBLE, 9))::BIGINT AS want
              FROM (SELECT *, sum(c) OVER ({part})::BIGINT AS n FROM (SELECT {ks}{stratum}, count(*) AS c FROM {source} GROUP BY ALL) AS a) AS b) AS d) AS e)""",
        f"""split AS (
  SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS role
  FROM (SELECT *, row_number() OVER (PARTITION BY {ks}{stratum} ORDER BY md5(concat_ws('|', id, {seed}{hash_parts})), id) AS rn FROM {source}) r
  JOIN quota q ON {on})""",
    ]


@query(
    "c3_stratified_split",
    "SELECT id, label, role FROM split",
    [DESCRIPTORS, *quota_ctes("descriptors", "", "label", 0.2, 42, "")],
)
def c3(t):
    return S.stratified_split(descriptors(t).select("id", "label"), "id", "label", 0.2, 42)


@query(
    "c3_stratified_split_per_endpoint",
    "SELECT id, endpoint, stratum, role FROM split",
    [
        "lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS endpoint, l_linestatus AS stratum FROM lineitem)",
        *quota_ctes("lines", "endpoint", "stratum", 0.25, 7, ", endpoint"),
    ],
)
def c3e(t):
    rows = reg_predictions(t).select("id", "endpoint", F.col("test_set").alias("stratum"))
    return S.stratified_split(rows, "id", "stratum", 0.25, 7, ["endpoint"])


BINS = """bins AS (
  SELECT r.*, CASE WHEN edges >= 2 AND hi > lo THEN floor((y - lo) / (hi - lo) * (edges - 1)) + 1 ELSE 1 END::INT AS bin
  FROM reg_predictions r JOIN (SELECT endpoint, min(y) AS lo, max(y) AS hi, least(floor(count(*) / 10), 100) AS edges FROM reg_predictions GROUP BY 1) s USING (endpoint))"""


@query("c4_value_bins", "SELECT endpoint, bin, count(*) AS n FROM bins GROUP BY 1, 2", [*REG[:1], BINS])
def c4b(t):
    binned = S.value_bins(reg_predictions(t), ["endpoint"], "y")
    return binned.groupBy("endpoint", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("c4_continuous_split")
def c4(t):
    rows = reg_predictions(t).select("id", "endpoint", "y")
    return S.continuous_split(rows, "id", "y", 0.25, 42, ["endpoint"])


@query("c4_continuous_split_report")
def c4r(t):
    rows = reg_predictions(t).select("id", "endpoint", "y")
    split = S.continuous_split(rows, "id", "y", 0.25, 42, ["endpoint"])
    return S.split_report(split, ["endpoint"], "y", test_fraction=0.25)


FOLDS = """folds AS (SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', id, 42)), id) - 1) % 5 AS INT) AS fold FROM descriptors)"""


@query("c5_k_folds", "SELECT id, label, fold FROM folds", [DESCRIPTORS, FOLDS])
def c5(t):
    return S.k_folds(descriptors(t).select("id", "label"), "id", "label", 5, 42)


@query("c5_fold_roles", "SELECT f.id, f.label, k.fold, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS role FROM folds f, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k", [DESCRIPTORS, FOLDS])
def c5r(t):
    return S.fold_roles(S.k_folds(descriptors(t).select("id", "label"), "id", "label", 5, 42), 5)


@query(
    "c6_class_folds",
    """SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', id, 100)), id) - 1) % 5 AS INT) AS fold FROM descriptors""",
    [DESCRIPTORS],
)
def c6(t):
    return S.k_folds(descriptors(t).select("id", "y"), "id", "y", 5, 100)


@query(
    "c7_repeated_splits",
    "SELECT id, label, split, role FROM split",
    [
        DESCRIPTORS,
        "copies AS (SELECT id, label, unnest([0, 1, 2, 3]) AS split FROM descriptors)",
        *quota_ctes("copies", "split", "label", 0.2, 42, ", split"),
    ],
)
def c7(t):
    return S.repeated_splits(descriptors(t).select("id", "label"), "id", "label", 0.2, 42, 4)


@query(
    "c8_random_split",
    "SELECT id, role FROM split",
    ["lines AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 0 AS one FROM lineitem)", *quota_ctes("lines", "", "one", 0.3, 1, "")],
)
def c8(t):
    return S.random_split(reg_predictions(t).select("id"), "id", 0.3, 1)


@query(
    "c9_contiguous_parts",
    """SELECT id, CAST(least((rn - 1) // greatest(n // 7, 1), 6) AS INT) AS part FROM (
         SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', id, 42)), id) AS rn, count(*) OVER () AS n FROM descriptors) AS x""",
    [DESCRIPTORS],
)
def c9(t):
    return S.contiguous_parts(descriptors(t).select("id"), "id", 7, 42)


@query(
    "c10_split_report",
    """SELECT endpoint, count_if(role = 'train') AS n_train, count_if(role = 'test') AS n_test,
              avg(y) FILTER (role = 'train') AS mean_train, avg(y) FILTER (role = 'test') AS mean_test,
              stddev_pop(y) FILTER (role = 'train') AS sd_train, stddev_pop(y) FILTER (role = 'test') AS sd_test,
              count_if(role = 'test')::DOUBLE / count(*) AS test_share, abs(count_if(role = 'test')::DOUBLE / count(*) - 0.25) <= 0.02 AS size_ok,
              abs(avg(y) FILTER (role = 'train') - avg(y) FILTER (role = 'test')) <= 0.1 * abs(avg(y) FILTER (role = 'train')) AS mean_ok,
              abs(stddev_pop(y) FILTER (role = 'train') - stddev_pop(y) FILTER (role = 'test')) <= 0.1 * abs(stddev_pop(y) FILTER (role = 'train')) AS sd_ok
       FROM (SELECT s.*, p.y FROM split s JOIN reg_predictions p ON p.id = s.id AND p.endpoint = s.endpoint) AS j GROUP BY endpoint""",
    [
        *REG[:1],
        "lines AS (SELECT id, endpoint, test_set AS stratum FROM reg_predictions)",
        *quota_ctes("lines", "endpoint", "stratum", 0.25, 7, ", endpoint"),
    ],
    "mean_train mean_test sd_train sd_test test_share",
)
def c10(t):
    rows = reg_predictions(t).select("id", "endpoint", F.col("test_set").alias("stratum"), "y")
    return S.split_report(S.stratified_split(rows, "id", "stratum", 0.25, 7, ["endpoint"]), ["endpoint"], "y", test_fraction=0.25)


@query(
    "c10_time_order_report",
    """SELECT endpoint, min(year) FILTER (part = 'train') AS train_first, min(year) FILTER (part = 'update1') AS update1_first,
              min(year) FILTER (part = 'update2') AS update2_first, min(year) FILTER (part = 'holdout') AS holdout_first,
              max(year) FILTER (part = 'train') AS train_last, max(year) FILTER (part = 'update1') AS update1_last,
              max(year) FILTER (part = 'update2') AS update2_last, max(year) FILTER (part = 'holdout') AS holdout_last,
              coalesce(max(year) FILTER (part = 'train') < min(year) FILTER (part = 'update1'), true)
                AND coalesce(max(year) FILTER (part = 'update1') < min(year) FILTER (part = 'update2'), true)
                AND coalesce(max(year) FILTER (part = 'update2') < min(year) FILTER (part = 'holdout'), true) AS ordered
       FROM (SELECT endpoint, part, year::INT AS year FROM temporal) AS x GROUP BY endpoint""",
    [TEMPORAL],
)
def c10t(t):
    return S.time_order_report(temporal_parts(t), ["endpoint"])


@query(
    "c10_time_order_violated",
    """SELECT endpoint, coalesce(max(year) FILTER (part = 'train') < min(year) FILTER (part = 'update1'), true)
                AND coalesce(max(year) FILTER (part = 'update1') < min(year) FILTER (part = 'update2'), true)
                AND coalesce(max(year) FILTER (part = 'update2') < min(year) FILTER (part = 'holdout'), true) AS ordered
       FROM (SELECT endpoint, CASE WHEN part = 'train' AND endpoint < '3' THEN 'holdout' ELSE part END AS part, year FROM temporal) AS x GROUP BY endpoint""",
    [TEMPORAL],
)
def c10v(t):
    """The same report where some endpoints have their oldest rows in the last part."""
    late = F.when((F.col("part") == "train") & (F.col("endpoint") < "3"), "holdout").otherwise(F.col("part"))
    return S.time_order_report(temporal_parts(t).withColumn("part", late), ["endpoint"]).select("endpoint", "ordered")
