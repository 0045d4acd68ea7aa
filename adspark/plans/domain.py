"""Registered queries: distances, neighbours and applicability domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.distance import dense_distance, jaccard_distance
from ..operators import domain as D
from ..operators.neighbours import Space, distance_counts, lay_out, nearest_points
from .registry import query
from .testbed import DESCRIPTORS, EUCLID, JACCARD, SIGN_BITS, bit_rows, descriptors, train_test

DENSE = Space(metric="euclidean")
BITS = Space(metric="jaccard")
KS = [1, 2, 3]
THRESHOLDS = [0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]

# --- SQL twins ------------------------------------------------------------------------------------

SELF_PAIRS = f"""self_pairs AS MATERIALIZED (
  SELECT a.id, b.id AS other, {EUCLID.format(a='a.f', b='b.f')} AS d
  FROM descriptors a, descriptors b WHERE NOT a.is_test AND NOT b.is_test AND a.id <> b.id)"""
TEST_PAIRS = f"""test_pairs AS MATERIALIZED (
  SELECT a.id, b.id AS other, {EUCLID.format(a='a.f', b='b.f')} AS d
  FROM descriptors a, descriptors b WHERE a.is_test AND NOT b.is_test)"""
KS_CTE = "ks AS (SELECT unnest([1, 2, 3]) AS k)"
SELF_NEAR = "self_near AS MATERIALIZED (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM self_pairs)"
TEST_NEAR = "test_near AS MATERIALIZED (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM test_pairs)"
SELF_MEANS = "self_means AS (SELECT id, k, avg(d) AS m FROM self_near JOIN ks ON rn <= k GROUP BY id, k)"
TEST_MEANS = "test_means AS (SELECT id, k, avg(d) AS m FROM test_near JOIN ks ON rn <= k GROUP BY id, k)"
REF = """ref AS (SELECT k, q1, q3, q3 + 1.5::DOUBLE * (q3 - q1) AS r FROM (
  SELECT k, quantile_cont(m, 0.25::DOUBLE) AS q1, quantile_cont(m, 0.75::DOUBLE) AS q3 FROM self_means GROUP BY k) AS q)"""
RAW_LIMITS = """raw_limits AS (
  SELECT i.id, ref.k, coalesce(avg(p.d), 0) AS t
  FROM (SELECT DISTINCT id FROM self_pairs) i CROSS JOIN ref LEFT JOIN self_pairs p ON p.id = i.id AND p.d <= ref.r
  GROUP BY i.id, ref.k)"""
LIMITS = """limits AS MATERIALIZED (
  SELECT id, k, CASE WHEN t = 0 THEN coalesce(min(nullif(t, 0)) OVER (PARTITION BY k), 0) ELSE t END AS t FROM raw_limits)"""
STATUS = """dknn AS (SELECT p.id, l.k AS ad_param, bool_or(l.t >= p.d) AS inside
  FROM test_pairs p JOIN limits l ON l.id = p.other GROUP BY p.id, l.k)"""
NUNC = """nunc AS (SELECT t.id, t.k AS ad_param, t.m AS d_mean, (t.m - s.mu) / CASE WHEN s.sigma = 0 THEN 1e-10 ELSE s.sigma END AS z
  FROM test_means t JOIN (SELECT k, avg(m) AS mu, stddev_pop(m) AS sigma FROM self_means GROUP BY k) s ON s.k = t.k)"""
NUNC_ALL = [DESCRIPTORS, SELF_PAIRS, TEST_PAIRS, KS_CTE, SELF_NEAR, TEST_NEAR, SELF_MEANS, TEST_MEANS, NUNC]
DKNN_TRAIN = [DESCRIPTORS, SELF_PAIRS, KS_CTE, SELF_NEAR, SELF_MEANS, REF, RAW_LIMITS, LIMITS]
DKNN_ALL = [*DKNN_TRAIN, TEST_PAIRS, STATUS]
BIT_PAIRS = f"""bit_pairs AS MATERIALIZED (
  SELECT a.id, b.id AS other, a.is_test, {JACCARD.format(a='a.b', b='b.b')} AS d
  FROM sign_bits a, sign_bits b WHERE NOT b.is_test AND a.id <> b.id)"""
TANIMOTO = f"""tanimoto AS (SELECT id, t.t AS ad_param, min(d) < t.t AS inside FROM bit_pairs,
  (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) t WHERE is_test GROUP BY id, t.t)"""


def limits_long(limits, ks):
    """(id, k, t) from the array of thresholds."""
    params = F.array(*[F.lit(k) for k in ks]).alias("k")
    return limits.select("id", F.explode(F.arrays_zip(params, F.col("limits").alias("t"))).alias("_e")).select(
        "id", F.col("_e.k").alias("k"), F.col("_e.t").alias("t")
    )


# --- distances ------------------------------------------------------------------------------------


def neighbours_by_id(df):
    """Every row next to the row with the following id."""
    other = df.select((F.col("id") - 1).alias("id"), F.col("features").alias("other"))
    return df.join(other, "id")


@query(
    "e1_jaccard_distance",
    f"SELECT a.id, {JACCARD.format(a='a.b', b='b.b')} AS dist FROM sign_bits a JOIN sign_bits b ON b.id = a.id + 1",
    [SIGN_BITS],
    "dist",
)
def e1(t):
    return neighbours_by_id(bit_rows(t)).select("id", jaccard_distance("features", "other").alias("dist"))


@query(
    "e2_dense_distances",
    f"""SELECT a.id, {EUCLID.format(a='a.f', b='b.f')} AS euclidean,
        list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2]))) AS manhattan
        FROM descriptors a JOIN descriptors b ON b.id = a.id + 1""",
    [DESCRIPTORS],
    "euclidean manhattan",
)
def e2(t):
    return neighbours_by_id(descriptors(t)).select(
        "id",
        dense_distance("features", "other", "euclidean", 64).alias("euclidean"),
        dense_distance("features", "other", "manhattan").alias("manhattan"),
    )


@query(
    "e3_nearest_distances",
    """SELECT 'train' AS side, id, rn AS rank, d AS dist FROM self_near WHERE rn <= 3
       UNION ALL SELECT 'test', id, rn, d FROM test_near WHERE rn <= 3""",
    [DESCRIPTORS, SELF_PAIRS, TEST_PAIRS, SELF_NEAR, TEST_NEAR],
    "dist",
)
def e3(t):
    train, test = train_test(descriptors(t))
    sides = [
        D.nearest_distances(train, other, DENSE, 3).select(
            F.lit(name).alias("side"), "id", F.posexplode("dists").alias("rank", "dist")
        )
        for name, other in (("train", None), ("test", test))
    ]
    return sides[0].unionByName(sides[1]).withColumn("rank", (F.col("rank") + 1).cast("bigint"))


@query("e4_mean_nearest_distance", "SELECT id, m AS d_mean FROM self_means WHERE k = 3", [DESCRIPTORS, SELF_PAIRS, KS_CTE, SELF_NEAR, SELF_MEANS], "d_mean")
def e4(t):
    train, _ = train_test(descriptors(t))
    return D.nearest_mean(train, None, DENSE, 3)


@query("e5_reference_values", "SELECT k, r FROM ref", [DESCRIPTORS, SELF_PAIRS, KS_CTE, SELF_NEAR, SELF_MEANS, REF], "r")
def e5(t):
    train, _ = train_test(descriptors(t))
    near = nearest_points(lay_out(train, DENSE), None, max(KS))
    radii = D.reference_values(near, DENSE, KS)
    return radii.select(F.posexplode("radii").alias("k", "r")).withColumn("k", F.col("k") + 1)


@query("e5_quartiles", """SELECT endpoint, q1, q2, q3, q3 - q1 AS iqr FROM (
         SELECT event_type AS endpoint, quantile_cont(value, 0.25::DOUBLE) AS q1, quantile_cont(value, 0.5::DOUBLE) AS q2,
                quantile_cont(value, 0.75::DOUBLE) AS q3 FROM events GROUP BY 1) AS q""", None, "q1 q2 q3 iqr")
def e5q(t):
    rows = t.events.select(F.col("event_type").alias("endpoint"), "value")
    out = ordered.exact_quantiles(rows, ["endpoint"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


@query("e6_dknn_thresholds", "SELECT id, k, t FROM limits", DKNN_TRAIN, "t")
def e6(t):
    train, _ = train_test(descriptors(t))
    return limits_long(D.dknn_thresholds(train, DENSE, KS), KS)


@query(
    "e6b_dknn_thresholds_nearest_only",
    """SELECT id, k, CASE WHEN t = 0 THEN coalesce(min(nullif(t, 0)) OVER (PARTITION BY k), 0) ELSE t END AS t FROM (
         SELECT i.id, ref.k, coalesce(avg(p.d), 0) AS t FROM (SELECT DISTINCT id FROM self_pairs) i CROSS JOIN ref
         LEFT JOIN self_near p ON p.id = i.id AND p.rn <= ref.k AND p.d <= ref.r GROUP BY i.id, ref.k) AS x""",
    DKNN_TRAIN[:6],
    "t",
)
def e6b(t):
    train, _ = train_test(descriptors(t))
    return limits_long(D.dknn_thresholds(train, DENSE, KS, nearest_only=True), KS)


@query(
    "e7_zero_thresholds",
    """SELECT r.id, r.k, r.t AS raw, l.t AS filled FROM raw_limits r JOIN limits l ON r.id = l.id AND r.k = l.k""",
    DKNN_TRAIN,
    "raw filled",
)
def e7(t):
    train, _ = train_test(descriptors(t))
    raw = D.dknn_thresholds(train, DENSE, KS, fill_zero=False)
    filled = limits_long(D.replace_zero_limits(raw, DENSE, len(KS)), KS).withColumnRenamed("t", "filled")
    return limits_long(raw, KS).withColumnRenamed("t", "raw").join(filled, ["id", "k"])


@query("e8_dknn_status", "SELECT id, ad_param, inside FROM dknn", DKNN_ALL)
def e8(t):
    train, test = train_test(descriptors(t))
    return D.dknn_status(train, test, DENSE, KS)


@query("e9_nunc_training_stats", "SELECT avg(m) AS mu, stddev_pop(m) AS sigma FROM self_means WHERE k = 3", [DESCRIPTORS, SELF_PAIRS, KS_CTE, SELF_NEAR, SELF_MEANS], "mu sigma")
def e9(t):
    train, _ = train_test(descriptors(t))
    near = nearest_points(lay_out(train, DENSE), None, 3)
    return D.nunc_training_stats(near, DENSE, D.mean_of("dists"), F.col("weight"))


@query("e10_nunc_status", "SELECT id, ad_param, d_mean, z, z < 1.6448536269514722 AS inside FROM nunc", NUNC_ALL, "d_mean z")
def e10(t):
    train, test = train_test(descriptors(t))
    return D.nunc_status(train, test, DENSE, KS)


@query("e10_nunc_p_value")
def e10p(t):
    train, test = train_test(descriptors(t))
    return D.with_p_value(D.nunc_status(train, test, DENSE, [3]))


@query("e11_tanimoto_status", "SELECT id, ad_param, inside FROM tanimoto", [SIGN_BITS, BIT_PAIRS, TANIMOTO], "ad_param")
def e11(t):
    train, test = train_test(bit_rows(t))
    return D.nearest_status(train, test, BITS, THRESHOLDS)


# --- RDN on given tree outputs --------------------------------------------------------------------

# the descriptor values, mapped to [0, 1], stand for the outputs of as many trees
TREES = """trees AS (SELECT id, y, is_test, list_transform(f, lambda v: v / 2 + 0.5::DOUBLE) AS p FROM descriptors)"""
TRUE_P = "list_transform(p, lambda v: CASE WHEN y = 1 THEN v ELSE 1 - v END)"
AGREE = f"""agree AS (SELECT id, is_test, list_avg(list_transform(tp, lambda v: CASE WHEN v > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS a, list_stddev_pop(tp) AS s
  FROM (SELECT id, is_test, {TRUE_P} AS tp FROM trees) AS x)"""


def tree_outputs(t):
    p = F.transform("features", lambda v: v / 2 + 0.5)
    return descriptors(t).withColumn("trees", p)


def with_weight(df):
    agree, std = D.agreement_classification("trees", "y")
    return df.withColumn("weight", D.agreement_weight(agree, std))


@query("e12_tree_agreement_classification", "SELECT id, a AS agreement, s AS spread, (1 - s) * a AS weight FROM agree", [DESCRIPTORS, TREES, AGREE], "agreement spread weight")
def e12(t):
    agree, std = D.agreement_classification("trees", "y")
    return tree_outputs(t).select("id", agree.alias("agreement"), std.alias("spread"), D.agreement_weight(agree, std).alias("weight"))


@query(
    "e13_tree_agreement_regression",
    """SELECT id, list_avg(list_transform(p, lambda v: exp(-abs(v - y / 2.0::DOUBLE)))) AS agreement,
              (1 - exp(-list_stddev_pop(p))) / (1 + exp(-list_stddev_pop(p))) AS spread FROM trees""",
    [DESCRIPTORS, TREES],
    "agreement spread",
)
def e13(t):
    agree, std = D.agreement_regression(F.col("trees"), F.col("y") / 2.0)
    return tree_outputs(t).select("id", agree.alias("agreement"), std.alias("spread"))


RDN_LIMITS = "rdn_limits AS (SELECT l.id, l.k, l.t * ((1 - s) * a) AS t FROM limits l JOIN agree g ON g.id = l.id)"


@query("e14_rdn_thresholds", "SELECT id, k, t FROM rdn_limits", [*DKNN_TRAIN, TREES, AGREE, RDN_LIMITS], "t")
def e14(t):
    train, _ = train_test(with_weight(tree_outputs(t)))
    limits = D.dknn_thresholds(train, DENSE, KS)
    return limits_long(D.weighted_limits(limits, train.select("id", "weight"), DENSE), KS)


@query(
    "e15_scaled_thresholds",
    "SELECT id, k, t * CASE WHEN k < 31 THEN 1.0::DOUBLE / 3 WHEN k < 41 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS t FROM limits",
    [DKNN_TRAIN[0], DKNN_TRAIN[1], "ks AS (SELECT unnest([3, 35, 45]) AS k)", *DKNN_TRAIN[3:]],
    "t",
)
def e15(t):
    ks = [3, 35, 45]
    train, _ = train_test(descriptors(t))
    long = limits_long(D.dknn_thresholds(train, DENSE, ks), ks)
    scale = F.create_map(*[F.lit(v) for k in ks for v in (k, float(D.scale_by_k(k)))])
    return long.withColumn("t", F.col("t") * scale[F.col("k")])


RDN_STATUS = """rdn AS (SELECT p.id, bool_or(l.t >= p.d) AS inside
  FROM test_pairs p JOIN rdn_limits l ON l.id = p.other AND l.k = 3 GROUP BY p.id)"""
RDN_ALL = [*DKNN_ALL, TREES, AGREE, RDN_LIMITS, RDN_STATUS]


@query("e16_rdn_status", "SELECT id, inside FROM rdn", RDN_ALL)
def e16(t):
    train, test = train_test(with_weight(tree_outputs(t)))
    return D.rdn_status(train, test, DENSE, 3).select("id", "inside")


FOUR = """four AS (
  SELECT 'dkNN' AS ad_method, id, inside FROM dknn WHERE ad_param = 3
  UNION ALL SELECT 'RDN', id, inside FROM rdn
  UNION ALL SELECT 'UNC', id, z < 1.6448536269514722 FROM nunc WHERE ad_param = 3
  UNION ALL SELECT 'Tanimoto', id, inside FROM tanimoto WHERE ad_param = 0.35::DOUBLE)"""
FOUR_ALL = [*RDN_ALL, TEST_NEAR, TEST_MEANS, NUNC, SIGN_BITS, BIT_PAIRS, TANIMOTO, FOUR]


def four_methods(t):
    train, test = train_test(with_weight(tree_outputs(t)))
    bit_train, bit_test = train_test(bit_rows(t))
    shared = D.prepare(train, test, DENSE, 3)
    parts = [
        D.inside_outside("dkNN", train, test, DENSE, 3, shared).withColumn("ad_method", F.lit("dkNN")),
        D.inside_outside("RDN", train, test, DENSE, 3, shared).withColumn("ad_method", F.lit("RDN")),
        D.inside_outside("UNC", train, test, DENSE, 3, shared).withColumn("ad_method", F.lit("UNC")),
        D.inside_outside("Tanimoto", bit_train, bit_test, BITS, 0.35).withColumn("ad_method", F.lit("Tanimoto")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("e17_inside_outside_all_methods", "SELECT ad_method, id, inside FROM four", FOUR_ALL)
def e17(t):
    return four_methods(t)


@query(
    "e18_subsets",
    """SELECT id, label, 'All' AS subset FROM descriptors WHERE is_test
       UNION ALL SELECT d.id, d.label, CASE WHEN s.inside THEN 'Inside' ELSE 'Outside' END
       FROM descriptors d JOIN dknn s ON s.id = d.id AND s.ad_param = 3""",
    DKNN_ALL,
)
def e18(t):
    train, test = train_test(descriptors(t))
    status = D.dknn_status(train, test, DENSE, [3]).select("id", "inside")
    return D.tag_subsets(test.select("id", "label").join(status, "id")).select("id", "label", "subset")


@query(
    "e19_parameter_sweep",
    """SELECT ad_method, ad_param, round(100 * avg(inside::INT), 0) AS percent_inside, count(*) AS n FROM (
         SELECT 'Tanimoto' AS ad_method, ad_param, inside FROM tanimoto
         UNION ALL SELECT 'dkNN', ad_param::DOUBLE, inside FROM dknn
         UNION ALL SELECT 'UNC', ad_param::DOUBLE, z < 1.6448536269514722 FROM nunc) AS s GROUP BY 1, 2""",
    [DESCRIPTORS, SELF_PAIRS, "ks AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k)", SELF_NEAR, SELF_MEANS, REF, RAW_LIMITS, LIMITS, TEST_PAIRS, STATUS,
     TEST_NEAR, TEST_MEANS, NUNC, SIGN_BITS, BIT_PAIRS, TANIMOTO],
    "ad_param percent_inside",
)
def e19(t):
    ks = [1, 2, 3, 4, 5, 6]
    train, test = train_test(descriptors(t))
    bit_train, bit_test = train_test(bit_rows(t))
    shared = D.prepare(train, test, DENSE, max(ks))
    parts = {
        "Tanimoto": D.nearest_status(bit_train, bit_test, BITS, THRESHOLDS),
        "dkNN": D.dknn_status(train, test, DENSE, ks, shared=shared),
        "UNC": D.nunc_status(train, test, DENSE, ks, shared),
    }
    status = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.select(F.lit(m).alias("ad_method"), F.col("ad_param").cast("double").alias("ad_param"), "inside")
            for m, df in parts.items()
        ],
    )
    return D.percent_inside(status, ["ad_method", "ad_param"])


DIST_COUNTS = """dist_counts AS (
  SELECT 'train-train' AS sides, d AS dist, count(*) AS pairs FROM bit_pairs WHERE NOT is_test AND id < other GROUP BY d
  UNION ALL SELECT 'train-test', d, count(*) FROM bit_pairs WHERE is_test GROUP BY d)"""


def bit_distance_counts(t):
    train_rows, test_rows = train_test(bit_rows(t))
    train = lay_out(train_rows, BITS)
    test = lay_out(test_rows, BITS, train.pivots)
    own = distance_counts(train, None).withColumn("sides", F.lit("train-train"))
    return own.unionByName(distance_counts(train, test).withColumn("sides", F.lit("train-test")))


@query(
    "e20_distance_distribution",
    "SELECT sides, floor(least(dist, 0.999999::DOUBLE) * 50)::BIGINT AS bin, sum(pairs)::BIGINT AS pairs FROM dist_counts GROUP BY 1, 2",
    [SIGN_BITS, BIT_PAIRS, DIST_COUNTS],
)
def e20(t):
    bins = F.floor(F.least(F.col("dist"), F.lit(0.999999)) * 50)
    return bit_distance_counts(t).groupBy("sides", bins.alias("bin")).agg(F.sum("pairs").alias("pairs"))


@query(
    "e20_distance_medians",
    """SELECT 'train-train' AS sides, median(d) AS median FROM bit_pairs WHERE NOT is_test AND id < other
       UNION ALL SELECT 'train-test', median(d) FROM bit_pairs WHERE is_test""",
    [SIGN_BITS, BIT_PAIRS],
    "median",
)
def e20m(t):
    return ordered.exact_quantiles(bit_distance_counts(t), ["sides"], "dist", {"median": 0.5}, weight="pairs")


FOLD_PAIRS = "fold_pairs AS MATERIALIZED (SELECT id, other, is_test, d, (id % 3)::VARCHAR AS fold FROM bit_pairs WHERE id % 3 = other % 3)"


def median_distances(train_rows, test_rows, by, merged=False):
    """(sides, by, median) of the distances within a group; ``merged`` adds all groups taken together."""
    space = Space(metric="jaccard", by=(by,))
    train = lay_out(train_rows, space)
    test = lay_out(test_rows, space, train.pivots)
    own = distance_counts(train, None).withColumn("sides", F.lit("train-train"))
    counts = own.unionByName(distance_counts(train, test).withColumn("sides", F.lit("train-test")))
    if merged:
        counts = counts.withColumn(by, F.explode(F.array(F.col(by), F.lit("merged"))))
    counts = counts.groupBy("sides", by, "dist").agg(F.sum("pairs").alias("pairs"))
    return ordered.exact_quantiles(counts, ["sides", by], "dist", {"median": 0.5}, weight="pairs")


@query(
    "e20_distance_medians_per_fold",
    """SELECT 'train-train' AS sides, f.fold, median(d) AS median FROM fold_pairs p, (VALUES ('0'), ('1'), ('2'), ('merged')) AS f(fold)
       WHERE NOT is_test AND id < other AND f.fold IN (p.fold, 'merged') GROUP BY f.fold
       UNION ALL SELECT 'train-test', f.fold, median(d) FROM fold_pairs p, (VALUES ('0'), ('1'), ('2'), ('merged')) AS f(fold)
       WHERE is_test AND f.fold IN (p.fold, 'merged') GROUP BY f.fold""",
    [SIGN_BITS, BIT_PAIRS, FOLD_PAIRS],
    "median",
)
def e20f(t):
    rows = bit_rows(t).withColumn("fold", (F.col("id") % 3).cast("string"))
    return median_distances(*train_test(rows), "fold", merged=True)


@query(
    "e20_distance_medians_per_update",
    f"""SELECT 'train-train' AS sides, u.n AS step, median({JACCARD.format(a='a.b', b='b.b')}) AS median
        FROM sign_bits a, sign_bits b, (VALUES (1), (2), (3)) AS u(n) WHERE a.id < b.id AND a.id % 4 < u.n AND b.id % 4 < u.n GROUP BY u.n
        UNION ALL SELECT 'train-test', u.n, median({JACCARD.format(a='a.b', b='b.b')})
        FROM sign_bits a, sign_bits b, (VALUES (1), (2), (3)) AS u(n) WHERE a.id % 4 = u.n AND b.id % 4 < u.n GROUP BY u.n""",
    [SIGN_BITS],
    "median",
)
def e20u(t):
    """Update n is tested on the rows of its part and trained on those of all parts before."""
    part = (F.col("id") % 4).cast("int")
    train = bit_rows(t).withColumn("step", F.explode(F.filter(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: n > part)))
    test = bit_rows(t).withColumn("step", part).where("step > 0")
    return median_distances(train, test, "step")


@query("b19_all_copies", "SELECT min(c) > 1 AS all_duplicated FROM (SELECT count(*) AS c FROM sign_bits WHERE NOT is_test GROUP BY b) AS x", [SIGN_BITS])
def b19(t):
    return D.all_copies(train_test(bit_rows(t))[0], BITS)
