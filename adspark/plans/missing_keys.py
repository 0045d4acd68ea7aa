"""Registered queries in which a group key is missing: those rows are a group like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..operators import calibrate as V, clean as C, domain as D, intervals as I, metrics as M, shift as H, splits as S
from ..operators.neighbours import Space
from .registry import query
from .testbed import CLASS, DESCRIPTORS, EUCLID, REG, class_scores, descriptors, reg_predictions

# results without a fold keep it missing: fold 0 stands for them here
SCORES = """scores AS MATERIALIZED (SELECT id, endpoint, nullif(fold, 0) AS fold, y, prob, inside FROM class_scores)"""
VALUES = """vals AS MATERIALIZED (SELECT id, nullif(endpoint, 'A') AS endpoint, nullif(fold, 1) AS fold, y, pred, half, inside FROM reg_predictions)"""


def scores(t):
    return class_scores(t).withColumn("fold", F.nullif(F.col("fold"), F.lit(0)))


def values(t):
    rows = reg_predictions(t)
    return rows.withColumn("endpoint", F.nullif(F.col("endpoint"), F.lit("A"))).withColumn("fold", F.nullif(F.col("fold"), F.lit(1)))


@query("b5b_ids_with_missing_key", "SELECT doc_id, nullif(lang, 'fr') AS key, dense_rank() OVER (ORDER BY nullif(lang, 'fr') NULLS FIRST) - 1 AS id FROM documents")
def ids(t):
    return C.dense_ids(t.documents.select("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("key")), "key")


@query(
    "c3_split_with_missing_fold",
    """SELECT fold, id, CASE WHEN rn <= floor(exact) + (place <= total - whole)::INT THEN 'test' ELSE 'train' END AS role FROM (
         SELECT s.fold, s.id, q.*, row_number() OVER (PARTITION BY s.fold, s.y ORDER BY md5(concat_ws('|', s.id, 11, s.fold)), s.id) AS rn
         FROM scores s JOIN (
           SELECT fold AS f, y AS st, exact, total, sum(floor(exact)) OVER (PARTITION BY fold) AS whole,
                  row_number() OVER (PARTITION BY fold ORDER BY round(exact - floor(exact), 9) DESC, y) AS place
           FROM (SELECT *, total * c / n AS exact FROM (
             SELECT *, ceil(round(n * 0.25::DOUBLE, 9)) AS total FROM (
               SELECT fold, y, count(*) AS c, sum(count(*)) OVER (PARTITION BY fold) AS n FROM scores GROUP BY 1, 2) AS a) AS b) AS d
         ) q ON q.f IS NOT DISTINCT FROM s.fold AND q.st = s.y) AS x""",
    [*CLASS[:2], SCORES],
)
def split(t):
    rows = scores(t).select("fold", "id", "y")
    return S.stratified_split(rows, "id", "y", 0.25, 11, ["fold"]).select("fold", "id", "role")


@query("e5_quartiles_with_missing_fold", "SELECT fold, quantile_cont(prob, 0.25::DOUBLE) AS q1, quantile_cont(prob, 0.75::DOUBLE) AS q3 FROM scores GROUP BY 1", [*CLASS[:2], SCORES], "q1 q3")
def quartiles(t):
    return ordered.exact_quantiles(scores(t), ["fold"], "prob", {"q1": 0.25, "q3": 0.75})


@query(
    "g5_auc_with_missing_fold",
    """SELECT fold, (sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (count_if(y = 1)::DOUBLE * count_if(y = 0)) AS auc
       FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY prob) + (count(*) OVER (PARTITION BY fold, prob) - 1) / 2.0::DOUBLE AS rk FROM scores) AS x GROUP BY 1""",
    [*CLASS[:2], SCORES],
    "auc",
)
def auc(t):
    return M.auc(scores(t), ["fold"])


@query(
    "g11_observed_probability_with_missing_fold",
    """SELECT fold, 0.05::DOUBLE AS delta, prob, c AS rows, (SELECT sum(q.o)::DOUBLE / sum(q.c) FROM points q WHERE q.fold IS NOT DISTINCT FROM p.fold AND abs(q.prob - p.prob) < 0.05::DOUBLE) AS observed
       FROM points p""",
    [*CLASS[:2], SCORES, "points AS MATERIALIZED (SELECT fold, prob, count(*) AS c, sum(y) AS o FROM (SELECT fold, y, round(prob, 3) AS prob FROM scores) AS r GROUP BY 1, 2)"],
    "delta prob observed",
)
def observed(t):
    rows = scores(t).select("fold", "y", F.round("prob", 3).alias("prob"), F.lit(0.05).alias("delta"))
    return M.observed_probability(rows, ["fold"])


@query(
    "g16_spearman_with_missing_fold",
    """SELECT fold, corr(a, b) AS rho FROM (
         SELECT fold, rank() OVER (PARTITION BY fold ORDER BY pred) + (count(*) OVER (PARTITION BY fold, pred) - 1) / 2.0::DOUBLE AS a,
                rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0::DOUBLE AS b FROM vals) AS x GROUP BY 1""",
    [REG[0], VALUES],
    "rho",
)
def spearman(t):
    return ordered.spearman(values(t), ["fold"], "pred", "y", "rho")


@query(
    "f18_quantiles_with_missing_endpoint",
    """SELECT endpoint, 0.2::DOUBLE AS sig_level, max(alpha) FILTER (rn = least(greatest(floor(0.2::DOUBLE * (n + 1)), 1), n)) AS alpha_s
       FROM (SELECT endpoint, alpha, row_number() OVER (PARTITION BY endpoint ORDER BY alpha DESC) AS rn, count(*) OVER (PARTITION BY endpoint) AS n
             FROM (SELECT endpoint, abs(y - pred) / half AS alpha FROM vals) AS a) AS x GROUP BY 1""",
    [REG[0], VALUES],
    "sig_level alpha_s",
)
def conformal(t):
    rows = values(t).select("endpoint", I.nonconformity(scale="half").alias("alpha"))
    return I.conformal_quantiles(rows, ["endpoint"], (0.2,))


@query(
    "d14_lookup_with_missing_fold",
    """SELECT t.fold, t.id, t.score, (SELECT count(*) FROM cal c WHERE c.fold IS NOT DISTINCT FROM t.fold AND c.score < t.score) AS below,
              (SELECT count(*) FROM cal c WHERE c.fold IS NOT DISTINCT FROM t.fold AND c.score <= t.score) AS upto,
              (SELECT count(*) FROM cal c WHERE c.fold IS NOT DISTINCT FROM t.fold) AS groups
       FROM (SELECT fold, id, round(prob, 2) AS score FROM scores WHERE NOT inside) t""",
    [*CLASS[:2], SCORES, "cal AS MATERIALIZED (SELECT DISTINCT fold, round(prob, 2) AS score FROM scores WHERE inside)"],
    "score",
)
def lookup(t):
    rows = scores(t).select("fold", "id", F.round("prob", 2).alias("score"), "inside")
    return V.step_positions(rows.where("inside"), rows.where("NOT inside").select("fold", "id", "score"), ["fold"])


@query(
    "h2_strata_with_missing_fold",
    """SELECT fold, stratum, inside, count(*) AS n FROM (
         SELECT r.*, CASE WHEN hi > lo THEN least(greatest(floor((y - lo) / ((hi - lo) / b)), 0), b - 1) ELSE 0 END::INT AS stratum
         FROM vals r JOIN (SELECT fold AS f, min(y) FILTER (inside) AS lo, max(y) FILTER (inside) AS hi, greatest(2, least(5, count(DISTINCT y) FILTER (inside))) AS b
                           FROM vals GROUP BY 1) s ON s.f IS NOT DISTINCT FROM r.fold) AS x GROUP BY ALL""",
    [REG[0], VALUES],
)
def strata(t):
    return H.value_strata(values(t), ["fold"]).groupBy("fold", "stratum", "inside").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h12_adjusted_with_missing_family",
    """SELECT fold, id, p, least(1.0::DOUBLE, min(q) OVER (PARTITION BY fold ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted
       FROM (SELECT *, p * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, m + 1) AS r(i)) / cume AS q FROM (
         SELECT fold, id, p, count(*) OVER (PARTITION BY fold) AS m, count(*) OVER (PARTITION BY fold ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cume
         FROM (SELECT fold, id, prob * prob / 50 AS p FROM scores) AS s) AS g) AS f""",
    [*CLASS[:2], SCORES],
    "p p_adjusted",
)
def adjusted(t):
    rows = scores(t).select("fold", "id", (F.col("prob") * F.col("prob") / 50).alias("p"))
    return H.adjust_p_values(rows, ["fold"])


@query(
    "e4_nearest_with_missing_group",
    f"""SELECT grp, id, avg(d) AS d_mean FROM (
          SELECT a.grp, a.id, {EUCLID.format(a='a.f', b='b.f')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {EUCLID.format(a='a.f', b='b.f')}) AS rn
          FROM g a JOIN g b ON a.grp IS NOT DISTINCT FROM b.grp AND a.id <> b.id) AS x WHERE rn <= 3 GROUP BY 1, 2""",
    [DESCRIPTORS, "g AS MATERIALIZED (SELECT id, f, nullif(label % 3, 0) AS grp FROM descriptors WHERE NOT is_test)"],
    "d_mean",
)
def nearest(t):
    from .testbed import train_test

    train, _ = train_test(descriptors(t))
    rows = train.select("id", "features", F.nullif(F.col("label") % 3, F.lit(0)).alias("grp"))
    return D.nearest_mean(rows, None, Space(by=("grp",)), 3)
