"""Registered queries: calibrated probabilities and prediction intervals from given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as V
from ..operators import intervals as I
from ..operators.domain import spread_of
from .registry import query
from .testbed import CLASS, DESCRIPTORS, REG, class_scores, reg_predictions
from .domain import TREES, tree_outputs

LEVELS = (0.0, 0.1, 0.2, 0.32, 0.5, 0.7, 0.9)
LEVELS_CTE = "levels AS (SELECT unnest([0.0, 0.1, 0.2, 0.32, 0.5, 0.7, 0.9]::DOUBLE[]) AS sig_level)"

# --- Venn-ABERS: the first three weeks calibrate the later ones -----------------------------------

SCORES = """scores AS (SELECT endpoint, fold, test_set IN ('W1', 'W2', 'W3') AS cal, id, y, round(prob, 2) AS score FROM class_scores)"""


def two_digit_scores(t):
    rows = class_scores(t).select("endpoint", "fold", "test_set", "id", "y", F.round("prob", 2).alias("score"))
    early = F.col("test_set").isin("W1", "W2", "W3")
    return rows.where(early).drop("test_set"), rows.where(~early).drop("test_set")


def venn_ctes(keys: str, test: str) -> list[str]:
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    return [
        f"cal AS (SELECT {keys}, score, count(*) AS c, sum(y) AS s FROM scores WHERE cal GROUP BY ALL)",
        f"""cum AS (SELECT {keys}, row_number() OVER w AS pos, sum(c) OVER w AS n, sum(s) OVER w AS s FROM cal WINDOW w AS (PARTITION BY {keys} ORDER BY score)
  UNION ALL SELECT DISTINCT {keys}, 0, 0, 0 FROM cal)""",
        f"""va AS MATERIALIZED (SELECT {keys}, pos, max(m0) AS p0, max(m1) AS p1 FROM (
    SELECT p.{keys.replace(', ', ', p.')}, p.pos, a.pos AS apos, min((b.s - a.s)::DOUBLE / (b.n - a.n + 1)) AS m0, min((b.s - a.s + 1)::DOUBLE / (b.n - a.n + 1)) AS m1
    FROM cum p JOIN cum a ON {on('a', 'p')} AND a.pos <= p.pos JOIN cum b ON {on('b', 'p')} AND b.pos >= p.pos GROUP BY ALL) AS g
  GROUP BY ALL)""",
        f"""placed AS (SELECT t.*, (SELECT count(*) FROM cal c WHERE {on('c', 't')} AND c.score < t.score) AS below,
    (SELECT count(*) FROM cal c WHERE {on('c', 't')} AND c.score <= t.score) AS upto,
    (SELECT count(*) FROM cal c WHERE {on('c', 't')}) AS k FROM ({test}) t)""",
        f"""multi AS (SELECT p.*, CASE WHEN below = 0 THEN 0.0::DOUBLE ELSE v0.p0 END AS p0, v1.p1 FROM placed p
  JOIN va v0 ON {on('v0', 'p')} AND v0.pos = p.below JOIN va v1 ON {on('v1', 'p')} AND v1.pos = least(p.upto, p.k - 1))""",
    ]


VENN = [*CLASS[:2], SCORES, *venn_ctes("endpoint", "SELECT endpoint, id, score FROM scores WHERE NOT cal")]


@query("d14_step_lookup", "SELECT endpoint, id, score, below, upto, k AS groups FROM placed", VENN, "score")
def d14(t):
    calibration, test = two_digit_scores(t)
    return V.step_positions(calibration, test.select("endpoint", "id", "score"), ["endpoint"])


@query("f9_venn_abers_table", "SELECT endpoint, pos, p0, p1 FROM va", VENN, "p0 p1")
def f9t(t):
    calibration, _ = two_digit_scores(t)
    return V.venn_abers_table(calibration, ["endpoint"])


@query("f9_venn_abers", "SELECT endpoint, id, score, p0, p1 FROM multi", VENN, "score p0 p1")
def f9(t):
    calibration, test = two_digit_scores(t)
    return V.venn_abers(calibration, test.select("endpoint", "id", "score"), ["endpoint"])


@query("f9_venn_abers_full_scores")
def f9f(t):
    """Scores without rounding: thousands of distinct values, solved in several ranges."""
    rows = class_scores(t).select("endpoint", "test_set", "id", "y", F.col("prob").alias("score"))
    early = F.col("test_set").isin("W1", "W2", "W3")
    test = rows.where(~early).select("endpoint", "id", "score")
    return V.venn_abers(rows.where(early), test, ["endpoint"], range_rows=256)


@query("f10_single_probability", "SELECT endpoint, pos, p1 / (1 - p0 + p1) AS prob FROM va WHERE pos > 0", VENN, "prob")
def f10(t):
    calibration, _ = two_digit_scores(t)
    table = V.venn_abers_table(calibration, ["endpoint"]).where("pos > 0")
    return table.select("endpoint", "pos", V.single_probability().alias("prob"))


@query(
    "f11_ivap",
    "SELECT endpoint, id, p0, p1, p1 / (1 - p0 + p1) AS prob, p0 < p1 / (1 - p0 + p1) AND p1 / (1 - p0 + p1) < p1 AS ordered FROM multi",
    VENN,
    "p0 p1 prob",
)
def f11(t):
    calibration, test = two_digit_scores(t)
    return V.ivap(calibration, test.select("endpoint", "id", "score"), ["endpoint"]).drop("score")


CROSS = [
    *CLASS[:2],
    SCORES,
    *venn_ctes("endpoint, fold", "SELECT s.endpoint, f.fold, s.id, s.score FROM scores s, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f WHERE NOT s.cal"),
]


@query(
    "f12_cvap",
    """SELECT endpoint, id, p0, p1, p1 / (1 - p0 + p1) AS prob FROM (
         SELECT endpoint, id, 1 - CASE WHEN min(1 - p0) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN 1 - p0 > 0 THEN 1 - p0 END))) END AS p0,
                CASE WHEN min(p1) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN p1 > 0 THEN p1 END))) END AS p1 FROM multi GROUP BY 1, 2) AS g""",
    CROSS,
    "p0 p1 prob",
)
def f12(t):
    calibration, test = two_digit_scores(t)
    each = test.select("endpoint", "id", "score", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    return V.cvap(V.venn_abers(calibration, each, ["endpoint", "fold"]), ["endpoint"])


@query(
    "f14_class_and_confidence",
    "SELECT id, fold, CASE WHEN prob > 1 - prob THEN 1 ELSE 0 END AS pred_class, greatest(prob, 1 - prob) AS confidence FROM class_scores",
    CLASS[:2],
    "confidence",
)
def f14(t):
    best = V.class_and_confidence(F.create_map(F.lit(1), F.col("prob"), F.lit(0), 1 - F.col("prob")))
    return class_scores(t).select("id", "fold", best.alias("b")).select(
        "id", "fold", F.col("b.class").alias("pred_class"), F.col("b.confidence").alias("confidence")
    )


@query("f6_class_1_scores", "SELECT id, prob AS score, prob >= 0 AND prob <= 1 AS valid FROM class_scores", CLASS[:2], "score")
def f6(t):
    return class_scores(t).select("id", F.col("prob").alias("score"), F.col("prob").between(0, 1).alias("valid"))


# --- intervals from tree outputs -------------------------------------------------------------------

PRED = "list_avg(p)"


@query("f5_tree_spread", "SELECT id, list_avg(p) AS pred, list_stddev_pop(p) AS spread FROM trees", [DESCRIPTORS, TREES], "pred spread")
def f5(t):
    return tree_outputs(t).select("id", I.tree_mean("trees").alias("pred"), spread_of("trees").alias("spread"))


@query(
    "f15_ensemble_interval",
    """SELECT id, list_avg(p) - round(0.9944578832097532::DOUBLE * list_stddev_pop(p), 3) AS lower,
              list_avg(p) + round(0.9944578832097532::DOUBLE * list_stddev_pop(p), 3) AS upper FROM trees""",
    [DESCRIPTORS, TREES],
    "lower upper",
)
def f15(t):
    bounds = I.ensemble_interval(I.tree_mean("trees"), F.col("trees"), 68)
    return tree_outputs(t).select("id", bounds.alias("i")).select("id", "i.lower", "i.upper")


@query(
    "f16_percentile_interval",
    """SELECT id, pred - (hi - lo) / 2 AS lower, pred + (hi - lo) / 2 AS upper FROM (
         SELECT id, avg(v) AS pred, quantile_cont(v, 0.16::DOUBLE) AS lo, quantile_cont(v, 0.84::DOUBLE) AS hi
         FROM (SELECT id, unnest(p) AS v FROM trees) AS u GROUP BY id) AS q""",
    [DESCRIPTORS, TREES],
    "lower upper",
)
def f16(t):
    bounds = I.percentile_interval(I.tree_mean("trees"), F.col("trees"), 68)
    return tree_outputs(t).select("id", bounds.alias("i")).select("id", "i.lower", "i.upper")


# --- conformal regression on given predictions -------------------------------------------------------

CONFORMAL = """conformal AS (SELECT id, endpoint, test_set, fold, y, pred, exp(half / 10.0::DOUBLE) AS scale FROM reg_predictions),
alphas AS (SELECT endpoint, id, fold, abs(y - pred) / scale AS alpha FROM conformal WHERE test_set = 'F')"""
QUANTILES = """quantiles AS (
  SELECT endpoint, sig_level, max(alpha) FILTER (rn = s) AS alpha_s
  FROM (SELECT a.*, l.sig_level, least(greatest(floor(l.sig_level * (a.n + 1)), 1), a.n) AS s
        FROM (SELECT endpoint, alpha, row_number() OVER (PARTITION BY endpoint ORDER BY alpha DESC) AS rn, count(*) OVER (PARTITION BY endpoint) AS n FROM alphas) a, levels l) AS x
  GROUP BY endpoint, sig_level)"""
CONF = [REG[0], LEVELS_CTE, CONFORMAL, QUANTILES]


def conformal_rows(t):
    rows = reg_predictions(t).select(
        "id", "endpoint", "test_set", "fold", "y", "pred", F.exp(F.col("half") / 10.0).alias("scale")
    )
    return rows.where("test_set = 'F'"), rows.where("test_set <> 'F'")


@query("f17_nonconformity", "SELECT endpoint, id, fold, alpha FROM alphas", CONF[:3], "alpha")
def f17(t):
    calibration, _ = conformal_rows(t)
    return calibration.select("endpoint", "id", "fold", I.nonconformity().alias("alpha"))


@query("f18_conformal_quantiles", "SELECT endpoint, sig_level, alpha_s FROM quantiles", CONF, "sig_level alpha_s")
def f18(t):
    calibration, _ = conformal_rows(t)
    scored = calibration.select("endpoint", I.nonconformity().alias("alpha"))
    return I.conformal_quantiles(scored, ["endpoint"], LEVELS)


@query(
    "f19_conformal_intervals",
    """SELECT c.endpoint, c.id, c.pred, q.sig_level, c.pred - q.alpha_s * c.scale AS lower, c.pred + q.alpha_s * c.scale AS upper
       FROM conformal c JOIN quantiles q ON q.endpoint = c.endpoint WHERE c.test_set <> 'F' AND q.sig_level = 0.32::DOUBLE""",
    CONF,
    "pred sig_level lower upper",
)
def f19(t):
    calibration, test = conformal_rows(t)
    out = I.icp(calibration, test.select("endpoint", "id", "pred", "scale"), ["endpoint"], (0.32,))
    return out.drop("scale")


SPLITS = """splits AS (SELECT r.id, r.endpoint, s.split, 0.32::DOUBLE AS sig_level,
  r.pred - r.half * (1 + s.split * 0.25::DOUBLE) AS lower, r.pred + r.half * (1 + ((s.split * 3) % 5) * 0.25::DOUBLE) AS upper
  FROM reg_predictions r, (SELECT unnest([0, 1, 2, 3, 4]) AS split) s)"""


@query(
    "f21_aggregated_intervals",
    "SELECT id, endpoint, sig_level, lower, upper, (lower + upper) / 2 AS pred FROM (SELECT id, endpoint, sig_level, median(lower) AS lower, median(upper) AS upper FROM splits GROUP BY 1, 2, 3) AS m",
    [REG[0], SPLITS],
    "sig_level lower upper pred",
    digits=10,
)
def f21(t):
    rows = reg_predictions(t).select("id", "endpoint", "pred", "half", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split"))
    each = rows.select(
        "id", "endpoint", "split", F.lit(0.32).alias("sig_level"),
        (F.col("pred") - F.col("half") * (1 + F.col("split") * 0.25)).alias("lower"),
        (F.col("pred") + F.col("half") * (1 + ((F.col("split") * 3) % 5) * 0.25)).alias("upper"),
    )
    return I.acp(each, ["id", "endpoint"])


@query(
    "f22_midpoint_of_unbounded",
    "SELECT id, fold, CASE WHEN half < 0.5::DOUBLE THEN 0.0::DOUBLE ELSE pred END AS mid FROM reg_predictions",
    REG[:1],
    "mid",
)
def f22(t):
    inf = F.lit(float("inf"))
    open_ended = F.col("half") < 0.5
    lower = F.when(open_ended, -inf).otherwise(F.col("pred") - F.col("half"))
    upper = F.when(open_ended, inf).otherwise(F.col("pred") + F.col("half"))
    return reg_predictions(t).select("id", "fold", I.midpoint(lower, upper).alias("mid"))


@query(
    "f22_unbounded_checks",
    """SELECT endpoint, count(*) AS n, count_if(fold % 3 = 1) AS unbounded, count_if(fold % 7 = 6) AS mismatched FROM reg_predictions GROUP BY 1""",
    REG[:1],
)
def f22c(t):
    """Folds without bounds, with one bound (both as they should be), and with a missing bound."""
    inf, fold = F.lit(float("inf")), F.col("fold")
    lower = F.when(fold % 7 == 6, F.lit(float("nan"))).when(fold % 3 == 1, -inf).otherwise(F.col("pred") - F.col("half"))
    upper = F.when(fold % 3 == 1, inf).when(fold % 3 == 2, inf).otherwise(F.col("pred") + F.col("half"))
    return I.midpoint_checks(reg_predictions(t).select("endpoint", lower.alias("lower"), upper.alias("upper")), ["endpoint"])


@query(
    "f23_synergy_intervals",
    """SELECT c.endpoint, c.id, c.pred + 0.2::DOUBLE AS pred, q.sig_level, c.pred + 0.2::DOUBLE - q.alpha_s * 1.2::DOUBLE * exp(ln(c.scale)) AS lower,
              c.pred + 0.2::DOUBLE + q.alpha_s * 1.2::DOUBLE * exp(ln(c.scale)) AS upper
       FROM conformal c JOIN quantiles q ON q.endpoint = c.endpoint WHERE c.test_set <> 'F' AND q.sig_level = 0.1::DOUBLE""",
    CONF,
    "pred sig_level lower upper",
)
def f23(t):
    calibration, test = conformal_rows(t)
    part = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("part")
    cal = calibration.select("endpoint", "id", "fold", I.nonconformity().alias("a"), part).select(
        "endpoint", F.concat_ws("/", "id", "fold").alias("id"), (F.col("a") * (1 + F.col("part") * 0.1)).alias("alpha")
    )
    new = test.select("endpoint", "id", "pred", "scale", part).select(
        "endpoint", "id", (F.col("pred") + F.col("part") * 0.1).alias("pred"), F.ln("scale").alias("spread")
    )
    return I.scp(cal, new, ["endpoint"], (0.1,)).drop("scale")


@query(
    "f25_interval_checks",
    """SELECT endpoint, count(*) AS n, count_if(upper < lower) AS reversed, count_if(mid < lower OR mid > upper) AS outside
       FROM (SELECT endpoint, pred - (half - 0.6::DOUBLE) AS lower, pred + (half - 0.6::DOUBLE) AS upper, pred + (fold - 3) * 0.2::DOUBLE AS mid FROM reg_predictions) AS x
       GROUP BY 1""",
    REG[:1],
)
def f25(t):
    # half widths cut so far that some turn negative, and predictions moved away from the middle
    cut = F.col("half") - 0.6
    rows = reg_predictions(t).select(
        "endpoint", (F.col("pred") - cut).alias("lower"), (F.col("pred") + cut).alias("upper"), (F.col("pred") + (F.col("fold") - 3) * 0.2).alias("pred")
    )
    return I.interval_checks(rows, ["endpoint"])


@query(
    "f26_prediction_consistency",
    """SELECT id, fold, max(p) - min(p) AS gap FROM (
         SELECT id, fold, pred + CASE WHEN half > 1.2::DOUBLE THEN l ELSE 0 END AS p FROM reg_predictions, (VALUES (0.1::DOUBLE), (0.9::DOUBLE)) AS s(l)) AS x
       GROUP BY id, fold HAVING max(p) > min(p)""",
    REG[:1],
    "gap",
)
def f26(t):
    """Rows whose prediction moves with the significance level (here: wide ones by construction)."""
    level = F.explode(F.array(F.lit(0.1), F.lit(0.9))).alias("sig_level")
    rows = reg_predictions(t).select("id", "fold", "pred", "half", level)
    moved = rows.withColumn("pred", F.col("pred") + F.when(F.col("half") > 1.2, F.col("sig_level")).otherwise(0.0))
    return I.prediction_consistency(moved, ["id", "fold"])
