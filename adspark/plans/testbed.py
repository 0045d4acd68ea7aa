"""Model results derived from the driver's tables: the same formulas for Spark and for SQL.

The tables hold no model output, so scores, predictions and domain flags are fixed expressions
of their columns; every row of the source takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

# --- binary scores from events -----------------------------------------------------------------


def events_base(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    week = F.concat(F.lit("W"), F.floor((F.dayofmonth("ts") - 1) / 7 + 1).cast("int").cast("string"))
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("endpoint"),
        week.alias("test_set"),
        (F.col("user_id") % 5).cast("int").alias("fold"),
        k.alias("k"),
        "value",
    )


def class_scores(t: Tables) -> DataFrame:
    """(id, endpoint, test_set, fold, y, prob, inside): better scores inside than outside."""
    inside = F.col("k") < 70
    y = F.when(inside, (F.col("value") + F.col("k") > 80).cast("int")).otherwise((F.col("k") >= 85).cast("int"))
    return events_base(t).select(
        "id", "endpoint", "test_set", "fold", y.alias("y"), (F.col("value") / (F.col("value") + 50.0)).alias("prob"), inside.alias("inside")
    )


EVENTS_BASE = """events_base AS (
  SELECT event_id AS id, event_type AS endpoint,
         'W' || CAST(CAST(floor((day(ts) - 1) / 7.0 + 1) AS INT) AS VARCHAR) AS test_set,
         CAST(user_id % 5 AS INT) AS fold,
         CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, value
  FROM events)"""

CLASS_SCORES = """class_scores AS (
  SELECT id, endpoint, test_set, fold,
         CASE WHEN k < 70 THEN CAST(value + k > 80 AS INT) ELSE CAST(k >= 85 AS INT) END AS y,
         value / (value + 50.0::DOUBLE) AS prob, k < 70 AS inside
  FROM events_base)"""


def class_subsets(t: Tables) -> DataFrame:
    """class_scores twice: subset All and subset Inside / Outside."""
    from ..operators.domain import tag_subsets

    return tag_subsets(class_scores(t))


CLASS_SUBSETS = """class_subsets AS (
  SELECT *, 'All' AS subset FROM class_scores
  UNION ALL SELECT *, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END FROM class_scores)"""

CLASS = [EVENTS_BASE, CLASS_SCORES, CLASS_SUBSETS]

ALGORITHMS = {"Native": 50.0, "IVAP": 60.0, "CVAP": 40.0}
DOMAINS = ("Tanimoto", "dkNN", "UNC", "RDN")


def class_runs(t: Tables) -> DataFrame:
    """Scores of three algorithms with the status of four domain methods (long form)."""
    base = events_base(t)
    alg = F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.lit(c).alias("c")) for n, c in ALGORITHMS.items()])).alias("_a")
    ad = F.explode(
        F.array(
            F.struct(F.lit("Tanimoto").alias("m"), (F.col("value") < 80).alias("i")),
            F.struct(F.lit("dkNN").alias("m"), (F.col("k") < 70).alias("i")),
            F.struct(F.lit("UNC").alias("m"), (F.col("k") < 60).alias("i")),
            F.struct(F.lit("RDN").alias("m"), (F.col("k") + F.col("value") < 150).alias("i")),
        )
    ).alias("_m")
    y = F.when(F.col("k") < 70, (F.col("value") + F.col("k") > 80).cast("int")).otherwise((F.col("k") >= 85).cast("int"))
    flat = base.select("*", alg).select("*", ad)
    shift = F.when(F.col("_a.a") == "IVAP", F.col("k") * 0.5).otherwise(0.0)
    return flat.select(
        "id", "endpoint", "test_set", "fold", y.alias("y"),
        F.col("_a.a").alias("algorithm"), F.col("_m.m").alias("ad_method"), F.col("_m.i").alias("inside"),
        ((F.col("value") + shift) / (F.col("value") + shift + F.col("_a.c"))).alias("prob"),
    )


CLASS_RUNS = """class_runs AS (
  SELECT id, endpoint, test_set, fold,
         CASE WHEN k < 70 THEN CAST(value + k > 80 AS INT) ELSE CAST(k >= 85 AS INT) END AS y,
         a.algorithm, m.ad_method,
         CASE m.ad_method WHEN 'Tanimoto' THEN value < 80 WHEN 'dkNN' THEN k < 70
                          WHEN 'UNC' THEN k < 60 ELSE k + value < 150 END AS inside,
         (value + CASE WHEN a.algorithm = 'IVAP' THEN k * 0.5::DOUBLE ELSE 0.0::DOUBLE END) /
         (value + CASE WHEN a.algorithm = 'IVAP' THEN k * 0.5::DOUBLE ELSE 0.0::DOUBLE END + a.c) AS prob
  FROM events_base,
       (VALUES ('Native', 50.0::DOUBLE), ('IVAP', 60.0::DOUBLE), ('CVAP', 40.0::DOUBLE)) AS a(algorithm, c),
       (VALUES ('Tanimoto'), ('dkNN'), ('UNC'), ('RDN')) AS m(ad_method))"""

# --- regression predictions from lineitem --------------------------------------------------------


def reg_predictions(t: Tables) -> DataFrame:
    """(id, endpoint, test_set, fold, y, pred, half, inside)."""
    inside = F.col("l_discount") < 0.075
    noise = F.col("l_extendedprice") / 50000.0
    y = F.col("l_quantity") / 5.0 + F.when(inside, noise).otherwise(noise * 3.0)
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("endpoint"),
        F.col("l_linestatus").alias("test_set"),
        F.col("l_linenumber").alias("fold"),
        y.alias("y"),
        (F.col("l_quantity") / 5.0 + 1.0).alias("pred"),
        (0.25 + F.col("l_tax") * 10.0 + F.col("l_extendedprice") / 100000.0).alias("half"),
        inside.alias("inside"),
    )


REG_PREDICTIONS = """reg_predictions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         l_returnflag AS endpoint, l_linestatus AS test_set, l_linenumber AS fold,
         l_quantity / 5.0::DOUBLE + CASE WHEN l_discount < 0.075::DOUBLE THEN l_extendedprice / 50000.0::DOUBLE
                                 ELSE l_extendedprice / 50000.0::DOUBLE * 3.0::DOUBLE END AS y,
         l_quantity / 5.0::DOUBLE + 1.0::DOUBLE AS pred,
         0.25::DOUBLE + l_tax * 10.0::DOUBLE + l_extendedprice / 100000.0::DOUBLE AS half,
         l_discount < 0.075::DOUBLE AS inside
  FROM lineitem)"""

SIG_LEVELS = (0.0, 0.1, 0.2, 0.32, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def reg_subsets(t: Tables) -> DataFrame:
    from ..operators.domain import tag_subsets

    return tag_subsets(reg_predictions(t))


REG_SUBSETS = """reg_subsets AS (
  SELECT *, 'All' AS subset FROM reg_predictions
  UNION ALL SELECT *, CASE WHEN inside THEN 'Inside' ELSE 'Outside' END FROM reg_predictions)"""


def with_intervals(df: DataFrame, levels=SIG_LEVELS) -> DataFrame:
    """One row per significance level with the interval pred -/+ half * (1.5 - level)."""
    level = F.explode(F.array(*[F.lit(float(s)) for s in levels])).alias("sig_level")
    reach = F.col("half") * (F.lit(1.5) - F.col("sig_level"))
    return df.select("*", level).select(
        "*", (F.col("pred") - reach).alias("lower"), (F.col("pred") + reach).alias("upper")
    )


REG_INTERVALS = """reg_intervals AS (
  SELECT r.*, s.sig_level, r.pred - r.half * (1.5::DOUBLE - s.sig_level) AS lower,
         r.pred + r.half * (1.5::DOUBLE - s.sig_level) AS upper
  FROM reg_subsets r, (SELECT unnest([0.0, 0.1, 0.2, 0.32, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS sig_level) s)"""

REG = [REG_PREDICTIONS, REG_SUBSETS]


def event_predictions(t: Tables) -> DataFrame:
    """(id, endpoint, fold, y, pred, half, inside): a regression over the events."""
    # roots, so that no mean ends on a half of the last printed digit
    pred = F.col("value") * 0.8 + F.sqrt(F.col("k") + 1.0) * 1.5
    return events_base(t).select(
        "id", "endpoint", "fold", F.col("value").alias("y"), pred.alias("pred"), F.sqrt(F.col("k") + 4.0).alias("half"), (F.col("k") < 70).alias("inside")
    )


EVENT_PREDICTIONS = """event_predictions AS (
  SELECT id, endpoint, fold, value AS y, value * 0.8::DOUBLE + sqrt(k + 1.0::DOUBLE) * 1.5::DOUBLE AS pred, sqrt(k + 4.0::DOUBLE) AS half, k < 70 AS inside
  FROM events_base)"""
REG_ALL = [*REG, REG_INTERVALS]

# --- descriptors from embeddings -----------------------------------------------------------------


def descriptors(t: Tables) -> DataFrame:
    """(id, label, y, features) of every embedding; y = label below five."""
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        "label",
        (F.col("label") < 5).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def held_out(id_col: str = "id"):
    """About a fifth of the rows by md5 of the id: the same split in any engine."""
    return F.substring(F.md5(F.col(id_col).cast("string")), 1, 1).isin("0", "1", "2")


def train_test(df: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    return df.where(~held_out(id_col)), df.where(held_out(id_col))


DESCRIPTORS = """descriptors AS (
  SELECT vec_id AS id, label, CAST(label < 5 AS INT) AS y, embedding::DOUBLE[] AS f,
         substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS is_test
  FROM embeddings)"""

EUCLID = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def bit_rows(t: Tables) -> DataFrame:
    """(id, label, y, features): sign bits of the embeddings as one packed word."""
    from ..functions.bits import sign_words

    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        "label",
        (F.col("label") < 5).cast("int").alias("y"),
        sign_words("embedding").alias("features"),
    )


SIGN_BITS = """sign_bits AS (
  SELECT vec_id AS id, label, bitstring_agg(CASE WHEN v > 0 THEN i - 1 ELSE NULL END, 0, 63) AS b,
         substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') AS is_test
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings) AS u
  GROUP BY vec_id, label)"""

JACCARD = "CASE WHEN bit_count({a} | {b}) = 0 THEN 0.0::DOUBLE ELSE 1 - bit_count({a} & {b})::DOUBLE / bit_count({a} | {b}) END"
