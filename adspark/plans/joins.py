"""Registered queries: joins, overlaps and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered
from ..operators import domain as D
from ..operators.metrics import observed_probability
from ..operators.neighbours import Space, distance_counts, lay_out
from ..operators.overlap import overlap_matrix, pairwise_overlap
from .domain import BIT_PAIRS, BITS, DIST_COUNTS
from .registry import query
from .testbed import CLASS, DESCRIPTORS, EUCLID, SIGN_BITS, bit_rows, class_scores, descriptors, train_test


@query("d1_texts_with_labels", "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def d1(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query(
    "d5_rows_in_id_set",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')",
)
def d5(t):
    chosen = t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(chosen, "l_partkey", "left_semi")


@query("d7_pair_distances_within", "SELECT dist, pairs FROM dist_counts WHERE sides = 'train-train'", [SIGN_BITS, BIT_PAIRS, DIST_COUNTS], "dist")
def d7(t):
    """All pairs inside one data set, as counts per distance."""
    return distance_counts(lay_out(train_test(bit_rows(t))[0], BITS), None)


@query("d8_pair_distances_across", "SELECT dist, pairs FROM dist_counts WHERE sides = 'train-test'", [SIGN_BITS, BIT_PAIRS, DIST_COUNTS], "dist")
def d8(t):
    """All training x test pairs, as counts per distance."""
    train, test = train_test(bit_rows(t))
    layout = lay_out(train, BITS)
    return distance_counts(layout, lay_out(test, BITS, layout.pivots))


@query(
    "d7_dense_distance_histogram",
    f"""SELECT floor(least({EUCLID.format(a='a.f', b='b.f')} / 4.0::DOUBLE * 64, 63)) * (4.0::DOUBLE / 64) AS dist, count(*) AS pairs
        FROM descriptors a JOIN descriptors b ON a.id < b.id GROUP BY 1""",
    [DESCRIPTORS],
    "dist",
)
def d7h(t):
    return distance_counts(lay_out(descriptors(t), Space()), None, bins=64, upper=4.0)


@query(
    "d9_band_self_join",
    """SELECT a.endpoint, 0.05::DOUBLE AS delta, a.prob, a.c AS rows, sum(b.ones)::DOUBLE / sum(b.c) AS observed
       FROM (SELECT endpoint, prob, count(*) AS c FROM class_scores GROUP BY 1, 2) a
       JOIN (SELECT endpoint, prob, count(*) AS c, sum(y) AS ones FROM class_scores GROUP BY 1, 2) b
         ON b.endpoint = a.endpoint AND abs(b.prob - a.prob) < 0.05::DOUBLE GROUP BY 1, 2, 3, 4""",
    CLASS[:2],
    "delta prob observed",
)
def d9(t):
    return observed_probability(class_scores(t).withColumn("delta", F.lit(0.05)), ["endpoint"])


MANHATTAN = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


@query(
    "d10_nearest_within_label",
    f"""SELECT label, id, rn AS rank, d AS dist FROM (
          SELECT a.label, a.id, row_number() OVER (PARTITION BY a.id ORDER BY {MANHATTAN.format(a='a.f', b='b.f')}) AS rn, {MANHATTAN.format(a='a.f', b='b.f')} AS d
          FROM descriptors a JOIN descriptors b ON a.label = b.label AND a.is_test AND NOT b.is_test) AS x WHERE rn <= 5""",
    [DESCRIPTORS],
    "dist",
)
def d10(t):
    """Five nearest training rows of the same label, Manhattan distance: groups are keys, not loops."""
    train, test = train_test(descriptors(t))
    near = D.nearest_distances(train, test, Space(metric="manhattan", by=("label",), pivots=4), 5)
    return near.select("label", "id", F.posexplode("dists").alias("rank", "dist")).withColumn(
        "rank", (F.col("rank") + 1).cast("bigint")
    )


SETS = """sets AS (SELECT DISTINCT l_returnflag || '-' || l_linestatus AS ds, l_orderkey AS key FROM lineitem)"""


def endpoint_keys(t):
    return t.lineitem.select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("ds"), F.col("l_orderkey").alias("key"))


@query("d11_pairwise_overlap", "SELECT a.ds AS a, b.ds AS b, count(*) AS overlap FROM sets a JOIN sets b ON a.key = b.key GROUP BY 1, 2", [SETS])
def d11(t):
    return pairwise_overlap(endpoint_keys(t), "ds", "key")


NAMES = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]
FRACTIONS = ", ".join(f"coalesce(max(f) FILTER (b = '{n}'), 0) AS \"{n}\"" for n in NAMES)


@query(
    "i17_overlap_matrix",
    f"""SELECT a, {', '.join(f'round("{n}", 6) + 0.0 AS "{n}"' for n in NAMES)} FROM (SELECT a, {FRACTIONS} FROM (
          SELECT a.ds AS a, b.ds AS b, count(*)::DOUBLE / (SELECT count(*) FROM sets s WHERE s.ds = a.ds) AS f
          FROM sets a JOIN sets b ON a.key = b.key GROUP BY a.ds, b.ds) AS p GROUP BY a) AS q""",
    [SETS],
)
def i17(t):
    return overlap_matrix(pairwise_overlap(endpoint_keys(t), "ds", "key", fraction=True), NAMES)


@query(
    "d12_exists_within_threshold",
    """SELECT p.id, bool_or(l.t >= p.d) AS inside FROM bit_pairs p JOIN lim l ON l.id = p.other WHERE p.is_test GROUP BY p.id""",
    [
        SIGN_BITS,
        BIT_PAIRS,
        "near AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM bit_pairs WHERE NOT is_test)",
        """refv AS (SELECT q3 + 1.5::DOUBLE * (q3 - q1) AS r FROM (SELECT quantile_cont(m, 0.25::DOUBLE) AS q1, quantile_cont(m, 0.75::DOUBLE) AS q3
           FROM (SELECT id, avg(d) AS m FROM near WHERE rn <= 3 GROUP BY id) AS k) AS q)""",
        """raw AS (SELECT i.id, coalesce(avg(p.d), 0) AS t FROM (SELECT DISTINCT id FROM bit_pairs WHERE NOT is_test) i CROSS JOIN refv
           LEFT JOIN bit_pairs p ON p.id = i.id AND p.d <= refv.r GROUP BY i.id)""",
        "lim AS (SELECT id, CASE WHEN t = 0 THEN coalesce((SELECT min(t) FROM raw WHERE t > 0), 0) ELSE t END AS t FROM raw)",
    ],
)
def d12(t):
    train, test = train_test(bit_rows(t))
    return D.dknn_status(train, test, BITS, [3]).select("id", "inside")


@query(
    "d13_results_by_id",
    """SELECT c.id, c.y, c.prob, e.user_id FROM class_scores c JOIN events e ON e.event_id = c.id WHERE c.inside""",
    CLASS[:2],
    "prob",
)
def d13(t):
    inside = class_scores(t).where("inside").select("id", "y", "prob")
    return inside.join(t.events.select(F.col("event_id").alias("id"), "user_id"), "id")


@query("l_union_all", "SELECT l_orderkey AS key, 'F' AS part FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, 'O' FROM lineitem WHERE l_linestatus = 'O'")
def l_union(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("part"))
    return rows.where("part = 'F'").unionByName(rows.where("part = 'O'"))


@query("l_intersection", "SELECT l_orderkey AS key FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def l_intersection(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_linestatus")
    return rows.where("l_linestatus = 'F'").select("key").intersect(rows.where("l_linestatus = 'O'").select("key"))


@query("l_difference", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def l_difference(t):
    used = t.lineitem.select(F.col("l_orderkey").alias("key"))
    return t.orders.select(F.col("o_orderkey").alias("key")).distinct().join(used, "key", "left_anti")


@query(
    "k_top_per_group",
    "SELECT endpoint, id, value FROM (SELECT event_type AS endpoint, event_id AS id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) AS x WHERE rn <= 10",
    None,
    "value",
)
def k_top(t):
    """Largest values per group: rank limits are applied before the shuffle."""
    from pyspark.sql import Window as W

    order = W.partitionBy("endpoint").orderBy(F.col("value").desc(), "id")
    rows = t.events.select(F.col("event_type").alias("endpoint"), F.col("event_id").alias("id"), "value")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 10").drop("rn")


@query(
    "j_average_ranks",
    """SELECT endpoint, value, rank() OVER (PARTITION BY endpoint ORDER BY value) + (count(*) OVER (PARTITION BY endpoint, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY endpoint, value) AS c
       FROM (SELECT event_type AS endpoint, value FROM events) AS e QUALIFY row_number() OVER (PARTITION BY endpoint, value) = 1""",
    None,
    "value rk",
)
def j_ranks(t):
    rows = t.events.select(F.col("event_type").alias("endpoint"), "value")
    out = ordered.average_ranks(rows, ["endpoint"], "value", "centred")
    return out.select("endpoint", "value", (F.col("centred") + (F.col("_n") + 1) / 2).alias("rk"), "c")
