"""Registered queries: projections, filters, de-duplication and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import bit_total, set_positions, text_fingerprints
from ..operators import clean as C
from .registry import query
from .testbed import CLASS, DESCRIPTORS, class_scores, class_subsets, descriptors, train_test

WIDE = """wide AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def wide_labels(t):
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return docs.join(t.labels, "doc_id", "left")


@query("b1_canonical_projection", "SELECT doc_id AS id, lang AS subset_name, n_chars AS activity, 'Train' AS subset FROM documents")
def b1(t):
    return C.canonical(t.documents, {"id": "doc_id", "subset_name": "lang", "activity": "n_chars"}, "Train")


@query(
    "b2_endpoint_rows",
    """SELECT doc_id, 'quality' AS endpoint, CAST(quality AS VARCHAR) AS label FROM wide WHERE quality IN (0, 1)
       UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM wide WHERE toxic IN (0, 1)""",
    [WIDE],
)
def b2(t):
    return C.endpoints_to_rows(wide_labels(t), ["doc_id"], ["quality", "toxic"])


@query("b3_drop_missing", "SELECT doc_id, lang, quality FROM wide WHERE quality IS NOT NULL", [WIDE])
def b3(t):
    return wide_labels(t).select("doc_id", "lang", "quality").dropna(subset=["quality"])


@query(
    "b4_encode_labels",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS y FROM lineitem",
)
def b4(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.encode_label("l_linestatus", "O", "F").alias("y")
    )


@query("b5a_row_numbers", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents")
def b5a(t):
    return C.dense_ids(t.documents.select("doc_id"), "doc_id")


@query("b5b_ids_by_key", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS id FROM customer")
def b5b(t):
    return C.dense_ids(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "b5b_ids_by_key_in_every_split",
    """SELECT 'train' AS role, l_orderkey, l_linenumber, l_partkey, k - 1 AS id FROM (
         SELECT *, dense_rank() OVER (ORDER BY l_partkey) AS k FROM lineitem) AS x WHERE l_linestatus = 'F'
       UNION ALL SELECT 'test', l_orderkey, l_linenumber, l_partkey, k - 1 FROM (
         SELECT *, dense_rank() OVER (ORDER BY l_partkey) AS k FROM lineitem) AS x WHERE l_linestatus <> 'F'""",
)
def b5c(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    role = F.when(F.col("l_linestatus") == "F", "train").otherwise("test")
    return C.dense_ids(rows, "l_partkey").select(role.alias("role"), "l_orderkey", "l_linenumber", "l_partkey", "id")


@query("b6_predicted_class", "SELECT id, fold, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred_class FROM class_scores", CLASS[:2])
def b6(t):
    from ..operators.metrics import predicted_class

    return class_scores(t).select("id", "fold", predicted_class("prob").alias("pred_class"))


RULES_SQL = """rules AS (SELECT doc_id, n_chars < 100 AS too_short, lang NOT IN ('en', 'de') AS other_language,
  coalesce(100000 / nullif(n_chars % 7, 0) < 15000, true) AS unstable FROM documents)"""


def document_rules():
    return {
        "too_short": F.col("n_chars") < 100,
        "other_language": ~F.col("lang").isin("en", "de"),
        # cannot be evaluated for multiples of seven: such rows are excluded
        "unstable": F.try_divide(F.lit(100000), F.col("n_chars") % 7) < 15000,
    }


@query("b7_rule_filter", "SELECT doc_id FROM rules WHERE NOT (too_short OR other_language OR unstable)", [RULES_SQL])
def b7(t):
    return C.split_by_rules(t.documents.select("doc_id", "n_chars", "lang"), document_rules())[0].select("doc_id")


@query(
    "b7_rule_rejects",
    """SELECT doc_id, concat_ws(',', CASE WHEN too_short THEN 'too_short' END, CASE WHEN other_language THEN 'other_language' END,
       CASE WHEN unstable THEN 'unstable' END) AS reasons FROM rules WHERE too_short OR other_language OR unstable""",
    [RULES_SQL],
)
def b7r(t):
    rejects = C.split_by_rules(t.documents.select("doc_id", "n_chars", "lang"), document_rules())[1]
    return rejects.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def page_numbers(t):
    return t.pages.select("page_id", F.expr("try_cast(regexp_extract(url, 'page=([0-9]+)', 1) AS INT)").alias("number"))


@query("b8_parsed_rows", "SELECT page_id, try_cast(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) AS number FROM pages WHERE try_cast(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) IS NOT NULL")
def b8(t):
    return C.split_unparsed(page_numbers(t), "number")[0]


@query("b8_unparsed_rows", "SELECT page_id FROM pages WHERE try_cast(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) IS NULL")
def b8r(t):
    return C.split_unparsed(page_numbers(t), "number")[1]


@query(
    "b9_dedup_classes",
    """SELECT l_orderkey, l_linestatus, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn,
                min(l_linestatus) OVER (PARTITION BY l_orderkey) AS lo, max(l_linestatus) OVER (PARTITION BY l_orderkey) AS hi
         FROM lineitem) AS x WHERE rn = 1 AND lo = hi""",
)
def b9(t):
    rows = t.lineitem.select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey")
    return C.dedup_classes(rows, "l_orderkey", "l_linestatus", ["l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "b9_dedup_texts",
    """SELECT key, quality, doc_id FROM (
         SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn, min(quality) OVER (PARTITION BY key) AS lo,
                max(quality) OVER (PARTITION BY key) AS hi
         FROM (SELECT md5(regexp_replace(lower(trim(d.text)), '[[:space:]]+', ' ', 'g')) AS key, l.quality, d.doc_id
               FROM documents d JOIN labels l ON l.doc_id = d.doc_id) AS k) AS x WHERE rn = 1 AND lo = hi""",
)
def b9t(t):
    key = F.md5(F.regexp_replace(F.lower(F.trim("text")), r"[ \t\n\x0B\f\r]+", " "))
    rows = t.documents.select(key.alias("key"), "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")
    return C.dedup_classes(rows.select("key", "quality", "doc_id"), "key", "quality", ["doc_id"])


def outlier_ctes(source: str, rounds: int) -> list[str]:
    """SQL twin of the repeated leave-one-out test, unrolled."""
    ctes = [f"o0 AS ({source})"]
    for i in range(rounds):
        ctes.append(
            f"""o{i + 1} AS MATERIALIZED (
  SELECT key, id, v FROM (
    SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, var_pop(v) OVER w AS s, min(v) OVER w AS lo, max(v) OVER w AS hi
    FROM o{i} WINDOW w AS (PARTITION BY key)) AS x
  WHERE n < 3 OR lo = hi OR NOT abs(v - m) * n / (n - 1) >
        3 * sqrt(greatest(s * n - (v - m) * (v - m) * n / (n - 1), 0) / (n - 1)))"""
        )
    return ctes


@query(
    "b10_dedup_values",
    """SELECT a.key, a.activity, f.id FROM (SELECT key, avg(v) AS activity, stddev_pop(v) AS sd FROM o12 GROUP BY key) a
       JOIN (SELECT key, min(id) AS id FROM o0 GROUP BY key) f ON f.key = a.key WHERE a.sd <= 40""",
    outlier_ctes("SELECT user_id AS key, event_id AS id, value AS v FROM events", 12),
    "activity",
    digits=8,
)
def b10(t):
    rows = t.events.select(F.col("user_id").alias("key"), F.col("value").alias("activity"), F.col("event_id").alias("id"))
    return C.dedup_values(rows, "key", "activity", ["id"], max_deviation=40.0)


@query(
    "b10_outlier_free_values",
    "SELECT key, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM o12 GROUP BY key",
    outlier_ctes("SELECT user_id AS key, event_id AS id, value AS v FROM events", 12),
    "mean sd",
    digits=8,
)
def b10k(t):
    rows = t.events.select(F.col("user_id").alias("key"), F.col("value").alias("v"))
    return C.without_outliers(rows, ["key"], "v").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")
    )


@query(
    "b11_only_unique",
    "SELECT l_orderkey, any_value(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1",
    None,
    "l_extendedprice",
)
def b11(t):
    return C.only_unique(t.lineitem.select("l_orderkey", "l_extendedprice"), "l_orderkey")


@query("b12_duplicates", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def b12(t):
    return C.duplicates(t.lineitem, "l_orderkey")


@query("b13_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def b13(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "b13_first_per_id",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) AS x WHERE rn = 1""",
    None,
    "o_totalprice",
)
def b13f(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return C.first_per_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "b14_integrity",
    """SELECT (SELECT count(*) FROM wide WHERE lang = 'en') AS train_rows, (SELECT count(DISTINCT source) FROM wide WHERE lang = 'en') AS train_ids,
              (SELECT sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT FROM wide WHERE lang = 'en') AS train_missing,
              (SELECT count(*) FROM wide WHERE lang <> 'en') AS test_rows, (SELECT count(DISTINCT source) FROM wide WHERE lang <> 'en') AS test_ids,
              (SELECT sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT FROM wide WHERE lang <> 'en') AS test_missing,
              (SELECT count(*) FROM (SELECT DISTINCT source FROM wide WHERE lang = 'en' INTERSECT SELECT DISTINCT source FROM wide WHERE lang <> 'en') AS x) AS shared_ids""",
    [WIDE],
)
def b14(t):
    rows = wide_labels(t)
    return C.integrity(rows.where("lang = 'en'"), rows.where("lang <> 'en'"), "source", ["quality", "toxic"])


@query(
    "b14_integrity_asserted",
    """SELECT count_if(NOT is_test) AS train_rows, count(DISTINCT id) FILTER (NOT is_test) AS train_ids, count_if(label IS NULL AND NOT is_test) AS train_missing,
              count_if(is_test) AS test_rows, count(DISTINCT id) FILTER (is_test) AS test_ids, count_if(label IS NULL AND is_test) AS test_missing,
              (SELECT count(*) FROM (SELECT id FROM descriptors GROUP BY id HAVING count(DISTINCT is_test) > 1) AS s) AS shared_ids FROM descriptors""",
    [DESCRIPTORS],
)
def b14a(t):
    train, test = train_test(descriptors(t))
    return C.assert_integrity(C.integrity(train, test, "id", ["label"]))


@query(
    "b16_minimum_sizes",
    """SELECT endpoint, test_set, fold, subset, count(*) AS n, count_if(y = 1) AS n1, count_if(y = 0) AS n0,
              count_if(y = 1) >= 25 AND count_if(y = 0) >= 25 AS usable FROM class_subsets GROUP BY ALL""",
    CLASS,
)
def b16(t):
    return C.big_enough(class_subsets(t), ["endpoint", "test_set", "fold", "subset"], "y")


TOKENS = """positions AS (
  SELECT doc_id, ('0x' || substr(md5(tok), 1, 4))::INT % 1024 AS p
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS tok FROM documents) AS x WHERE length(tok) > 0)"""


@query("b17_text_fingerprints", "SELECT doc_id, count(DISTINCT p) AS bits, sum(DISTINCT p)::BIGINT AS checksum FROM positions GROUP BY 1", [TOKENS])
def b17(t):
    packed = text_fingerprints(t.documents, "doc_id", "text")
    checksum = F.aggregate(set_positions("words"), F.lit(0).cast("bigint"), lambda s, i: s + i)
    return packed.select("doc_id", bit_total("words").cast("bigint").alias("bits"), checksum.alias("checksum"))


@query(
    "b18_min_max_scaling",
    """SELECT d.id, d.is_test AS test, list_sum(list_transform(list_zip(d.f, m.lo, m.hi), lambda z: (z[1] - z[2]) / (z[3] - z[2]))) AS total,
              (d.f[1] - m.lo[1]) / (m.hi[1] - m.lo[1]) AS first_value
       FROM descriptors d, (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM (
         SELECT i, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(f) AS v, unnest(range(1, 65)) AS i FROM descriptors WHERE NOT is_test) AS u GROUP BY i) AS g) m""",
    [DESCRIPTORS],
    "total first_value",
)
def b18(t):
    train, test = train_test(descriptors(t))
    a, b = C.min_max_scale(train, test, "features", 64)
    both = a.withColumn("test", F.lit(False)).unionByName(b.withColumn("test", F.lit(True)))
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v)
    return both.select("id", "test", total.alias("total"), F.col("features")[0].alias("first_value"))


@query(
    "b20_swapped_columns",
    "SELECT endpoint AS test_set, test_set AS endpoint, count(*) AS n FROM class_scores GROUP BY ALL",
    CLASS[:2],
)
def b20(t):
    counts = class_scores(t).groupBy("endpoint", "test_set").agg(F.count(F.lit(1)).alias("n"))
    return C.swap(counts, "endpoint", "test_set")


@query("b21_missing_fold", "SELECT doc_id, coalesce(quality, 0) AS fold FROM wide", [WIDE])
def b21(t):
    return C.fill_fold(wide_labels(t).select("doc_id", F.col("quality").alias("fold")))
