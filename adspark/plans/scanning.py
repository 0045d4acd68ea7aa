"""Registered queries: scans and sinks. Files are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..functions.bits import text_fingerprints, unpack_bits
from ..sources import files as S
from ..sources.shared import shared_folder
from .registry import query
from .testbed import CLASS, class_scores


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


@query("a1_csv_scan", CUSTOMER_SQL, None, "c_acctbal")
def a1(t):
    path = folder(t, "csv")
    S.write_delimited(t.customer.select(*CUSTOMER.names), path)
    return S.read_delimited(t.spark, path, CUSTOMER)


@query("a2_tsv_scan", CUSTOMER_SQL, None, "c_acctbal")
def a2(t):
    path = folder(t, "tsv")
    S.write_delimited(t.customer.select(*CUSTOMER.names), path, sep="\t")
    return S.read_delimited(t.spark, path, CUSTOMER, sep="\t")


@query(
    "a3_split_table",
    "SELECT o_orderkey AS row_id, o_orderpriority AS fold, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'train' ELSE 'test' END AS role, o_totalprice FROM orders",
    None,
    "o_totalprice",
)
def a3(t):
    role = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    split = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("fold"), role.alias("role"))
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return S.apply_split_table(rows, split).select("row_id", "fold", "role", "o_totalprice")


@query("a4_bundle", "SELECT id, y, prob, test_set FROM class_scores WHERE endpoint = 'click'", CLASS[:2], "prob")
def a4(t):
    """Model-ready bundle partitioned by endpoint and test set; one endpoint is read back."""
    path = folder(t, "bundle")
    S.write_partitioned(class_scores(t).select("id", "y", "prob", "endpoint", "test_set"), path, ["endpoint", "test_set"])
    schema = "id bigint, y int, prob double, endpoint string, test_set string"
    return S.read_bundle(t.spark, path, schema, endpoint="click").select("id", "y", "prob", "test_set")


@query(
    "a5_metadata_from_paths",
    "SELECT id, endpoint, test_set, fold FROM class_scores",
    CLASS[:2],
)
def a5(t):
    """Many files; endpoint, test set and fold come from the file path only."""
    path = folder(t, "many")
    rows = class_scores(t).select("id", "endpoint", "test_set", "fold")
    S.write_partitioned(rows, path, ["endpoint", "test_set", "fold"], fmt="csv")
    fields = {"endpoint": r"endpoint=([^/]+)/", "test_set": r"test_set=([^/]+)/", "fold": r"fold=(\d+)/"}
    out = S.read_with_path_fields(t.spark, path, "id bigint", fields)
    return out.withColumn("fold", F.col("fold").cast("int"))


@query("a6_file_per_subset", "SELECT endpoint, test_set, count(*) AS n, sum(id)::BIGINT AS checksum FROM class_scores GROUP BY 1, 2", CLASS[:2])
def a6(t):
    """One folder per subset, counted from what was written."""
    path = folder(t, "subsets")
    S.write_partitioned(class_scores(t).select("id", "endpoint", "test_set"), path, ["endpoint", "test_set"], fmt="csv")
    written = t.spark.read.schema("id bigint, endpoint string, test_set string").option("header", True).csv(path)
    return written.groupBy("endpoint", "test_set").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("checksum"))


@query(
    "a7_statistics_sink",
    "SELECT endpoint, test_set, avg((prob - y) * (prob - y)) AS brier, count(*) AS n FROM class_scores GROUP BY 1, 2",
    CLASS[:2],
    "brier",
)
def a7(t):
    path = folder(t, "statistics")
    loss = (F.col("prob") - F.col("y")) * (F.col("prob") - F.col("y"))
    stats = class_scores(t).groupBy("endpoint", "test_set").agg(F.avg(loss).alias("brier"), F.count(F.lit(1)).alias("n"))
    stats.write.mode("overwrite").parquet(path)
    return t.spark.read.schema(stats.schema).parquet(path)


@query(
    "a8_bit_columns",
    """SELECT doc_id, p AS position FROM (SELECT DISTINCT doc_id, ('0x' || substr(md5(tok), 1, 4))::INT % 1024 AS p
       FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS tok FROM documents) AS x WHERE length(tok) > 0) AS y""",
)
def a8(t):
    """Packed fingerprints expanded to (row, set position)."""
    packed = text_fingerprints(t.documents, "doc_id", "text")
    bits = packed.select("doc_id", F.posexplode(unpack_bits("words")).alias("position", "bit"))
    return bits.where("bit = 1").select("doc_id", "position")
