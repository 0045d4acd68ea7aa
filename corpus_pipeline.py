"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's result
as Parquet and reads it again for the next one, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adspark.llm import decontaminate, packing, repeats, rule_ensemble, similar
from adspark.llm.common import written


NEAR_WORDS, NEAR_SHARE = 5, 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score of one half or more); labels are read from ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    scored = rule_ensemble.quality_scores(whole, labels, carry=["row"])
    # a condition on the row's number cannot move below the score, where the planner would work out the score twice
    return scored.withColumn("at", F.monotonically_increasing_id()).where("predicted = 1 AND at >= 0").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near copies.

    Texts link when 0.8 or more of their 5-word shingles are shared (Jaccard). SimHash finds the nearest
    ones and the large groups; copies with a few changed words lie 6 to 11 bits apart, beyond what
    an index of byte positions reaches, so a prefix filter finds the rest. All links are verified.
    """
    return similar.keep_one_of_similar(docs, least=NEAR_SHARE, shingle=NEAR_WORDS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that also start earlier.

    Only whole characters go, so texts stay texts; ``n_chars`` follows the text. A document that
    repeats others all through stays with an empty text, and a NULL text becomes empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    whole = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))
    cut = repeats.remove_repeats(whole, characters=True, carry=["row"])
    text = F.col("kept").cast("string")
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` was found."""
    leaks = decontaminate.decontaminate(docs, decontaminate.benchmark_items(spark, sf_dir))
    found = written(leaks.select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["leaked"]), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a packed sequence."""
    return packing.pack(written(packing.token_pieces(docs, packing.default_tokenizer()), "pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained rules, links and repeated passages are not for SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
