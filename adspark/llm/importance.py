"""Resampling of documents towards a target distribution by importance weights.

Words and pairs of words are hashed to buckets. Every task counts the buckets of what it reads in one
array; the log ratios of target and corpus make an array of gains, with which every task scores whole
documents by array lookups. A draw without replacement by those weights takes the documents of
highest weight plus Gumbel noise, which a hash of the id makes repeatable.

The cutoff of the draw is found without sorting the corpus: a quantile sketch gives a bracket around
it, the rows above and inside are counted exactly, and a bracket that misses the cutoff is widened.
Only the rows inside are sorted. The documents drawn then get their rank from one range sort.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import parts, written

BUCKETS = 10_000
#: Bytes of a text that are cut into words at once, and rows of a part of the sorted draw.
CHUNK, ROWS_PER_PART = 1 << 20, 1_000_000
#: Share of the rows on either side of the cutoff in the first bracket, and what a miss multiplies it by.
MARGIN, WIDER = 0.005, 8
#: Accuracy of the quantile sketch: a rank is off by one part in so many.
ACCURACY = 2000

#: Letters A-Z in lower case, other ASCII but letters and digits as a blank; bytes of other characters stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def feature_buckets(text: str | None, buckets: int = BUCKETS, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """Words and buckets of all features of a text, a bounded part of it at a time.

    Features are words, and neighbouring words with a space between. A pair's checksum goes on from
    that of its first word.
    """
    data = (text or "").encode().translate(_WORD_BYTES)
    crc, start, last = zlib.crc32, 0, None
    while start < len(data):
        stop = len(data) if start + chunk >= len(data) else data.find(b" ", start + chunk)
        stop = len(data) if stop < 0 else stop
        words = data[start:stop].split()
        start = stop
        if not words:
            continue
        one = list(map(crc, words))
        before = one[:-1] if last is None else [last, *one[:-1]]
        second = words[1:] if last is None else words
        two = list(map(crc, [b" " + w for w in second], before))
        last = one[-1]
        yield len(words), np.array(one + two, dtype=np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts of (text) fall into each bucket; one array of counts per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target and source) of each bucket."""
    n = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64
    )


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = features = total = 0
                for n, found in feature_buckets(text.as_py(), len(own)):
                    words, features, total = words + n, features + len(found), total + int(own[found].sum())
                rows.append((words, features, total // features if features else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([narrow.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return narrow.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times) a Gumbel number that the id and the seed decide; a NULL id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("bigint")


def _order() -> list[Column]:
    """The order of the draw: falling scores, ties by rising id, NULL ids last."""
    return [F.desc("score"), F.asc_nulls_last("doc_id")]


def cutoff(scored: DataFrame, k: int, n: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> tuple[int, int, int, int]:
    """(low, high, above, inside): rows of ``scored`` over ``high`` and from ``low`` to ``high``, with above < k <= above + inside.

    The bracket comes from a sketch of the scores' quantiles and is widened until the exact counts
    hold the k-th highest of the ``n`` scores.
    """
    while True:
        share = 1 - k / n
        wanted = [max(0.0, share - margin), min(1.0, share + margin)]
        low, high = scored.agg(F.percentile_approx("score", wanted, accuracy).alias("q")).first()["q"]
        if wanted[0] == 0.0 and wanted[1] == 1.0:
            low, high = scored.agg(F.min("score"), F.max("score")).first()
        above, inside = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above, inside
        margin *= WIDER


def _numbered(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``place`` 1, 2, 3, ... in the order of the draw, from one range sort.

    The sorted parts are written; a row's place is its place in its part after the rows of the parts before.
    """
    spark = rows.sparkSession
    n = parts(count, spark.sparkContext.defaultParallelism, ROWS_PER_PART)
    dealt = rows.repartitionByRange(n, *_order()).sortWithinPartitions(*_order())
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted-draw")
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()  # one row a part
    start, before = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        start.append((r["part"], before))
        before += r["rows"]
    starts = F.broadcast(spark.createDataFrame(start, "part long, before long"))
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(starts, "part").withColumn("place", F.col("before") + within + 1).drop("at", "part", "before")


def draw(scored: DataFrame, k: int, n: int) -> DataFrame:
    """(row, place) of the ``k`` rows of (row, doc_id, score) that come first in the order of the draw; ``n`` rows are there."""
    low, high, above, inside = cutoff(scored, k, n)
    bracket = _numbered(scored.where(F.col("score").between(low, high)), inside).where(F.col("place") <= k - above)
    above_it = _numbered(scored.where(F.col("score") > high), above) if above else None
    drawn = bracket.select("row", (F.col("place") + above).alias("place"))
    return drawn if above_it is None else above_it.select("row", "place").unionByName(drawn)


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, the rank NULL if it is not drawn.

    ``target`` has (text). Of the N documents of ``min_words`` words or more, floor(percent N / 100) with
    the highest scores are drawn, ties to the smaller id. NULL and empty texts have no features and
    weight 0, and are not drawn unless ``min_words`` is 0. Repeated rows are documents of their own, with
    equal scores and different ranks; a NULL id counts as empty text in the noise and as the largest id
    in ties. Without target texts the gains are those of an even target. Other input columns are left out.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gains = gains_of(bucket_counts(own.select("text"), buckets), bucket_counts(target.select("text"), buckets))
    scored = weights(own, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # numbered so that repeated rows stay apart; the table is written, so the numbers hold
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.where(F.col("n_words") >= min_words)
    n = eligible.count()
    k = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    drawn = written(draw(eligible.select("row", "doc_id", "score"), k, n), "drawn")
    return scored.join(drawn, "row", "left").select(*out, F.col("place").alias("rank"))


def op13_importance_resampling(spark, folder: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return importance_resample(docs, benchmark.select("text"))
