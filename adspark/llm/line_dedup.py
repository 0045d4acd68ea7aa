"""Lines that many documents share, kept in one of them only.

Every long line becomes a row of two 64-bit hashes of its key, its document and its position. Rows
are dealt out by ranges of the first hash and sorted within a range by hash, document and position;
one pass over the sorted rows finds, for each key, how many documents hold it and which one keeps it.
What comes out are not texts but the positions that go, packed into a sparse bitmap for each document
that loses lines; ``apply_bitmaps`` cuts the texts by them.

A key that would fill a good part of a range is counted before: by document first and then by key,
with partial sums. Its rows, already decided, are dealt out by document. Such keys are looked for in
a sample, which decides where rows go and never what becomes of them.

DataFrame functions only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parts, written

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one task sorts, and documents in the sample for keys that need splitting.
ROWS_PER_PART, SAMPLE_DOCS = 1_000_000, 5000
#: A key with this many rows in the sample, and this part of a range, is counted before.
SEEN, PART_OF_RANGE = 10, 4


def lines_of(text: Column) -> Column:
    """Lines of a text; NULL and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() changes A-Z alone where there is nothing but ASCII, and is much cheaper there
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("tag", F.xxhash64("text"))


def _rows(tagged: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tag, pos, h1, h2) of every line whose key has ``min_chars`` characters or more."""
    lines = tagged.select("doc", "tag", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot_keys(tagged: DataFrame, min_chars: int) -> tuple[DataFrame, int, int]:
    """Keys that need splitting, their number, and the number of partitions for all rows.

    The sample grows with the documents, so a key that fills a part of one of many ranges is seen too;
    there are at most ``PART_OF_RANGE`` such keys for each range.
    """
    spark = tagged.sparkSession
    documents = tagged.count()
    share = min(1.0, max(SAMPLE_DOCS, documents // 20_000) / max(1, documents))
    sample = written(_rows(tagged.sample(share, seed=11), min_chars).select("h1", "h2"), "line-sample")
    seen = sample.count()
    partitions = parts(math.ceil(seen / share), spark.sparkContext.defaultParallelism, ROWS_PER_PART)
    least = max(SEEN, seen / (PART_OF_RANGE * max(partitions, 256)))
    hot = written(sample.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1", "h2"), "hot-lines")
    return hot, hot.count(), partitions


def _keeper(doc: str, keep: str) -> Column:
    return {"largest": F.max, "smallest": F.min}[keep](doc)


def _dropped(docs: DataFrame, min_docs: int, min_chars: int, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, pos) of the lines that go."""
    tagged = _tagged(docs, id_col, text_col)
    rows = _rows(tagged, min_chars)
    hot, several, partitions = _hot_keys(tagged, min_chars)
    bits = max(12, math.ceil(math.log2(16 * partitions)))
    # the first bits of the hash name its range
    rows = rows.withColumn("part", F.shiftright("h1", 64 - bits))
    if several:
        # by document first, so that no task gets all rows of a key; a bounded number of keys is left
        held = rows.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
        decided = held.groupBy("h1", "h2").agg(F.count("*").alias("documents"), _keeper("doc", keep).alias("keeper"))
        rows = rows.join(F.broadcast(written(decided, "hot-line-keepers")), ["h1", "h2"], "left")
        goes = (F.col("documents") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("keeper"))
        rows = rows.where(F.col("documents").isNull() | goes).withColumns(
            {"sure": F.col("documents").isNotNull(), "part": F.when(F.col("documents").isNull(), F.col("part")).otherwise(F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << bits)))}
        )
    else:
        rows = rows.withColumn("sure", F.lit(False))
    rows = rows.select("part", "h1", "h2", "doc", "tag", "pos", "sure").repartition(partitions, "part")
    order = Window.partitionBy("part", "h1", "h2").orderBy("doc", "tag", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = (F.row_number().over(order) == 1) | ~F.lag("doc").over(order).eqNullSafe(F.col("doc"))
    marked = rows.withColumn("first", F.when(first, 1).otherwise(0))
    counted = marked.withColumns({"n": F.sum("first").over(whole), "kept_in": _keeper("doc", keep).over(whole)})
    goes = (F.col("n") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("kept_in"))
    return counted.where(F.col("sure") | goes).select("doc", "tag", "pos")


def drop_bitmaps(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Sparse bitmaps of the lines that documents lose: (doc, tag, words).

    ``words`` lists (word, bits): bit ``i`` of word ``w`` stands for line 64 w + i and is set if the
    line goes; words without a set bit are left out, and so are documents that keep all lines. ``tag``
    is a checksum of the text, which tells apart rows with one id.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys of ``min_chars``
    characters or more in at least ``min_docs`` documents keep their lines in the document with the
    ``keep`` ("largest" or "smallest") id only. Rows with one id count as one document, and so do
    all rows with a NULL id, which keep no shared line; repeated rows have equal bitmaps. NULL and
    empty texts have one empty line. Other input columns are left out.
    """
    gone = _dropped(docs, min_docs, min_chars, keep, id_col, text_col)
    packed = gone.repartition("doc", "tag").groupBy("doc", "tag", F.expr("pos div 64").alias("word"))
    packed = packed.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return packed.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of every row of ``docs``: the text without the lines of its bitmap."""
    tagged = _tagged(docs, id_col, text_col)
    marks = bitmaps.select(F.col("doc").alias("d"), F.col("tag").alias("t"), "words")
    # texts and bitmaps meet by sorting at any size: a corpus has too many bitmaps to send to every task
    joined = tagged.join(marks.hint("merge"), tagged["doc"].eqNullSafe(marks["d"]) & (tagged["tag"] == marks["t"]), "left")
    # every word has its place, so a line finds its bit at once
    last = F.element_at("words", -1)["word"]
    entries = F.map_from_entries("words")
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda w: F.coalesce(F.element_at(entries, w), F.lit(0).cast("bigint")))
    cut = joined.select("doc", lines_of(F.col("text")).alias("lines"), F.when(F.col("words").isNotNull(), dense).alias("bitmap"), "words")

    def stays(line: Column, i: Column) -> Column:
        bits = F.coalesce(F.get("bitmap", F.floor(i / 64).cast("int")), F.lit(0).cast("bigint"))
        return F.getbit(bits, i % 64) == 0

    kept = F.when(F.col("bitmap").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    dropped = F.coalesce(F.aggregate("words", F.lit(0), lambda n, x: n + F.bit_count(x["bits"])), F.lit(0))
    return cut.select(
        F.col("doc").alias("doc_id"),
        F.array_join(kept, "\n").alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of every row: its text without the lines that ``drop_bitmaps`` names."""
    bitmaps = written(drop_bitmaps(docs, min_docs, min_chars, keep, id_col, text_col), "line-bitmaps")
    return apply_bitmaps(docs, bitmaps, id_col, text_col)


#: The same in DuckDB, by counting documents for each key.
SQL = r"""
WITH l AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
),
k AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op11_line_dedup(spark, folder: str) -> DataFrame:
    found = drop_shared_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
