"""Audit of sources: how far the term distributions of a language's sources lie apart.

Documents become counts of terms by language and source, added up in the tasks before anything is
shuffled. For each language the counts form a matrix of sources and terms, nearly empty at scale. It
is cut into blocks of terms (and of sources, where there are many), and a block is a quadtree: each
node covers half the rows and half the columns of the one above, and a node whose cells are all zero
has no children. Two sources' rows are traversed together from the root. Where both nodes are empty,
all their columns have one price, the divergence of the two smoothed zero counts, and only the
columns are counted; where one is not, the traversal goes down to single cells. Terms that no source
of a block holds never reach a task; they have the same price.

All arithmetic is on whole numbers: decimals for the smoothed probabilities, 64-bit for the rest.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: What a probability of one is worth, and the count that every term has beforehand.
SCALE, PRIOR = 1_000_000_000, 2
#: Terms and sources in a block, terms traversed at once.
TERMS, SOURCES, STRIP = 4096, 128, 64
#: Entries that a task's counters hold before they are sent on, and bytes of a text cut into terms at once.
HELD, CHUNK = 400_000, 1 << 20

#: Letters A-Z in lower case, all other ASCII but letters as a blank; bytes of other characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded part of it at a time."""
    data = text.encode().translate(_TERM_BYTES)
    start = 0
    while start < len(data):
        stop = len(data) if start + chunk >= len(data) else data.find(b" ", start + chunk)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole part of (p - q)^2 / (p + q)."""
    return (p - q) * (p - q) // (p + q)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR terms)), exact for any 64-bit counts."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(PRIOR))
    below = total.cast("decimal(20,0)") + F.lit(PRIOR) * terms.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", above, below)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, documents): occurrences of each term and documents that hold it.

    Every task adds up what it reads; its counters are sent on when they hold ``HELD`` entries.
    """

    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        held: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                documents = held[lang, source]
                terms = list(found)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    arrays = [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([found[t] for t in some], pa.int64()),
                        pa.array([documents[t] for t in some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "documents"])
            counts.clear()
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own, seen = counts[lang, source], set()
                before = len(own)
                for terms in terms_of(text):
                    own.update(terms)
                    seen.update(terms)
                held[lang, source].update(seen)
                size += len(own) - before
                if size >= most:
                    yield from out()
                    size = 0
        yield from out()

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*names).mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _levels(filled: np.ndarray) -> list[np.ndarray]:
    """Quadtree of a square matrix of a power of two, from the root to the cells: which nodes are not empty."""
    levels = [filled]
    while levels[0].shape[0] > 1:
        n = levels[0].shape[0] // 2
        levels.insert(0, levels[0].reshape(n, 2, n, 2).any(axis=(1, 3)))
    return levels


def traverse(p: np.ndarray, zero: np.ndarray, filled: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divergence of pairs of rows over the columns of a strip: (sum over visited cells, columns priced as empty).

    ``p`` are the probabilities of the cells (``zero`` of the row where the count is zero), ``filled``
    tells where counts are not zero, ``pairs`` the pairs of rows that are asked for.
    """
    rows, columns = p.shape
    side = 1 << max(rows - 1, columns - 1, 0).bit_length()
    square = np.zeros((side, side), dtype=bool)
    square[:rows, :columns] = filled
    levels = _levels(square)
    wanted = np.zeros((side, side), dtype=bool)
    wanted[:rows, :rows] = pairs
    asked = _levels(wanted)
    total, empty = np.zeros((rows, rows), dtype=np.int64), np.zeros((rows, rows), dtype=np.int64)
    a = b = c = np.zeros(1, dtype=np.int64)
    if not pairs.any():
        return total, empty
    for depth, level in enumerate(levels):
        width = side >> depth
        some = level[a, c] | level[b, c]
        # both quadrants are empty: all columns that they have of the strip get the price of two zeros
        x, y, z = a[~some], b[~some], c[~some]
        if len(x):
            whole = np.zeros(level.shape, dtype=np.int64)
            np.add.at(whole, (x, y), np.minimum(columns, (z + 1) * width) - z * width)
            empty += np.repeat(np.repeat(whole, width, axis=0), width, axis=1)[:rows, :rows]
        a, b, c = a[some], b[some], c[some]
        if width == 1:
            np.add.at(total, (a, b), divergence(p[a, c], p[b, c]))
            break
        # the eight children of a pair of nodes with the same columns
        a, b, c = (np.concatenate([2 * v + (i >> shift & 1) for i in range(8)]) for v, shift in ((a, 0), (b, 1), (c, 2)))
        below = asked[depth + 1][a, b] & (a * (width // 2) < rows) & (b * (width // 2) < rows) & (c * (width // 2) < columns)
        a, b, c = a[below], b[below], c[below]
    return np.where(pairs, total, 0), np.where(pairs, empty, 0)


def block_divergence(cells: pd.DataFrame, members: pd.DataFrame, sources: int = SOURCES, strip: int = STRIP) -> pd.DataFrame:
    """(lang, a, b, value, columns) of all pairs a < b between two blocks of sources over one block of terms.

    ``cells`` has (g, term, p) of the counts that are not zero, ``members`` (g, zero) of all sources of the
    two blocks; ``columns`` is the number of terms whose cells were visited: what is left of a language's
    terms has the price of two zeros.
    """
    members = members.sort_values("g")
    g, zero = members["g"].to_numpy(), members["zero"].to_numpy()
    block = g // sources
    pairs = (g[:, None] < g[None, :]) & (block[:, None] == block[0]) & (block[None, :] == block[-1])
    row = np.searchsorted(g, cells["g"].to_numpy())
    terms, column = np.unique(cells["term"].to_numpy().astype(str), return_inverse=True)
    total, empty = np.zeros(pairs.shape, dtype=np.int64), np.zeros(pairs.shape, dtype=np.int64)
    order = np.argsort(column, kind="stable")
    row, column, p = row[order], column[order], cells["p"].to_numpy()[order]
    for at in range(0, len(terms), strip):
        s, e = np.searchsorted(column, [at, at + strip])
        shape = len(g), min(strip, len(terms) - at)
        values, filled = np.repeat(zero[:, None], shape[1], axis=1), np.zeros(shape, dtype=bool)
        values[row[s:e], column[s:e] - at] = p[s:e]
        filled[row[s:e], column[s:e] - at] = True
        more, none = traverse(values, zero, filled, pairs)
        total += more
        empty += none
    a, b = np.nonzero(pairs)
    return pd.DataFrame({"a": g[a], "b": g[b], "value": total[a, b], "columns": len(terms) - empty[a, b]})


def source_divergence(
    docs: DataFrame,
    min_docs: int = 10,
    top_terms: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank): sources compared with each other and with their language.

    Terms are runs of letters A-Z, in lower case, and of characters outside ASCII. A language keeps
    those in at least ``min_docs`` of its documents (rows; repeated rows count each). A source's
    probability of a kept term is ``probability`` of its count, and the divergence of two sources is the
    sum of ``divergence`` over all kept terms. Part ``pair`` lists each other source of the language,
    part ``term`` the ``top_terms`` kept terms that stand out most in the source against its language;
    both are ranked by falling value, then by item. NULL language, source and text are the empty
    string; a source without terms has zero counts; a language without kept terms has pairs of value
    0. Without documents there are no rows. Other input columns are left out.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    counts = written(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("in_lang"))
    kept = written(by_lang.where(F.col("documents") >= min_docs).select("lang", "term", "in_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    cells = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # rows of a group: one for each source and language, however many documents they have
    groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"))
    zero = F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms")))
    groups = written(groups.withColumn("zero", zero), "source-groups")

    priced = cells.join(groups, ["lang", "source"]).withColumns(
        {
            "p": probability(F.col("n"), F.col("total"), F.col("terms")),
            "q": probability(F.col("in_lang"), F.col("lang_total"), F.col("terms")),
        }
    )
    priced = written(priced.select("lang", "source", "g", "terms", "term", "p", "q"), "term-cells")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    standing_out = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    standing_out = standing_out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    standing_out = standing_out.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    pairs = _pairs(priced, groups)
    both = [pairs.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value") for x, y in (("x", "y"), ("y", "x"))]
    ranked = both[0].unionByName(both[1]).withColumn("rank", F.row_number().over(order))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(standing_out)


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, x, y, value) of every two sources of a language, once."""
    spark = priced.sparkSession
    # pairs of blocks of sources, first <= second, that a source takes part in
    blocks = F.ceil(F.col("sources") / SOURCES).cast("bigint")
    own = F.expr(f"g div {SOURCES}")
    partners = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda b: F.named_struct(F.lit("first"), F.least(b, own), F.lit("second"), F.greatest(b, own)))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    strips = F.ceil(F.col("terms") / TERMS).cast("bigint")
    keys = ["lang", "strip", "first", "second"]
    cells = priced.join(sizes, "lang").select("lang", "g", "term", "p", F.pmod(F.xxhash64("term"), strips).alias("strip"), F.explode(partners).alias("e"))
    cells = cells.select("lang", "strip", "e.first", "e.second", "g", "term", "p")
    members = groups.where("terms > 0").join(sizes, "lang")
    members = members.select("lang", "g", "zero", F.explode(F.sequence(F.lit(0).cast("bigint"), strips - 1)).alias("strip"), partners.alias("partners"))
    members = members.select("lang", "strip", "g", "zero", F.explode("partners").alias("e"))
    members = members.select("lang", "strip", "e.first", "e.second", "g", "zero")

    sides = SOURCES, STRIP

    def compare(key: tuple, cells: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = block_divergence(cells, members, *sides) if len(cells) else pd.DataFrame({c: [] for c in ("a", "b", "value", "columns")}, dtype="int64")
        return found.assign(lang=key[0])

    schema = "lang string, a long, b long, value long, columns long"
    found = cells.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, schema)
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"))
    left = groups.select("lang", F.col("g").alias("a"), F.col("source").alias("x"), F.col("zero").alias("p"), "terms")
    right = groups.select(F.col("lang").alias("lang_y"), F.col("g").alias("b"), F.col("source").alias("y"), F.col("zero").alias("q"))
    pairs = left.join(right, (left["lang"] == right["lang_y"]) & (left["a"] < right["b"])).drop("lang_y")
    priced_pairs = pairs.join(found, ["lang", "a", "b"], "left")
    rest = F.col("terms") - F.coalesce("columns", F.lit(0))
    return priced_pairs.select("lang", "x", "y", F.coalesce(F.coalesce("value", F.lit(0)) + rest * F.expr("(p - q) * (p - q) div (p + q)"), F.lit(0)).alias("value"))


#: The same in DuckDB, term by term and pair by pair.
SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
m AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * v.v) AS p,
           1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
f AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM m WHERE n > 0 AND p > q),
r AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_source_divergence(spark, folder: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{folder}/documents.parquet"))
