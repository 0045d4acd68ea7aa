"""Quality rules as a short-circuit cascade.

Every rule is a column expression that is true for a document to be rejected. The cost (seconds for
the sample) and the selectivity (share rejected) of each rule are measured on a sample; the cascade
asks the rules by rejected share per second, and a document that one rule rejects is not shown to
the next (``CASE WHEN`` stops at the first hit). The order changes the time, never the verdict.

All work is done by DataFrame functions on the rows where they lie: there is no shuffle.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, occurrences, words_of, written

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns of ``statistics``."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    share: float

    @property
    def worth(self) -> float:
        return self.share / max(self.seconds, 1e-3)


def _repeated_words(words: Column, size: int) -> Column:
    """Words inside windows of ``size`` words that stand twice or more in the array.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    n = F.size(words)

    def window(hashes: Column, start: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, start + k) for k in range(size)])

    grams = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: window(hashes, i)),
    )

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        # neighbours of the sorted list that are equal are repeated windows
        return let(placed, lambda p: let(repeated_starts(p), span))

    def repeated_starts(p: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(a.getField("g") == b.getField("g"), F.lit(False))

        hits = F.filter(
            p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))
        )
        return F.sort_array(F.transform(hits, lambda x: x.getField("i")))

    def span(starts: Column) -> Column:
        steps = F.zip_with(
            starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size))
        )
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    several = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))
    return F.when(n > size, several).otherwise(0).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics of every document: counts of words, characters, lines and repeats.

    NULL and empty texts have no words and all counts 0. Rows are kept as they come: repeated rows
    and NULL ids give a row each. Other input columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", lines)
    return base.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        occurrences(F.col("text"), "[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), WINDOW).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Too short, or made of repeats."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    text, words, n = F.col("text"), F.col("words"), F.col("n_words")
    neighbours = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    spelled = F.filter(words, lambda w: w.rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("capitals", 10 * occurrences(text, "[A-Z]") > 3 * F.col("word_chars")),
        Rule("exclamations", 5 * occurrences(text, "[!]") > n),
        Rule("stuttering", 5 * F.size(F.filter(neighbours, lambda same: same)) > n),
        Rule("without_letters", 10 * F.size(spelled) < 7 * n),
    ]


def measure(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of ``statistics``."""

    def run(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double"))).first()[0]
        return time.perf_counter() - start, share or 0.0

    nothing = min(run(F.lit(False))[0] for _ in range(2))
    found = []
    for rule in rules:
        seconds, share = run(rule.rejects)
        found.append(Measured(rule, seconds - nothing, share))
    return found


def cascade(measured: list[Measured]) -> Column:
    """True for documents that no rule rejects; rules in the order of their worth."""
    kept = F.when(base_failed(), False)
    for m in sorted(measured, key=lambda m: (-m.worth, m.rule.name)):
        kept = kept.when(m.rule.rejects, False)
    return kept.otherwise(True)


def quality_rules(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    sample_rows: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Statistics and verdict of every document: doc_id, counts, base_failed, kept.

    ``sample_rows`` is the expected size of the sample that decides the order of the rules. An empty
    table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    # base columns are part of what the cascade is given, so only the rules' own work is timed
    sample = written(statistics(narrow.sample(share, seed=7)).where(~base_failed()), "rule-sample")
    kept = cascade(measure(sample, rules))
    return statistics(narrow).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        kept.alias("kept"),
    )


#: The same in DuckDB: words by position, windows as lists, verdict as one condition.
SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
w AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
g AS (SELECT r, i, list_slice(words, i, i + 7) AS gram FROM w),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
steps AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM twice),
rep AS (SELECT r, sum(n) AS n FROM steps GROUP BY r),
s AS (
    SELECT doc_id, text, words, len(words)::BIGINT AS n_words,
           length(array_to_string(words, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           len(lines)::BIGINT AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (r)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * word_chars
            OR 5 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
            OR 5 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > n_words
            OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 7 * n_words) AS kept
FROM b
"""


def op1_quality_rules(spark, folder: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))
