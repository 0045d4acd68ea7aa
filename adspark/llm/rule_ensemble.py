"""Quality classifier: a sparse ensemble of conjunctive rules.

Statistics of each text are column expressions. A small forest is grown on a bounded sample of
labelled rows; every path from the root to a node is a rule, a conjunction of bounds on statistics.
Lasso logistic regression on the rules' truth values keeps few of them with a weight each. The
kept rules are compiled to one column expression, so scoring a corpus is a single pass of built-in
functions without Python and without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .common import occurrences, words_of, written

#: Inputs of the score, all taken from the text.
FEATURES = [
    "words", "mean_word", "symbols", "capitals", "exclamations", "digits", "stops", "distinct", "stuttering", "repeated_lines",
]


@dataclass(frozen=True)
class Rule:
    """A conjunction: lower < feature <= upper for each (feature, lower, upper); infinite bounds are left out."""

    bounds: tuple[tuple[str, float, float], ...]

    def condition(self) -> Column:
        out = F.lit(True)
        for name, lower, upper in self.bounds:
            if lower > -math.inf:
                out = out & (F.col(name) > lower)
            if upper < math.inf:
                out = out & (F.col(name) <= upper)
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights:
            total = total + F.when(rule.condition(), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, FEATURES...[, carried columns]) of every whole text; NULL and empty texts have zeros."""
    text, carry = F.col("text"), carry or []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    base = base.withColumns({"w": words_of(text), "chars": F.length("text").cast("double")})
    base = base.withColumn("lines", F.split("text", "\n"))
    base = base.withColumns(
        {
            "n": F.size("w").cast("double"),
            "letters": F.length(F.array_join("w", "")).cast("double"),
            "same": F.aggregate(
                F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))),
                F.lit(0),
                lambda total, x: total + x.cast("int"),
            ),
        }
    )

    def rate(value: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(value.cast("double"), of), F.lit(0.0))

    n, letters = F.col("n"), F.col("letters")
    return base.select(
        "doc_id",
        n.alias("words"),
        rate(letters, n).alias("mean_word"),
        rate(occurrences(text, "[#*$%&|<>]"), n).alias("symbols"),
        rate(occurrences(text, "[A-Z]"), letters).alias("capitals"),
        rate(occurrences(text, "[!?]"), n).alias("exclamations"),
        rate(occurrences(text, "[0-9]"), letters).alias("digits"),
        rate(occurrences(text, "[.,;:]"), n).alias("stops"),
        rate(F.size(F.array_distinct("w")), n).alias("distinct"),
        rate(F.col("same"), n).alias("stuttering"),
        rate(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines").cast("double")).alias("repeated_lines"),
        *carry,
    )


def rules_of(tree: str) -> list[Rule]:
    """Rules of a decision tree, one for each node below the root, from its printed form."""
    rules, path = [], []
    for line in tree.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.0-9Ee]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, FEATURES[int(found[3])], found[4], float(found[5])))
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, value in path:
            lower, upper = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (lower, min(upper, value)) if sign == "<=" else (max(lower, value), upper)
        rules.append(Rule(tuple((name, *b) for name, b in sorted(bounds.items()))))
    return rules


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 17) -> Ensemble:
    """Ensemble from (FEATURES..., label 0 or 1); with one label only, the smoothed share of label 1."""
    rows, ones = labelled.agg(F.count("*"), F.sum("label")).first()
    ones = ones or 0
    if not 0 < ones < rows:
        share = (ones + 1) / (rows + 2)
        return Ensemble(math.log(share / (1 - share)), ())
    features = array_to_vector(F.array(*FEATURES)).alias("features")
    table = labelled.select(F.col("label").cast("double"), features, *FEATURES).repartition(2)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed).fit(table)
    rules = list(dict.fromkeys(rule for tree in forest.trees for rule in rules_of(tree.toDebugString)))
    if not rules:
        return Ensemble(math.log(ones / (rows - ones)), ())
    truth = written(table.select("label", F.array(*[r.condition().cast("double") for r in rules]).alias("truth")), "rule-values")
    truth = truth.select("label", array_to_vector("truth").alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(truth)
    kept = [(rule, float(w)) for rule, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-9]
    return Ensemble(float(model.intercept), tuple(kept))


def held_out(id_column: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_table(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and label of at most ``train_rows`` labelled rows that are not held out, chosen by hash of the id."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.where(~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    # at most train_rows pairs of numbers: small enough for every task
    chosen = F.broadcast(written(chosen, "training-labels"))
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    return written(statistics(marked, carry=["label"]), "training")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted[, carried columns]) of every document.

    ``labels`` has the id and ``quality`` 0 or 1; labels of held-out rows are never read for fitting,
    and at most ``train_rows`` others are, chosen by hash of the id. NULL and empty texts are scored
    by their zeros; without labels every score is one half. Repeated rows give a row each, with equal
    scores; a NULL id is not held out. ``carry`` names columns to hand through (no features may have
    their names; a struct holds any); the others are left out.
    """
    ensemble = fit(training_table(docs, labels, train_rows, id_col, text_col))
    scored = statistics(docs, id_col, text_col, carry).withColumns({"held_out": held_out(), "score": ensemble.score()})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(carry or []))


def op4_quality_classifier(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    return quality_scores(docs, labels)
