"""Venn-ABERS calibration of binary scores (IVAP and CVAP) and combination of probabilities.

For a position between the sorted distinct calibration scores, p0 and p1 are the isotonic fit of
the calibration labels with one more point labelled 0 or 1 placed there. In the cumulative-sum
diagram that fit is the slope of the lower bridge between the points to the left and the shifted
points to the right of the position. Only vertices of lower hulls can carry a bridge, so a fold is
cut into score ranges: each range is reduced to its hull, and each range's positions are then
solved against the hulls of the ranges before and after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.joining import join_on
from ..functions.ordered import running_totals
from ..sources.shared import materialise


MAX_RANGES = 256


def _pop_above(stack: list, point) -> list:
    """Remove the stack points that leave the lower hull once ``point`` is added."""
    popped = []
    while len(stack) >= 2:
        (ax, ay), (bx, by) = stack[-2], stack[-1]
        turn = (bx - ax) * (point[1] - ay) - (by - ay) * (point[0] - ax)
        # coming from the left a hull turns left, coming from the right it turns right
        if (turn > 0) == (point[0] > bx) and turn != 0:
            break
        popped.append(stack.pop())
    return popped


def lower_hull(points: list) -> list:
    """Vertices of the lower convex hull of points with ascending x (exact integers)."""
    stack: list = []
    for point in points:
        _pop_above(stack, point)
        stack.append(point)
    return stack


def bridge_slope(left: np.ndarray, right: np.ndarray, shift: tuple) -> float:
    """Slope of the common lower tangent of two hulls, the right one moved by ``shift``."""
    lx, ly = left[:, 0], left[:, 1]
    rx, ry = right[:, 0] + shift[0], right[:, 1] + shift[1]
    a = len(left) - 1
    for _ in range(len(left) + len(right)):
        slopes = (ry - ly[a]) / (rx - lx[a])
        b = int(np.argmin(slopes))
        back = (ry[b] - ly) / (rx[b] - lx)
        if back.max() <= back[a]:
            break
        a = int(np.argmax(back))
    return float(slopes[b])


def solve_positions(points: list, wanted: set) -> dict:
    """{index: (p0, p1)} for the wanted indices of points with ascending x.

    The hull of the points from an index on is unwound step by step while the hull up to the
    index grows, so all positions take one pass.
    """
    right: list = []
    undo = []
    for point in reversed(points):
        undo.append(_pop_above(right, point))
        right.append(point)
    left: list = []
    out = {}
    for i, point in enumerate(points):
        _pop_above(left, point)
        left.append(point)
        if i in wanted:
            lo, hi = np.asarray(left, dtype=float), np.asarray(right, dtype=float)
            out[i] = (bridge_slope(lo, hi, (1.0, 0.0)), bridge_slope(lo, hi, (1.0, 1.0)))
        right.pop()
        right.extend(reversed(undo.pop()))
    return out


def _cumulative(calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct calibration scores with their 1-based position, cumulative n and label sum."""
    points = calibration.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("c"), F.sum("y").cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("_one")
    )
    return running_totals(
        points,
        keys,
        ["score"],
        {"n_cum": "c", "s_cum": "s", "pos": "_one"},
        totals={"groups": "_one"},
    )


def venn_abers_table(calibration: DataFrame, keys: list[str], range_rows: int = 4096) -> DataFrame:
    """p0 and p1 for every position 0..k: (keys, pos, p0, p1) of a calibration table.

    ``calibration`` holds the keys (at least one), ``score`` in [0, 1] and ``y``. Position ``pos`` has exactly
    ``pos`` distinct calibration scores before it.
    """
    cum = materialise(_cumulative(calibration, keys), "calibration")
    origin = cum.groupBy(*keys).agg(F.max("groups").alias("groups")).select(
        *keys, F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n_cum"), F.lit(0).cast("bigint").alias("s_cum"), "groups"
    )
    points = cum.select(*keys, "pos", "n_cum", "s_cum", "groups").unionByName(origin)
    # a bounded number of ranges per calibration set
    size = F.greatest(F.lit(range_rows), F.ceil((F.col("groups") + 1) / MAX_RANGES))
    points = points.withColumn("_range", F.floor(F.col("pos") / size).cast("bigint"))

    known = {f.name: f.dataType for f in points.schema.fields}
    key_fields = [T.StructField(k, known[k]) for k in keys]
    hull_schema = T.StructType(
        [*key_fields, T.StructField("_range", T.LongType()), T.StructField("pos", T.LongType()),
         T.StructField("n_cum", T.LongType()), T.StructField("s_cum", T.LongType())]
    )

    def reduce_range(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        kept = {x for x, _ in lower_hull(list(zip(pdf["n_cum"].tolist(), pdf["s_cum"].tolist())))}
        return pdf[pdf["n_cum"].isin(kept)][hull_schema.fieldNames()]

    hulls = points.groupBy(*keys, "_range").applyInPandas(reduce_range, hull_schema)
    ranges = points.select(*keys, "_range").distinct().withColumnRenamed("_range", "_target")
    # hull vertices of all other ranges travel to each range; own points go in full
    others = join_on(hulls, ranges, keys)
    others = others.where(F.col("_range") != F.col("_target")).select(
        *keys, F.col("_target").alias("_range"), "pos", "n_cum", "s_cum", F.lit(False).alias("own")
    )
    own = points.select(*keys, "_range", "pos", "n_cum", "s_cum", F.lit(True).alias("own"))
    out_schema = T.StructType(
        [*key_fields, T.StructField("pos", T.LongType()), T.StructField("p0", T.DoubleType()), T.StructField("p1", T.DoubleType())]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        mine = np.flatnonzero(pdf["own"].to_numpy())
        found = solve_positions(list(zip(pdf["n_cum"].tolist(), pdf["s_cum"].tolist())), set(mine.tolist()))
        out = pdf.iloc[mine][[*keys, "pos"]].copy()
        out["p0"], out["p1"] = zip(*[found[i] for i in mine.tolist()])
        return out[out_schema.fieldNames()]

    return own.unionByName(others).groupBy(*keys, "_range").applyInPandas(solve, out_schema)


def step_positions(calibration: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows with the number of distinct calibration scores below and at or below their score.

    ``test`` holds the keys, ``id`` and ``score``. An as-of lookup by running totals over both
    tables: no range join.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    steps = calibration.select(*keys, "score").distinct().withColumn("_one", one).withColumn("kind", F.lit(1))
    asked = test.select(*keys, "score").distinct().withColumn("_one", zero)
    # before the equal step (kind 0) and after it (kind 2)
    line = (
        steps.unionByName(asked.withColumn("kind", F.lit(0)))
        .unionByName(asked.withColumn("kind", F.lit(2)))
    )
    total = running_totals(line, keys, ["score", "kind"], {"_cum": "_one"}, totals={"groups": "_one"})
    found = (
        total.where("kind <> 1")
        .groupBy(*keys, "score")
        .agg(
            F.max(F.when(F.col("kind") == 0, F.col("_cum"))).alias("below"),
            F.max(F.when(F.col("kind") == 2, F.col("_cum"))).alias("upto"),
            F.max("groups").alias("groups"),
        )
    )
    return join_on(test, found, [*keys, "score"])


def venn_abers(calibration: DataFrame, test: DataFrame, keys: list[str], range_rows: int = 4096) -> DataFrame:
    """Multi-probability (p0, p1) of every test row: (keys, id, score, p0, p1).

    A score equal to a calibration score gets its 0 before and its 1 after that group; for scores
    at or above the largest calibration score the 1 still goes before the last group, and p0 is 0
    for scores at or below the smallest.
    """
    table = materialise(venn_abers_table(calibration, keys, range_rows), "venn-abers")
    placed = step_positions(calibration, test, keys)
    placed = placed.withColumn("_pos1", F.least(F.col("upto"), F.col("groups") - 1))
    p1 = table.select(*keys, F.col("pos").alias("_pos1"), "p1")
    p0 = table.select(*keys, F.col("pos").alias("below"), F.when(F.col("pos") == 0, 0.0).otherwise(F.col("p0")).alias("p0"))
    joined = join_on(join_on(placed, p0, [*keys, "below"]), p1, [*keys, "_pos1"])
    return joined.select(*test.columns, "p0", "p1")


def single_probability(p0="p0", p1="p1") -> Column:
    """p1 / (1 - p0 + p1)."""
    p0 = F.col(p0) if isinstance(p0, str) else p0
    p1 = F.col(p1) if isinstance(p1, str) else p1
    return p1 / (1 - p0 + p1)


def ivap(calibration: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Inductive Venn-ABERS: (keys, id, score, p0, p1, prob, ordered); ordered = p0 < prob < p1."""
    out = venn_abers(calibration, test, keys).withColumn("prob", single_probability())
    return out.withColumn("ordered", (F.col("p0") < F.col("prob")) & (F.col("prob") < F.col("p1")))


def geometric_mean(value) -> Column:
    """Aggregate: exp of the mean logarithm; 0 as soon as one value is 0."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(value) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(value > 0, value)))))


def cvap(per_fold: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Cross Venn-ABERS from the (p0, p1) of all folds of a test row."""
    merged = per_fold.groupBy(*keys, id_col).agg(
        (1 - geometric_mean(1 - F.col("p0"))).alias("p0"), geometric_mean("p1").alias("p1")
    )
    return merged.withColumn("prob", single_probability())


def class_and_confidence(probs) -> Column:
    """Struct (class, confidence) of the most probable class of a map class -> probability."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    entries = F.map_entries(probs)
    # the smallest class wins a tie
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), (-e["key"]).alias("k"))))
    return F.struct((-best["k"]).alias("class"), best["v"].alias("confidence"))
