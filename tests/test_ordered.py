"""Buckets of the order statistics: as many as rows can fill, and totals that no task or driver holds as a whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adspark.functions import ordered


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 0.0, float("inf"), rng.gauss(0, 1), rng.random()]), rng.choice([None, 1, 2])) for g, n in ((None, 700), (1, 90), (2, 1)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g int, v double, w int")


def test_small_groups_have_few_buckets(numbers):
    _, df = numbers
    assert ordered.value_buckets(df, ["g"], "v").select("_bucket").distinct().collect() == [(0,)]


@pytest.mark.parametrize("rows_of_a_bucket", [1, 7, 60])
def test_running_totals_in_any_buckets(numbers, monkeypatch, rows_of_a_bucket):
    rows, df = numbers
    monkeypatch.setattr(ordered, "BUCKET_ROWS", rows_of_a_bucket)
    if rows_of_a_bucket > 1:
        most = {r.g: r.n for r in ordered.value_buckets(df, ["g"], "v").groupBy("g").agg(F.count_distinct("_bucket").alias("n")).collect()}
        assert all(most[g] <= sum(r[0] == g and r[1] is not None for r in rows) // rows_of_a_bucket + 1 for g in most)
    merged = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.sum("w").alias("w"))
    got = {(r.g, r.v): (r.run, r.whole) for r in ordered.running_totals(merged, ["g"], ["v"], {"run": "w"}, totals={"whole": "w"}).collect()}

    def total(g, last):
        found = [w for k, v, w in rows if k == g and v is not None and v <= last and w is not None]
        return sum(found) if found else None

    assert got == {(g, v): (total(g, v), total(g, float("inf"))) for g, v, _ in rows if v is not None}


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_totals_are_not_joined(numbers):
    """Many groups have many buckets: a broadcast of their totals filled the driver."""
    _, df = numbers
    placed = df.where("v IS NOT NULL").withColumn("b", F.lit(0))
    out = ordered.running_totals(placed, ["g"], ["v"], {"run": "w"}, bucket=F.col("b"), totals={"whole": "w"})
    assert "Join" not in joins_of(out)


@pytest.mark.parametrize("rows_of_a_bucket", [7, 2_000])
def test_rows_are_placed_and_ranked_without_copies(numbers, monkeypatch, rows_of_a_bucket):
    """Positions and rank correlations with values that fill buckets by themselves; only borders are written."""
    import hashlib

    import numpy as np

    rows, df = numbers
    written = []
    real = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda d, name: written.append(name) or real(d, name))
    monkeypatch.setattr(ordered, "BUCKET_ROWS", rows_of_a_bucket)
    rng = random.Random(4)
    rows = [(g, i, v, rng.choice([None, 3.0, rng.random() + (v if v and v < 9 else 0)])) for i, (g, v, _) in enumerate(rows)]
    df = df.sparkSession.createDataFrame(rows, "g int, id int, v double, u double")
    got = ordered.row_positions(df, ["g"], "v", "id", "at").collect()
    for g in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (r[2], hashlib.md5(str(r[1]).encode()).hexdigest()))
        assert {(r.id, r.at, r.at_n) for r in got if r.g == g} == {(r[1], k + 1, len(own)) for k, r in enumerate(own)}

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]) - (len(x) + 1) / 2

    rho = {r.g: r.rho for r in ordered.spearman(df, ["g"], "v", "u", "rho").collect()}
    for g in (None, 1):
        a, b = (ranks(np.array([r[k] for r in rows if r[0] == g and None not in r[2:]])) for k in (2, 3))
        assert rho[g] == pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), rel=1e-9)
    whole = ordered.spearman(df, [], "v", "u", "rho").collect()
    a, b = (ranks(np.array([r[k] for r in rows if None not in r[2:]])) for k in (2, 3))
    assert [r.rho for r in whole] == [pytest.approx((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()), rel=1e-9)]
    assert written == ["borders"] * 3
