"""Statistics of many redraws against a version that makes every redraw row by row."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.functions.hashing import order_key
from adspark.functions.joining import join_on
from adspark.operators import redraws as R, shift as H
from adspark.sources.shared import materialise

N, SEED = 23, 5


def key_of(id_, group, draw):
    h = hashlib.md5("|".join(str(x) for x in (id_, group, SEED) if x is not None).encode()).hexdigest()
    p = R.PRIME
    a, b, c = int(h[:8], 16) % (p - 1) + 1, int(h[8:16], 16) % p, int(h[16:24], 16) % p
    u = (a * (2 * draw + 1) + b) % p
    w = (((u * u + c) % p) * u + a) % p
    return w * 2**31 + (w * w + b) % p


def sides(rows, draw):
    """Rows (id, stratum, inside, ...) of one group parted by a redraw."""
    group = rows[0]["g"]
    inside = []
    for s in {r["stratum"] for r in rows}:
        own = sorted((r for r in rows if r["stratum"] == s), key=lambda r: key_of(r["id"], group, draw))
        inside += own[: sum(r["inside"] for r in own)]
    chosen = {r["id"] for r in inside}
    return inside, [r for r in rows if r["id"] not in chosen]


def ranks(values):
    order, out = sorted(values), {}
    for v in set(values):
        first = order.index(v)
        out[v] = first + (order.count(v) + 1) / 2
    return np.array([out[v] for v in values])


def brute_auc(rows):
    p, q = ([r["prob"] for r in rows if r["y"] == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else None


def brute_spearman(rows):
    x, y = ranks([r["prob"] for r in rows]), ranks([r["e"] for r in rows])
    x, y = x - x.mean(), y - y.mean()
    return float((x * y).sum() / math.sqrt((x * x).sum()) / math.sqrt((y * y).sum())) if (x * x).sum() and (y * y).sum() else None


def brute_ence(rows, bin_rows):
    rows = sorted(rows, key=lambda r: (r["v"], r["tie"]))
    bins = max(len(rows) // bin_rows, 1)
    parts = np.array_split(np.arange(len(rows)), bins)  # the first parts hold one row more
    terms = []
    for part in parts:
        e, v = (math.sqrt(np.mean([f(rows[i]) for i in part])) for f in (lambda r: r["e"] ** 2, lambda r: r["v"]))
        if v > 0 or e > 0:
            terms.append(abs(e - v) / v if v else math.inf)
    return float(np.mean(terms)) if terms else None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for g, n in (("a", 300), ("b", 40), (None, 90)):
        for i in range(n):
            y = rng.random() < 0.4
            prob = 0.5 if i % 3 == 0 else round(rng.random() * 0.6 + 0.3 * y, 2)
            out.append({"g": g, "id": f"{g}-{i}", "stratum": int(y), "inside": rng.random() < 0.6, "y": int(y), "prob": prob, "e": round(rng.gauss(0, 1), 1), "v": rng.choice([0.0, 1.0, 1.0, 1.0, 2.25, rng.random()]), "tie": rng.random()})
    return out


@pytest.fixture(scope="module", params=[20_000, 17])
def drawn(request, spark, rows):
    """The same redraws with one task for a group, and with many ranges and tasks."""
    before = R.TASK_ROWS
    R.TASK_ROWS = request.param
    values = {c: F.col(c) for c in ("y", "prob", "e", "v", "tie")}
    lay = R.layout(spark.createDataFrame(rows), ["g"], values, SEED)
    yield R.draw(lay, ["g"], N, list(values), ["y", "prob"])
    R.TASK_ROWS = before


def expected(rows, value):
    out = {}
    for g in ("a", "b", None):
        own = [r for r in rows if r["g"] == g]
        for d in range(N):
            for subset, side in zip(("Inside", "Outside"), sides(own, d)):
                out[g, d, subset] = value(side)
    return out


def compare(frame, want):
    got = {(r["g"], r["perm"], r["subset"]): r["value"] for r in frame.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, rel=1e-9)), k


def test_sums(drawn, rows):
    want = expected(rows, lambda side: side)
    got = drawn.sums.collect()
    assert len(got) == 3 * N
    for r in got:
        for s, subset in (("in", "Inside"), ("out", "Outside")):
            side = want[r["g"], r["perm"], subset]
            assert r[f"{s}_n"] == len(side)
            for c in ("y", "prob", "e", "v"):
                assert r[f"{s}_{c}"] == pytest.approx(sum(x[c] for x in side), abs=1e-9)
            assert (r[f"{s}_prob_low"], r[f"{s}_prob_high"]) == (min(x["prob"] for x in side), max(x["prob"] for x in side))


def test_auc(drawn, rows):
    compare(R.auc_per_redraw(drawn, ["g"]), expected(rows, brute_auc))


def test_spearman(drawn, rows):
    compare(R.spearman_per_redraw(drawn, ["g"], "prob", "e"), expected(rows, brute_spearman))


def test_ranks_of_both_sides_are_made_once_and_lists_are_not_written(drawn, monkeypatch):
    written = []
    monkeypatch.setattr(R, "materialise", lambda df, name: written.append((name, df.columns)) or materialise(df, name))
    for found in (R.spearman_per_redraw(drawn, ["g"], "prob", "e"), R.auc_per_redraw(drawn, ["g"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Python" not in plan and "Pandas" not in plan
    assert "rank-sums" in dict(written) and not any("_other" in columns for _, columns in written)


def test_ence(drawn, rows):
    compare(R.ence_per_redraw(drawn, ["g"], "v", "e", "tie", 7), expected(rows, lambda side: brute_ence(side, 7)))


def test_bands_that_miss_are_widened(spark, rows, monkeypatch):
    values = {"y": F.col("y"), "prob": F.col("prob")}
    lay = R.layout(spark.createDataFrame(rows), ["g"], values, SEED)
    monkeypatch.setattr(R, "BAND", (0.05, 0.0))
    got = R.draw(lay, ["g"], N, list(values), ["y", "prob"]).sums.collect()
    want = expected(rows, lambda side: sum(r["prob"] for r in side))
    assert all(r["in_prob"] == pytest.approx(want[r["g"], r["perm"], "Inside"]) for r in got) and len(got) == 3 * N


def test_redraws_without_variety_are_made_again(spark):
    rows = [{"id": i, "stratum": 0, "inside": i < 2, "y": float(i % 7 == 0), "prob": float(i)} for i in range(30)]
    values = {"y": F.col("y"), "prob": F.col("prob")}
    lay = R.layout(spark.createDataFrame(rows), [], values, SEED)
    got = R.draw(lay, [], 40, list(values), ["y", "prob"])
    sums = got.sums.collect()
    assert sorted(r["perm"] for r in sums) == list(range(40))
    # two rows Inside, nearly always found one of each value after at most ten tries
    assert sum(r["in_y"] == 1 for r in sums) >= 36
    numbers = got.ends.first()["_draws"]
    assert any(d >= 40 for d in numbers) and [d % 40 for d in numbers] == list(range(40))


def test_keys_agree_with_sql():
    import duckdb

    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(1, R.PRIME, 50) for _ in range(3))
    first = R.first_key(a[:, None], b[:, None], c[:, None], np.arange(9)[None, :] * 999)
    key = (first << 31) + R.second_key(first, b[:, None])
    for i in range(50):
        for j in range(9):
            sql = R.key_sql(f"{a[i]}::BIGINT", f"{b[i]}::BIGINT", f"{c[i]}::BIGINT", f"{j * 999}::BIGINT")
            assert duckdb.execute(f"SELECT {sql}").fetchall()[0][0] == key[i, j]


def test_groups_of_one_draw_share_their_sides(spark):
    """With the same rows, classes and sides, groups of one ``drawn_by`` have the same shifts; others have their own."""
    rng = random.Random(5)
    base = [(i, i % 2, rng.random(), rng.random() < 0.6) for i in range(120)]
    rows = [(e, m, i, y, p, s) for e in "ab" for m in "xy" for i, y, p, s in base]
    df = spark.createDataFrame(rows, "e string, m string, id long, y int, prob double, inside boolean")

    def shifts(drawn_by):
        out = {}
        for r in H.permuted_shifts(df, ["e", "m"], ["ba", "strat_brier"], 20, 3, method="remix", drawn_by=drawn_by).collect():
            out.setdefault((r["e"], r["m"]), {})[r["metric"], r["perm"]] = r["shift"]
        return out

    shared, own = shifts(["e"]), shifts(None)
    assert shared["a", "x"] == shared["a", "y"] and shared["b", "x"] == shared["b", "y"] and shared["a", "x"] != shared["b", "x"]
    assert own["a", "x"] != own["a", "y"]


def test_side_of_one_class_is_drawn_once(spark):
    """Outside has one class whatever the draw: metrics of both classes have no shift, and every redraw is there once."""
    rows = [(i, int(i < 40), 0.01 * i, not 30 <= i < 40) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, y int, prob double, inside boolean").withColumn("g", F.lit(1))
    got = H.permuted_shifts(df, ["g"], ["ba"], 15, 3, method="remix").collect()
    assert sorted(r["perm"] for r in got) == list(range(-1, 15)) and all(r["shift"] is None for r in got)


@pytest.mark.parametrize("method, seed", [("md5", 5), ("xxhash64", 5), ("xxhash64", 1 << 40)])
def test_hashed_keys_are_those_of_spark(spark, method, seed):
    """Also beyond one block of 64 bytes, with missing keys, and of later attempts."""
    ids = ["a", "é" * 9, "x" * 46, "x" * 60, None]
    df = spark.createDataFrame([(g, i) for g in ("g", "a longer name", None) for i in ids], "g string, id string")
    n, draws = 7, np.array([0, 6, 7, 20, 69])
    order = R.Hashed(method, n, seed)
    per_draw = [order_key([F.col("id"), F.col("g"), F.lit(int(d % n)), F.lit(seed), F.lit(int(d // n))], method) for d in draws]
    rows = df.select(*order.columns([F.col("id"), F.col("g")]), F.array(*per_draw).alias("want")).toPandas()
    first, second = order.keys(order.numbers(rows), slice(0, len(rows)), draws)
    for i, want in enumerate(rows["want"]):
        for j, h in enumerate(want):
            at = np.array([i]), np.array([j])
            assert (int(first[i, j]) << 31) + int(second(*at)[0]) == int(h[:16], 16) >> 2


def test_hashed_redraws_sort_no_copies_of_rows(spark, monkeypatch):
    """No plan holds rows times redraws: what is written stays near rows plus redraws of each stratum."""
    written = []

    def watched(df, name):
        out = materialise(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(R, "materialise", watched)
    rows, n = 1500, 200
    df = spark.range(rows).select(F.lit(1).alias("g"), "id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 97 / 97.0).alias("prob"), (F.col("id") % 5 < 3).alias("inside"))
    layouts = []
    monkeypatch.setattr(R, "limits", lambda lay, plan, band=None, real=R.limits: layouts.append(lay.order) or real(lay, plan, band))
    got = H.metrics_per_redraw(df, ["g"], ["ba"], n, 3, method="md5")
    assert got.count() == 2 * (n + 1)
    assert len(layouts) == 1 and isinstance(layouts[0], R.Hashed)
    assert max(c for _, c in written) <= max(rows, 2 * n)


def test_regression_redraws_do_not_broadcast_rows(spark, monkeypatch):
    hints = []
    monkeypatch.setattr(H, "join_on", lambda a, b, keys, how="inner": hints.append((keys, b._jdf.queryExecution().analyzed().toString())) or join_on(a, b, keys, how))
    rows = [(1, i, float(i % 13), i % 7 + 0.5, i % 3 > 0, i % 7 - 1.0, i % 7 + 2.0, level) for i in range(60) for level in (0.1, 0.32)]
    df = spark.createDataFrame(rows, "g int, id int, y double, pred double, inside boolean, lower double, upper double, sig_level double")
    assert H.value_metrics_per_redraw(df, ["g"], ["rmse", "validity"], 5, 3).count() == 2 * 2 * 6
    by_id = [plan for keys, plan in hints if "id" in keys]
    assert len(by_id) == 2 and all("strategy=merge" in plan for plan in by_id)


def test_keys_of_shared_draws_are_worked_out_once(monkeypatch):
    """Strata of groups that share their draws are one task's work: a key for each id and redraw, whatever the groups."""
    import pandas as pd

    rng = np.random.default_rng(3)
    ids = pd.DataFrame({x: rng.integers(1, R.PRIME, 300) for x in ("_a", "_b", "_c")})
    held = {0: ids, 1: ids, 2: ids.iloc[40:]}  # the third cell lacks some rows
    rows = pd.concat([own.assign(_cell=c, _group=10 + c, v=1.0 + own.index) for c, own in held.items()])
    quota, draws, order = {0: 90, 1: 200, 2: 130}, np.arange(30), R.Remixed(1)
    key = {c: order.keys(order.numbers(own), slice(None), draws) for c, own in held.items()}
    whole = {c: (f << 31) + s(*np.indices(f.shape)) for c, (f, s) in key.items()}
    limit = {c: np.sort(k, axis=0)[quota[c] - 1] for c, k in whole.items()}
    worked = []
    real = R.first_key
    monkeypatch.setattr(R, "first_key", lambda a, b, c, d: worked.append(len(a) * d.size) or real(a, b, c, d))
    plan = pd.DataFrame({"_cell": [0, 1, 2], "_draws": [draws] * 3, "_low": [0] * 3, "_high": [R.PRIME] * 3, "_limits": [limit[c] for c in range(3)]})
    near = R._near(rows, plan, order)
    assert sum(worked) == 300 * 30
    for c, own in near.groupby("_cell"):
        assert (own["_below"] == 0).all()
        assert all(sorted(k) == sorted(whole[c][:, d]) for d, k in zip(own["_place"], own["_keys"]))
    worked.clear()
    sums = R._sums(rows, plan, ["v"], [], order)
    assert sum(worked) == 300 * 30
    for c in range(3):
        own = sums[sums["_group"] == 10 + c]
        inside = whole[c] <= limit[c]
        assert (own["in_n"] == quota[c]).all()
        assert np.allclose(own["in_v"], (inside * (1.0 + held[c].index.to_numpy())[:, None]).sum(axis=0))
