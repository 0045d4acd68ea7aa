"""Distances, neighbours and applicability domain against hand values and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.functions.distance import Pairs, block_distances
from adspark.operators import domain as D
from adspark.operators.neighbours import Space, distance_counts, lay_out, nearest_points
from adspark.streaming.scoring import dknn_stream

# id, five binary descriptors
TOY = [
    (0, [1, 0, 0, 1, 1]), (2, [0, 0, 0, 1, 1]), (3, [1, 1, 1, 1, 1]), (5, [0, 0, 0, 1, 1]),
    (6, [1, 0, 0, 1, 1]), (7, [0, 1, 0, 1, 1]), (9, [0, 0, 0, 1, 1]), (8, [0, 0, 1, 0, 0]),
]
TOY_LIMITS = {2: 0.746410162, 5: 0.746410162, 6: 1.282842712, 7: 1.282842712, 9: 0.746410162, 8: 1.839230485}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id int, features array<double>")


@pytest.fixture(scope="module")
def toy(spark):
    rows = frame(spark, TOY)
    return rows.where("id NOT IN (0, 3)"), rows.where("id IN (0, 3)")


@pytest.mark.parametrize("pivots,block", [(1, 1024), (3, 2)])
def test_toy_thresholds_and_status(toy, pivots, block):
    train, test = toy
    space = Space(pivots=pivots, block_rows=block)
    got = {r.id: r.limits[0] for r in D.dknn_thresholds(train, space, [2]).collect()}
    assert got == pytest.approx(TOY_LIMITS, abs=1e-8)
    status = {r.id: r.inside for r in D.dknn_status(train, test, space, [2]).collect()}
    assert status == {0: True, 3: False}


def test_nearest_only_variant(spark):
    train = frame(spark, [(1, [1]), (2, [2]), (4, [100]), (5, [1])])
    test = frame(spark, [(10, [101]), (20, [2]), (30, [101]), (50, [1.5])])
    space = Space(metric="manhattan")
    means = {r.id: r.d_mean for r in D.nearest_mean(train, None, space, 2).collect()}
    assert means == {1: 0.5, 2: 1.0, 4: 98.5, 5: 0.5}
    near = nearest_points(lay_out(train, space), None, 2)
    assert D.reference_values(near, space, [2]).first().radii == [62.6875]
    limits = {r.id: r.limits[0] for r in D.dknn_thresholds(train, space, [2], nearest_only=True).collect()}
    assert limits == {1: 0.5, 2: 1.0, 4: 0.5, 5: 0.5}
    status = {r.id: r.inside for r in D.dknn_status(train, test, space, [2], nearest_only=True).collect()}
    assert status == {10: False, 20: True, 30: False, 50: True}


def test_all_zero_thresholds_stay_zero(spark):
    train = frame(spark, [(1, [0]), (2, [0]), (4, [0]), (5, [1])])
    limits = D.dknn_thresholds(train, Space(metric="manhattan"), [2]).collect()
    assert {r.limits[0] for r in limits} == {0.0}
    far = frame(spark, [(10, [5])])
    assert not D.dknn_status(train, far, Space(metric="manhattan"), [2]).first().inside


def test_copies_have_zero_mean_distance_and_even_p_value(spark):
    train = frame(spark, [(1, [0, 0]), (2, [0, 0]), (3, [5, 5]), (4, [5, 5])])
    test = frame(spark, [(10, [0, 0]), (20, [1, 1])])
    out = D.with_p_value(D.nunc_status(train, test, Space(), [1]))
    got = {r.id: (r.d_mean, r.p_value, r.inside) for r in out.collect()}
    assert got[10] == (0.0, 0.5, True)
    assert got[20][1] == 0.0 and not got[20][2]
    assert D.all_copies(train, Space()).first().all_duplicated


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "jaccard"])
def test_blocked_neighbours_equal_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    n, group = 240, 2
    if metric == "jaccard":
        values = rng.integers(0, 2**12, size=(n, 2)).tolist()
        kind = "array<bigint>"
    else:
        # clustered points, so that cells are skipped, and a third of all rows one hot copy
        values = (rng.normal(size=(n, 3)) + 8 * rng.integers(0, 4, size=(n, 1))).round(3).tolist()
        kind = "array<double>"
    values[: n // 3] = [values[0]] * (n // 3)
    rows = [(i, i % group, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"id int, g int, features {kind}")
    space = Space(metric=metric, by=("g",), pivots=5, block_rows=16)
    got = {r.id: r.dists for r in D.nearest_distances(df, None, space, 4).collect()}

    def dist(a, b):
        if metric == "jaccard":
            both = sum(bin(x & y).count("1") for x, y in zip(a, b))
            either = sum(bin(x | y).count("1") for x, y in zip(a, b))
            return 1 - both / either if either else 0.0
        d = np.abs(np.array(a) - np.array(b))
        return float(np.sqrt((d * d).sum())) if metric == "euclidean" else float(d.sum())

    for i, g, v in rows:
        want = sorted(dist(v, w) for j, h, w in rows if h == g and j != i)[:4]
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_pair_counts_cover_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 64, size=1).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, features array<bigint>")
    counts = distance_counts(lay_out(df, Space(metric="jaccard", pivots=3, block_rows=8)), None)
    assert counts.agg(F.sum("pairs")).first()[0] == 50 * 49 // 2
    with pytest.raises(ValueError):
        distance_counts(lay_out(df, Space(metric="manhattan")), None)


def test_rdn_scales_thresholds(spark):
    train = frame(spark, [(1, [1]), (2, [2]), (4, [100]), (5, [1])])
    test = frame(spark, [(10, [101]), (20, [2]), (50, [1.5])])
    zero = train.withColumn("weight", F.lit(0.0))
    status = {r.id: r.inside for r in D.rdn_status(zero, test, Space(metric="manhattan"), 2).collect()}
    assert status == {10: False, 20: True, 50: False}  # only an exact copy is within distance 0
    assert [D.scale_by_k(k) for k in (30, 31, 40, 41)] == [1 / 3, 0.5, 0.5, 1.0]


def test_dispatcher_rejects_unknown_method(toy):
    with pytest.raises(ValueError):
        D.inside_outside("other", *toy, Space(), 1)


def test_stream_gets_the_batch_result(spark, toy, tmp_path):
    train, test = toy
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    test.write.parquet(source)
    stream = spark.readStream.schema(test.schema).parquet(source)
    query = dknn_stream(train, stream, Space(), 2, target, str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.id: r.inside for r in spark.read.parquet(target).collect()}
    assert got == {0: True, 3: False}


def test_estimated_pairs_equal_all_distances():
    """Hits, nearest pairs and bins of the estimated squares, also where they lie on a limit or far from zero."""
    rng = np.random.default_rng(4)
    for shift in (0.0, 1e4):
        a, b = rng.normal(size=(40, 6)) + shift, rng.normal(size=(60, 6)) + shift
        b[:10] = a[:10]
        b[10:20] = a[:10]
        d = block_distances(a, b, "euclidean")
        for limit in (d[3, 30], 0.0, 1.5, np.inf, -1.0):
            i, j, found = Pairs(a, b, "euclidean").within(np.full((1, 60), limit))
            assert set(zip(i, j)) == set(zip(*np.nonzero(d <= limit))) and (found == d[i, j]).all()
        i, j, found = Pairs(a, b, "euclidean").nearest(3, (np.arange(10), np.arange(10)))
        for row in range(40):
            want = np.sort(np.delete(d[row], row) if row < 10 else d[row])[:3]
            assert np.sort(found[i == row])[:3].tolist() == want.tolist()
        upper = 64 * d[5, 40] / 7  # the distance lies on the border of a bin
        number, edges = Pairs(a, b, "euclidean").binned(64, upper)
        assert (number == np.minimum(np.floor(d / upper * 64), 63)).all() and len(edges) == 65
    odd = np.array([[np.inf, 0.0], [1.0, 2.0]])
    number, _ = Pairs(odd, odd, "euclidean").binned(4, 1.0)
    assert number.tolist() == [[4, 3], [3, 0]]
    words = rng.integers(0, 1 << 62, (30, 2)).astype(np.uint64)
    words[:3] = 0
    for some in (words, np.tile(words, (1, 20))):
        number, values = Pairs(some, some, "jaccard").ratios()
        assert (values[number] == block_distances(some, some, "jaccard")).all() and len(np.unique(values)) == len(values)


def test_a_block_returns_one_row_a_query_however_many_neighbours(spark):
    """Neighbours are sent as lists: no row per candidate and block."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(60)], "id int, features array<double>")
    near = {r.point: r.dists for r in nearest_points(lay_out(df, Space(pivots=2, block_rows=8)), None, 20).collect()}
    x = {r.id: np.array(r.features) for r in df.collect()}
    for i in x:
        want = sorted(float(np.linalg.norm(x[i] - x[j])) for j in x if j != i)[:20]
        assert near[i] == pytest.approx(want)
