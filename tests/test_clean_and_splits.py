"""De-duplication, checks and splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from adspark.operators import clean as C
from adspark.operators import splits as S


def test_class_dedup_drops_conflicts(spark):
    rows = [(1, "A", 1), (2, "A", 0), (3, "B", 0), (4, "B", 0), (5, "C", 1), (6, "C", 1)]
    df = spark.createDataFrame(rows, "id int, key string, y int")
    got = C.dedup_classes(df, "key", "y", ["id"]).collect()
    assert sorted((r.id, r.y) for r in got) == [(3, 0), (5, 1)]


@pytest.mark.parametrize(
    "values,want",
    [
        ({"A": [1.0, 0.0], "B": [0.9, 1.1], "C": [2.0, 1.0]}, {"A": 0.5, "B": 1.0, "C": 1.5}),
        ({"C": [2.0, 1.0, 20.0, 1.6]}, {"C": 1.8}),
        ({"D": [0.9, 1.1, 500.0], "E": [0.9, 500.0]}, {"D": 1.0, "E": 250.45}),
    ],
)
def test_value_dedup(spark, values, want):
    rows = [(k, v, i) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, v double, id int")
    got = {r.key: r.v for r in C.dedup_values(df, "key", "v", ["id"]).collect()}
    assert got == pytest.approx(want)


def test_value_dedup_by_deviation(spark):
    df = spark.createDataFrame([("A", 0.9, 1), ("A", 1.1, 2), ("B", 0.9, 3), ("B", 500.0, 4)], "key string, v double, id int")
    assert [r.key for r in C.dedup_values(df, "key", "v", ["id"], max_deviation=0.2).collect()] == ["A"]


def test_first_pass_uses_the_given_limit_and_later_ones_three(spark):
    values = [1.0, 1.1, 0.9, 1.05, 0.95, 1.4, 30.0]
    df = spark.createDataFrame([("A", v) for v in values], "key string, v double")

    def reference(vals, limit):
        while len(vals) > 2:
            kept = []
            for i, v in enumerate(vals):
                rest = vals[:i] + vals[i + 1 :]
                m = sum(rest) / len(rest)
                sd = (sum((x - m) ** 2 for x in rest) / len(rest)) ** 0.5
                if abs(v - m) <= limit * sd:
                    kept.append(v)
            if len(kept) == len(vals):
                break
            vals, limit = kept, 3
        return sorted(vals)

    for limit in (2.0, 3.0):
        got = sorted(r.v for r in C.without_outliers(df, ["key"], "v", limit).collect())
        assert got == reference(values, limit)


def test_same_key_gets_same_id(spark):
    df = spark.createDataFrame([(2, "A"), (4, "B"), (1, "D"), (7, "C"), (9, "B")], "old int, key string")
    got = {r.key: r.id for r in C.dense_ids(df, "key").collect()}
    assert got == {"A": 0, "B": 1, "C": 2, "D": 3}


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("Active",), ("Inactive",)], "l string")
    assert [r[0] for r in df.select(C.encode_label("l", "Active", "Inactive")).collect()] == [1, 0]
    bad = spark.createDataFrame([("?",)], "l string")
    with pytest.raises(Exception, match="unknown class label"):
        bad.select(C.encode_label("l", "Active", "Inactive")).collect()


def test_integrity_failure_stops_the_job(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "id int, y int")
    with pytest.raises(Exception, match="integrity"):
        C.assert_integrity(C.integrity(df, df, "id", ["y"])).collect()


def test_scaling_of_constant_descriptor(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "f array<double>")
    a, _ = C.min_max_scale(train, train, "f", 2)
    assert sorted(r.f for r in a.collect()) == [[0.0, 0.0], [1.0, 0.0]]


def numbers(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") * 1.5).alias("v"))


def test_stratified_split_has_exact_quotas(spark):
    df = numbers(spark, 100)
    out = S.stratified_split(df, "id", "y", 0.2, 7)
    counts = {(r.y, r.role): r["count"] for r in out.groupBy("y", "role").count().collect()}
    assert sum(v for (_, role), v in counts.items() if role == "test") == 20
    assert {counts[(y, "test")] for y in range(3)} <= {6, 7}
    again = S.stratified_split(df, "id", "y", 0.2, 7)
    assert out.exceptAll(again).isEmpty()
    other = S.stratified_split(df, "id", "y", 0.2, 8)
    assert not out.exceptAll(other).isEmpty()


def test_folds_are_disjoint_and_even(spark):
    out = S.k_folds(numbers(spark, 103), "id", "y", 5, 1)
    assert out.select("id").distinct().count() == 103
    sizes = [r["count"] for r in out.groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_contiguous_parts_put_the_rest_last(spark):
    out = S.contiguous_parts(numbers(spark, 103).select("id"), "id", 5, 1)
    sizes = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}


def test_continuous_split_is_balanced(spark):
    df = spark.range(400).select("id", F.pow(F.col("id") / 400.0, 2).alias("y"))
    report = S.split_report(S.continuous_split(df, "id", "y", 0.25, 3), [], "y", test_fraction=0.25).first()
    assert report.n_train + report.n_test == 400 and report.size_ok and report.mean_ok and report.sd_ok


def test_single_bins_are_merged():
    merged = S._merged_bins({1: 5, 2: 1, 3: 1, 5: 4, 9: 1})
    sizes = {1: 5, 2: 1, 3: 1, 5: 4, 9: 1}
    total = {}
    for b, t in merged.items():
        total[t] = total.get(t, 0) + sizes[b]
    assert merged[2] == merged[3] == 2 and merged[9] == 5
    assert min(total.values()) > 1
    # without neighbouring singles a single bin joins any neighbour
    assert S._merged_bins({1: 5, 2: 1, 4: 6}) == {1: 1, 2: 1, 4: 4}
