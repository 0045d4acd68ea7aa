"""Resharding: the flow against all flows of small cases, the rows against the plan."""

from __future__ import annotations

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from adspark.llm import sharding as S
from adspark.llm.queries import QUERIES


def fewest_moved(supply, capacity):
    """Only bytes above a shard's capacity must move."""
    return sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_flow(seed):
    rng = random.Random(seed)
    supply = [rng.choice([0, 0, 5, 40, 400]) for _ in range(rng.randint(1, 6))]
    total, m = sum(supply), rng.randint(1, 7)
    capacity = [total // m + (j < total % m) for j in range(m)]
    flow = S.cheapest_flow(supply, capacity)
    for i, s in enumerate(supply):
        assert sum(v for (a, _), v in flow.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(v for (_, b), v in flow.items() if b == j) == c
    assert sum(v for (i, j), v in flow.items() if i != j) == fewest_moved(supply, capacity)


def test_flow_by_enumeration():
    supply, capacity = [4, 1, 1], [1, 2, 3]
    best = min(
        sum(f[i][j] for i in range(3) for j in range(3) if i != j)
        for f in itertools.product([r for r in itertools.product(range(4), repeat=3) if sum(r) in (1, 4)], repeat=3)
        if [sum(r) for r in f] == supply and [sum(r[j] for r in f) for j in range(3)] == capacity
    )
    flow = S.cheapest_flow(supply, capacity)
    assert sum(v for (i, j), v in flow.items() if i != j) == best
    with pytest.raises(ValueError):
        S.cheapest_flow([1], [2])


def reshard(spark, rows, old=4, new=6):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int").withColumn("shard", F.lit("clash"))
    plan, placed = S.reshard(docs.repartition(3), F.coalesce(F.pmod("source", F.lit(old)), F.lit(0)), old, new)
    return plan, placed.collect()


def test_rows_sizes_and_slots(spark):
    rng = random.Random(1)
    rows = [(i, "é" * int(rng.paretovariate(1.2) * 10), 0 if rng.random() < 0.5 else rng.randint(0, 9)) for i in range(800)]
    plan, placed = reshard(spark, rows)
    assert sorted((r["doc_id"], r["text"]) for r in placed) == sorted((d, t) for d, t, _ in rows)
    sizes, slots = {}, {}
    for r in placed:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(r["text"].encode()) + 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * max(sizes.values())
    assert {j: s for j, s in plan.sizes.items() if s} == sizes
    # rows that need not move stay: little more than the fewest bytes crosses shards
    moved = sum(len(t.encode()) + 8 for d, t, s in rows if {r["doc_id"]: r["shard"] for r in placed}[d] != s % 4)
    assert moved <= 1.15 * plan.moved + 2000


def test_odd_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", None), (2, "x" * 100_000, 1), (3, "y", 2), (3, "y", 2)]
    _, placed = reshard(spark, rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in placed) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert sum(r["text"] is None for r in placed) == 2
    assert reshard(spark, [])[1] == []


def test_rewrite_of_affected_shards_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, i * 7, 10) for i in range(30)], "doc_id long, shard int, key long, size long")
    S.rewrite(rows, f"file://{tmp_path}/out", shards=[1, 2])
    assert {r["shard"] for r in S.read_shards(spark, f"file://{tmp_path}/out", "doc_id long").collect()} == {1, 2}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_reshard"](spark, folder).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts.items()}
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24 for r in rows)
