"""Shared lines against a brute-force version."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adspark.llm import line_dedup as L
from adspark.llm.queries import QUERIES, SQL
from tests.check_catalog import compare, duck

SCHEMA = "doc_id long, text string"
SHARED = "This line stands in many documents"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(L.BLANKS))


def brute(rows, keep=max):
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders[key_of(line)]
            gone = len(key_of(line)) >= 20 and len(held) >= 3 and d != keep(x for x in held if x is not None)
            if not gone:
                kept.append(line)
        text = "\n".join(kept)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tag", F.lit("clash")).withColumn("words", F.lit(1))
    found = L.drop_shared_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = ["".join(rng.choice("abc déß ") for _ in range(rng.randint(15, 40))).strip() for _ in range(30)]
    out = [(i, "\n".join(rng.choice(shared).upper() if rng.random() < 0.2 else rng.choice(shared) + "\t " * (i % 2) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "\n\n"), (103, SHARED), (103, SHARED + "\nand the same id again, other text"), (103, SHARED)]
    out += [(None, SHARED + "\n" + SHARED), (None, shared[0]), (104, f"  {SHARED.lower()}\r\nx"), (105, "Ä" * 25), (106, "ä" * 25), (107, "Ä" * 25), (108, "ä" * 25)]
    out += [(109, "\n".join([SHARED, "only here"] * 500)), (110, "y" * 300_000), (111, "Ä" * 25)]
    return out


def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_smallest_keeps(spark, rows):
    assert run(spark, rows, keep="smallest") == brute(rows, keep=min)


def test_keys_counted_before_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "SEEN", 2)
    monkeypatch.setattr(L, "PART_OF_RANGE", 1000)
    hot, several, _ = L._hot_keys(L._tagged(spark.createDataFrame(rows, SCHEMA), "doc_id", "text"), 20)
    assert several > 5
    assert run(spark, rows) == brute(rows)


def test_bitmaps_are_sparse_and_need_no_text(spark, rows):
    got = L.drop_bitmaps(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc", "tag", "words"]
    found = {r["doc"]: r["words"] for r in got.collect()}
    assert not {100, 106, 110, 111} & set(found) and {105, 107} <= set(found)
    text = "\n".join(["x"] * 700 + [SHARED])
    far = L.drop_bitmaps(spark.createDataFrame([(1, text), (2, SHARED), (3, SHARED)], SCHEMA)).where("doc = 1").first()
    assert [tuple(w) for w in far["words"]] == [(10, 1 << 60)]


def test_no_python_on_the_executors(spark, rows):
    plan = L.drop_shared_lines(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nothing_to_do(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_twin(spark, folder):
    assert compare(QUERIES["op11_line_dedup"](spark, folder), duck(folder), SQL["op11_line_dedup"]) is None
