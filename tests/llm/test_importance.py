"""Importance resampling against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adspark.llm import importance as I
from adspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25, min_words=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    long_enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("rank", F.lit(0))
    found = I.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdÉé中Z09") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    out = [(i, rng.choice([" ", ", ", "_", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    out += [(1000, None), (1001, ""), (1002, " -- "), (1003, "one"), (None, "word " * 30), (None, "other words " * 20)]
    return out + out[:20] + [(1004, "long text " * 120_000)], [" ".join(rng.choice(words[:80]) for _ in range(12)) for _ in range(40)] + [None, ""]


def test_against_brute_force(spark, rows):
    docs, target = rows
    # the repeated rows are equal, so which of them has which rank is open, and equal in the sorted list
    assert run(spark, docs, target) == brute(docs, target)


@pytest.mark.parametrize(("percent", "min_words"), [(100, 0), (0, 20), (1, 1), (99, 5)])
def test_other_shares(spark, rows, percent, min_words):
    docs, target = rows
    assert run(spark, docs, target, percent=percent, min_words=min_words) == brute(docs, target, percent, min_words)


def test_a_bracket_that_misses_is_widened(spark):
    scores = [(i, i * 7919 % 1000 // 3) for i in range(5000)]
    frame = spark.createDataFrame([(i, i, s) for i, s in scores], "row long, doc_id long, score long")
    order = sorted(scores, key=lambda x: (-x[1], x[0]))
    calls = []
    for k in (1, 2, 1250, 4999, 5000):
        low, high, above, inside = I.cutoff(frame, k, 5000, margin=1e-9, accuracy=3)
        assert above == sum(s > high for _, s in scores) and inside == sum(low <= s <= high for _, s in scores)
        assert above < k <= above + inside
        calls.append(inside)
        got = sorted((r["place"], r["row"]) for r in I.draw(frame, k, 5000).collect())
        assert got == [(p + 1, i) for p, (i, _) in enumerate(order[:k])]
    assert min(calls) < 1000


def test_all_scores_equal(spark):
    frame = spark.createDataFrame([(i, i, 5) for i in range(300)], "row long, doc_id long, score long")
    assert sorted(r["row"] for r in I.draw(frame, 100, 300).collect()) == list(range(100))


def test_features_do_not_depend_on_the_chunk():
    text = "Äb c1d  EF\x00g-hÉ 中文 0 " * 50
    want = Counter(features(text))
    for chunk in (1, 9, 10_000):
        got: Counter = Counter()
        for _, found in I.feature_buckets(text, chunk=chunk):
            got.update(found.tolist())
        assert got == want


def test_nothing_to_draw(spark):
    assert run(spark, [], ["a b"]) == []
    assert run(spark, [(1, "a b c")], []) == brute([(1, "a b c")], [])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op13_importance_resampling"](spark, folder).collect()), key=str)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(docs, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
