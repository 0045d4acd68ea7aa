"""Near copies by exact similarity against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from adspark.llm import similar


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def changed(rng, text, k):
    text = list(text)
    for at in rng.sample(range(len(text)), k):
        text[at] = "".join(rng.choice("klmnop") for _ in range(6))
    return text


def runs(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def kept(texts):
    """Ids that stay by comparing all pairs: the least of each component."""
    sets, group = [runs(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if group[a] != group[b] and (x == y or len(x & y) / len(x | y) >= 0.8 - 1e-9):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return sorted(set(group))


@pytest.fixture(scope="module")
def corpus():
    """Copies on both sides of 0.8, a line that many texts hold, a large group of copies, short and empty texts."""
    rng = random.Random(11)
    line = " ".join(words(rng, 12))
    texts = []
    for n in (30, 60, 127, 230, 248, 600):
        for k in range(1, 1 + n // 20):
            base = words(rng, n)
            texts += [" ".join(base), " ".join(changed(rng, base, k)).upper()]
    base = words(rng, 90)
    texts += [" ".join(changed(rng, base, rng.randint(0, 4))) for _ in range(120)]
    texts += [f"{line}\n{' '.join(words(rng, rng.choice([1, 2, 3, 40])))}" for _ in range(100)]
    texts += ["one two", "ONE  two", "one two three", "", None, " \n", "x"]
    rng.shuffle(texts)
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, corpus):
    rows = corpus_pipeline.simhash_near_dedup(spark, frame(spark, corpus), "").collect()
    assert sorted(r["doc_id"] for r in rows) == kept(corpus)
    assert all(r["text"] == corpus[r["doc_id"]] for r in rows)


def test_without_first_links_and_with_frequent_shingles(spark, corpus, monkeypatch):
    monkeypatch.setattr(similar, "_first_pairs", lambda sketches: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(similar, "LONG", 8)
    rows = similar.keep_one_of_similar(frame(spark, corpus)).collect()
    assert sorted(r["doc_id"] for r in rows) == kept(corpus)


def test_first_links_come_from_simhash_and_minhash(spark, corpus):
    rng = random.Random(4)
    base = words(rng, 400)
    texts = [" ".join(base), " ".join(changed(rng, base, 1)), " ".join(words(rng, 400))]
    frame_ = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    sketches = similar._sketches(frame_, 5, 0.8)
    assert {tuple(r) for r in similar._first_pairs(sketches).collect()} == {(0, 1)}
    # without MinHash keys the fingerprints still find the pair
    prints = {r["key"]: r["fp"] & (1 << 64) - 1 for r in sketches.collect()}
    near = (prints[0] ^ prints[1]).bit_count() <= similar.NEAR_BITS
    alone = similar._first_pairs(sketches.withColumn("bands", F.array().cast("array<long>"))).collect()
    assert {tuple(r) for r in alone} == ({(0, 1)} if near else set())


def test_prefixes_of_similar_sets_meet_and_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, n // 5 + 1)) :], rng.integers(1, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        known = np.sort(rng.choice(a, len(a) // 2, replace=False))
        frequent = known, rng.integers(3, 9, len(known))
        both = len(np.intersect1d(a, b))
        differ = len(a) + len(b) - 2 * both
        assert np.bitwise_count((similar.bitmap(a) ^ similar.bitmap(b)).view(np.uint64)).sum() <= differ
        assert similar.bitmaps_differ(similar.long_bitmap(a), similar.long_bitmap(b)) <= differ
        if both >= 0.8 * (both + differ):
            assert len(np.intersect1d(similar.prefix(a, frequent, 0.8), similar.prefix(b, frequent, 0.8)))
