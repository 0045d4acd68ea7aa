"""Repeated passages against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from adspark.llm import repeats


def brute(rows, window=100):
    """doc_id -> (bytes, removed, spans, hash of what stays), windows compared as they are."""
    texts = sorted({(d is not None, d, t or "") for d, t in rows}, key=lambda x: (x[0], x[1] or 0))
    first, out = {}, {}
    for _, d, t in texts:
        data = t.encode()
        gone = [False] * len(data)
        for s in range(len(data) - window + 1):
            w = data[s : s + window]
            if w in first:
                for k in range(s, s + window):
                    gone[k] = True
            else:
                first[w] = (d, s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.remove_repeats(docs.repartition(3))
    got = [
        (r["doc_id"], (len(r["kept"]) + sum(b - a for a, b in r["spans"]), sum(b - a for a, b in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
        for r in found.collect()
    ]
    assert len(got) == len(rows)
    return got


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    shared = [prose(rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), p[cut : len(p) - rng.randint(0, 20)])
        rows.append((i, " ".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1][5:]), (n + 3, "ab" * 400), (n + 4, "x" * 350), (n + 5, "x" * 99), (n + 6, "x" * 100)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert dict(run(spark, rows)) == want
    assert sum(w[1] for w in want.values()) > 0


def test_nulls_empty_and_repeated_rows(spark):
    text = "the same words over and over again, " * 3 + "and then something else that is long enough to count as well"
    rows = [(5, None), (None, text), (7, text), (7, text), (8, ""), (9, text)]
    want = brute(rows)
    got = run(spark, rows)
    assert all(w == want[d] for d, w in got)
    assert run(spark, []) == []


def test_long_text_in_stretches(spark, monkeypatch):
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(5000))
    whole = repeats.runs_of(data)
    monkeypatch.setattr(repeats, "STRETCH", 700)
    lo, hi, _ = repeats.runs_of(data)
    assert lo[0] == 0 and hi[-1] == len(data) - 100 and (lo[1:] == hi[:-1] + 1).all()
    assert len(whole[0]) <= len(lo) <= len(whole[0]) + 8


def test_equal_windows_choose_the_same_gram():
    rng = random.Random(3)
    part = bytes(rng.choice(b"abcd ") for _ in range(400))
    a, b = b"0123456789" * 5 + part, b"zyx" * 30 + part
    runs = []
    for data, at in ((a, 50), (b, 90)):
        lo, hi, g = repeats.runs_of(data)
        runs.append({s - at: int(x) for p, q, x in zip(lo, hi, g) for s in range(p, q + 1) if s >= at})
    assert runs[0] == runs[1]


def test_spans_of_whole_characters_keep_a_text(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string").withColumn("lang", F.lit("de"))
    rows = repeats.remove_repeats(docs, characters=True, carry=["lang"]).collect()
    assert all(r["kept"].decode("utf-8") is not None and r["lang"] == "de" for r in rows)
