"""Stages of the corpus pipeline against brute-force versions, each on its own input."""

from __future__ import annotations

import random
import zlib

import pytest

import corpus_pipeline
from tests.llm.test_repeats import brute
from tests.llm.test_similar import kept as kept_of_all_pairs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows that go into and come out of every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        out.append(docs.collect())
    return out


def test_columns_stay(stages):
    for rows in stages[:-1]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_rejected_documents_go(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i in kept_of_all_pairs([r["text"] for r in rows])}
    assert {r["doc_id"] for r in stages[2]} == want and len(want) < len(rows)


def test_repeated_passages_go(stages):
    want = brute([(r["doc_id"], r["text"]) for r in stages[2]])
    before = {r["doc_id"]: len((r["text"] or "").encode()) for r in stages[2]}
    assert len(stages[3]) == len(stages[2])
    for r in stages[3]:
        gone = before[r["doc_id"]] - len(r["text"].encode())
        _, removed, spans, _ = want[r["doc_id"]]
        # a character that is covered in part stays: at most three bytes at either end of a span
        assert removed - 6 * spans <= gone <= removed
        assert r["n_chars"] == len(r["text"])


def test_benchmark_items_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in stages[3] if any(t in r["text"] for t in items)}
    kept = {r["doc_id"] for r in stages[4]}
    assert leaked and not leaked & kept
    clean = {r["doc_id"] for r in stages[3] if not any(t[:40] in r["text"] or t[-40:] in r["text"] for t in items)}
    assert clean <= kept


def test_packed_whole(stages):
    pieces = stages[5]
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in stages[4]}
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= 4096
    assert len(sequences) <= 1 + 1.02 * sum(p["length"] for p in pieces) / 4096


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(80)) + "."
    rows = [(1, prose, "en", "s", 3, 0), (1, prose, "en", "s", 3, 0), (None, prose[::-1], None, None, None, 1), (4, None, "en", "s", 1, 2), (5, "", "en", "s", 0, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is it? it is this and that."), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        counts = []
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
            counts.append(docs.count())
        # the repeated row and one of the two texts without words go
        assert counts == ([5, 3, 3, 3, 3] if table else [0] * 5)


def test_registered_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, stages[5]))
    assert all(0 <= r["ids_crc32"] <= 0xFFFFFFFF for r in got) and zlib.crc32(b"") == 0
