"""Classifier, decontamination, token counts and licence scan."""

from __future__ import annotations

import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import decontaminate as D, licenses as L, rule_ensemble as R, token_counts as T
from adspark.llm.queries import QUERIES, SQL
from tests.check_catalog import compare, duck

FOLDER = "/root/testdata/sf0.01"


# classifier


def test_scores_of_held_out_rows(spark):
    rows = QUERIES["op4_quality_classifier"](spark, FOLDER).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in out]) > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(R.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({tuple(r) for r in R.training_table(docs, x, 500).collect()} for x in (labels, turned))
    assert a == b and 0 < len(a) <= 500


def test_rules_are_paths_of_the_tree():
    tree = """DecisionTree
  If (feature 0 <= 17.5)
   If (feature 1 <= 3.0)
    Predict: 0.0
   Else (feature 1 > 3.0)
    Predict: 1.0
  Else (feature 0 > 17.5)
   Predict: 1.0"""
    a, b = R.FEATURES[:2]
    inf = math.inf
    assert [set(r.bounds) for r in R.rules_of(tree)] == [{(a, -inf, 17.5)}, {(a, -inf, 17.5), (b, -inf, 3.0)}, {(a, -inf, 17.5), (b, 3.0, inf)}, {(a, 17.5, inf)}]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_without_two_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (2, None)], "doc_id long, text string").withColumn("label", F.lit("clash"))
    rows = R.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1 and all(r["score"] >= 0.5 for r in rows)
    assert R.quality_scores(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


# decontamination


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_search_finds_all_above_the_threshold():
    rng = random.Random(2)
    vocabulary = prose(rng, 60).split()
    items = [(i, rng.choices(vocabulary, k=rng.randint(3, 40)), rng.choices(vocabulary, k=rng.randint(0, 5))) for i in range(150)]
    df = Counter(w for _, q, a in items for w in set(q + a))
    items = [(i, [w.encode() for w in q], [w.encode() for w in a]) for i, q, a in items]
    df = {w.encode(): n for w, n in df.items()}
    mean = sum(len(q) + len(a) for _, q, a in items) / len(items)
    term, indexes, _ = D.build_indexes(items, df, len(items), mean)
    for index in indexes:
        weights = {t: dict(zip(ids.tolist(), x.tolist())) for t, (ids, x) in index.lists.items()}
        for threshold in (0.3, 0.6, 0.9):
            for _ in range(25):
                terms = sorted({term[w.encode()] for w in rng.choices(vocabulary, k=30) if w.encode() in term})
                want = {k: sum(weights.get(t, {}).get(k, 0) for t in terms) for k in range(len(index.items))}
                got = dict(index.search(terms, threshold))
                assert got.keys() == {k for k, s in want.items() if s >= threshold - 1e-9}
                assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("words_of_an_index", [D.INDEX_WORDS, 150])
def test_planted_items_are_found(spark, words_of_an_index):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([6, 15, 40, 100])) + "?", prose(rng, rng.choice([1, 6]))) for i in range(20)]
    docs, want = [], set()
    for d in range(60):
        text = prose(rng, rng.randint(0, 400))
        if d % 3 == 0:
            i, q, a = items[rng.randrange(20)]
            words = f"{q} {a}".upper().split()
            if len(words) > 30:
                words[7] = "changed"
            cut = rng.randint(0, len(text.split()))
            text = " ".join([*text.split()[:cut], *words, *text.split()[cut:]])
            want.add((d, i))
        docs.append((d, text))
    docs += [(100, None), (101, ""), (None, items[0][1] + " " + items[0][2]), (102, items[0][1])]
    want |= {(None, 0), (102, 0)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame([*items, (50, None, None), (51, "", "")], "item_id long, question string, answer string")
    rows = D.decontaminate(frame, table, index_words=words_of_an_index).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["score"] >= 0.6 and max(r["question_overlap"], r["answer_overlap"]) >= 0.5 for r in rows)
    assert D.decontaminate(frame, table.limit(0)).collect() == [] and D.decontaminate(frame.limit(0), table).collect() == []


def test_a_question_or_a_long_answer_alone_is_found(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, q) + "?", prose(rng, a)) for i, (q, a) in enumerate([(12, 12), (40, 6), (6, 40), (30, 30), (20, 3), (100, 5)] * 3)]
    docs, want = [], set()
    for i, q, a in items:
        for part, found in ((q, True), (a, len(a.split()) >= 5), (" ".join(q.split()[: len(q.split()) // 4]), False)):
            docs.append((len(docs), f"{prose(rng, rng.randint(0, 300))} {part.upper()} {prose(rng, rng.randint(0, 300))}"))
            if found:
                want.add((docs[-1][0], i))
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    rows = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["score"] >= 0.6 and r["n_passages"] >= 1 for r in rows)


def test_query_finds_what_stands_whole_in_documents(spark):
    rows = QUERIES["op5_decontamination"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}


# token counts


def best_count(word, scores, byte_score):
    """Score and tokens of the best segmentation, from right to left and without a trie."""
    best = {len(word): (0.0, 0)}
    for at in range(len(word) - 1, -1, -1):
        n = len(word[at].encode())
        options = [(best[at + 1][0] + byte_score * n, best[at + 1][1] + n)]
        options += [(best[e][0] + scores[word[at:e]], best[e][1] + 1) for e in range(at + 1, len(word) + 1) if word[at:e] in scores]
        best[at] = max(options, key=lambda x: (round(x[0], 9), -x[1]))
    return best[0][1]


def test_counts(spark, monkeypatch):
    scores, longest, byte_score = T.vocabulary(T.default_model())
    texts = ["The quick brown fox, the quicker fox", "", None, "naïve 中文 \U0001f600 x", "a" * 200 + " " + "ab" * 40, "the the\tthe\nthe"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, ""), (None, "the")], "doc_id int, text string").withColumn("n_tokens", F.lit("clash"))
    got = T.token_counts(docs, T.default_model()).collect()
    want = []
    for d, t in [*enumerate(texts), (1, ""), (None, "the")]:
        words = [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        want.append((d, len(words), len(set(words)), sum(best_count("▁" + w, scores, byte_score) for w in words)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert T.token_counts(docs.limit(0), T.default_model()).collect() == []


def test_trie_shares_prefixes_and_starts_anew():
    scores, longest, byte_score = T.vocabulary(T.default_model())
    trie = T.Trie(scores, longest, byte_score)
    trie.count("▁interesting")
    size = trie.size
    trie.count("▁interested")
    assert trie.size == size + 2
    small = T.Trie(scores, longest, byte_score, nodes=5)
    for word in ("▁interesting", "▁banana", "▁x", "▁interesting"):
        assert small.count(word) == T.Trie(scores, longest, byte_score).count(word)


# licence scan


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", 1, mit + "\nmore text here"),
        ("a/LICENSE", 2, "\n" + gpl),
        ("a/x.py", 3, "nothing here"),
        ("a/b/c/y.py", 4, "first\nreleased under the mit license\nlast"),
        ("a/b/c/z.py", 5, None),
        ("q/w.py", 6, ""),
        (None, 7, "no place"),
        (None, 8, gpl),
        ("ab/x", 9, "in ab, not in a"),
        ("ab/x", 9, "in ab, not in a"),
        ("t/two", 10, mit + "\n" + gpl),
    ]
    files = spark.createDataFrame(rows, "path string, file long, text string").withColumn("licence", F.lit("clash"))
    got = {(r["path"], r["file"]): (r["licence"], r["origin"], r["from_directory"]) for r in L.license_scan(files.repartition(3)).collect()}
    assert got == {
        ("LICENSE", 1): ("MIT", "own", None),
        ("a/LICENSE", 2): ("GPL-3.0", "own", None),
        ("a/x.py", 3): ("GPL-3.0", "inherited", "a"),
        ("a/b/c/y.py", 4): ("MIT", "own", None),
        ("a/b/c/z.py", 5): ("GPL-3.0", "inherited", "a"),
        ("q/w.py", 6): ("MIT", "inherited", ""),
        (None, 7): (None, "none", None),
        (None, 8): ("GPL-3.0", "own", None),
        ("ab/x", 9): ("MIT", "inherited", ""),
        ("t/two", 10): ("GPL-3.0", "own", None),
    }
    assert L.license_scan(files).count() == len(rows) and L.license_scan(files.limit(0)).collect() == []


def plain_nearest(text, templates, threshold):
    """All windows of all templates with plain counts: {(licence, cosine)} at the threshold or above."""
    bags = [Counter(L._words(t)) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1
    words, near = L._words(text), set()
    for (licence, _), bag in zip(templates, bags):
        norm = math.sqrt(sum((k * idf(w)) ** 2 for w, k in bag.items()))
        for s in range(len(words)):
            window = Counter(words[s : s + sum(bag.values())])
            dot = sum(k * bag[w] * idf(w) ** 2 for w, k in window.items())
            cosine = dot / norm / math.sqrt(sum((k * idf(w)) ** 2 for w, k in window.items()))
            if words[s] in bag and cosine >= threshold:
                near.add((licence, round(cosine, 9)))
    return near


def test_windows_against_plain_counts():
    rng = random.Random(7)
    templates = [("A", "one two two three four"), ("B", "two five"), ("C", "one one six seven three two nine"), (L.FALLBACK, "six")]
    matcher, pool = L.Matcher(templates, 0.8), "one two three four five six seven nine ten eleven".split()
    hits = 0
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\n# ", ", "]) for _ in range(rng.randrange(14)))
        near = plain_nearest(text, templates, 0.8)
        own = {x for x in near if x[0] != L.FALLBACK} or near
        got = matcher.best(text)
        assert (got is None) == (not own)
        if got:
            hits += 1
            assert got[1] == max(c for _, c in own) and (got[0], got[1]) in own
    assert 50 < hits < 400


GNU = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""


def test_headers_and_licence_files():
    matcher, texts = L.Matcher(L.TEMPLATES, 0.8), {}
    for licence, text in L.TEMPLATES:
        texts.setdefault(licence, []).append(text)
    long = {licence: max(own, key=len) for licence, own in texts.items()}
    wrapped = "\n".join("# " + line for line in textwrap.wrap(long["Apache-2.0"], 40))
    code = "\n".join(f"value_{k} = compute(argument_{k}, other_{k})" for k in range(200))
    expected = [
        ('// Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        ("# This file is licensed under the MIT License. See LICENSE for details.", "MIT"),
        ("Copyright 2019 Jane. Released under the MIT License.", "MIT"),
        ("/*\n" + GNU + " */\n" + code, "GPL-2.0"),
        (GNU.replace("version 2", "version 3").replace("GNU General", "GNU Lesser General"), "LGPL-3.0"),
        (wrapped + "\n" + code, "Apache-2.0"),
        ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + long["MIT"].replace("AUTHORS OR", "CONTRIBUTORS, AUTHORS OR"), "MIT"),
        ("Copyright (c) 2001, Someone. All rights reserved.\n\n" + long["BSD-2-Clause"] + "\n" + code, "BSD-2-Clause"),
        ("Copyright (c) 2001, Someone. All rights reserved.\n\n" + long["BSD-3-Clause"].replace("copyright holder nor", "University nor"), "BSD-3-Clause"),
        ("(c) Someone. All Rights Reserved.", "Proprietary"),
        (long["ISC"].lower(), "ISC"),
    ]
    for text, licence in expected:
        assert matcher.best(text)[0] == licence, text
    for text in ("", "\n \n", code, "the licence agreement was released to the public under other terms", "SPDX-License-Identifier: EUPL-1.2"):
        assert matcher.best(text) is None
    # in the middle of a long line or text a notice is no sign of a licence file; very long texts are read whole
    filler = "word " * 300_000
    assert matcher.best(filler + "released under the MIT License. " + filler) == ("MIT", 1.0, False)
    assert matcher.best(filler + "\nReleased under the MIT License.") == ("MIT", 1.0, True)


def test_licence_files_by_name(spark):
    middle = "word " * 50 + "Released under the MIT License. " + "word " * 50
    rows = [("a/LICENSE.txt", 1, middle), ("a/x", 2, "x"), ("b/mylicense", 3, middle), ("b/x", 4, "x")]
    files = spark.createDataFrame(rows, "path string, file int, text string")
    got = {r["file"]: (r["licence"], r["origin"]) for r in L.license_scan(files).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "own"), 4: (None, "none")}


def test_twin_of_the_scan(spark):
    assert compare(QUERIES["op7_license_scan"](spark, FOLDER), duck(FOLDER), SQL["op7_license_scan"]) is None
