"""Divergence of sources against a brute-force version."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import divergence as D
from adspark.llm.queries import QUERIES, SQL
from tests.check_catalog import compare, duck

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        df[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in df:
        kept = {w for w, n in df[lang].items() if n >= min_docs}
        groups = {s: {w: n for w, n in c.items() if w in kept} for (a, s), c in counts.items() if a == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def price(c, w):
            return 1 + 10**9 * (c.get(w, 0) + 2) // (sum(c.values()) + 2 * len(kept))

        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in groups.items():
            pairs = [(-sum(f(price(c, w), price(o, w)) for w in kept), x.encode()) for x, o in groups.items() if x != s]
            terms = [(-f(price(c, w), price(whole, w)), w.encode()) for w in c if price(c, w) > price(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("p", F.lit(1)).withColumn("g", F.lit("x"))
    return sorted(tuple(r) for r in D.source_divergence(docs, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdéÉßXYZ中") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    out = []
    for i in range(220):
        source = rng.choice(["web", "web", "web", "news", "bücher", "zz", None, ""])
        some = words[: 40 if source == "news" else 150]
        out.append((i, rng.choice([" ", ", ", "1", "\n"]).join(rng.choice(some) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), source))
    out += [(900, None, "en", "none"), (901, "", "en", "empty"), (902, "1 2 3 --", "xx", "a"), (903, "rare words", "xx", "b"), (None, "again AGAIN", "de", "web")]
    return out + out[:30] + [(904, "Long " * 60_000 + words[0], "en", "web")]


@pytest.mark.parametrize("min_docs", [1, 10, 10_000])
def test_against_brute_force(spark, rows, min_docs):
    assert run(spark, rows, min_docs=min_docs) == brute(rows, min_docs)


def test_many_sources_in_blocks(spark, rows, monkeypatch):
    more = [(i, t, lang, f"s{i % 11}") for i, (_, t, lang, _) in enumerate(rows)]
    for name, value in (("SOURCES", 3), ("TERMS", 20), ("STRIP", 7), ("HELD", 50)):
        monkeypatch.setattr(D, name, value)
    assert run(spark, more, min_docs=3) == brute(more, 3)


def test_empty_quadrants_are_not_visited():
    rng = np.random.default_rng(2)
    rows, columns = 13, 60
    filled = np.zeros((rows, columns), dtype=bool)
    filled[:3, 20:30] = rng.random((3, 10)) < 0.5
    zero = rng.integers(1, 50, rows)
    p = np.where(filled, rng.integers(50, 10**9, (rows, columns)), zero[:, None])
    pairs = np.triu(np.ones((rows, rows), dtype=bool), 1)
    total, empty = D.traverse(p, zero, filled, pairs)
    for a in range(rows):
        for b in range(a + 1, rows):
            some = filled[a] | filled[b]
            assert empty[a, b] == (~some).sum()
            assert total[a, b] == sum(int((x - y) ** 2 // (x + y)) for x, y in zip(p[a, some].tolist(), p[b, some].tolist()))


def test_terms_do_not_depend_on_the_chunk():
    text = "Äb c1d  EF\x00g-hÉ 中文 " * 50
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    for chunk in (1, 7, 10_000):
        assert [w.decode() for part in D.terms_of(text, chunk) for w in part] == want


def test_probability_of_large_counts(spark):
    n, total, terms = 9 * 10**17, 9 * 10**18, 10**9
    got = spark.range(1).select(D.probability(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_nothing_to_compare(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_twin(spark, folder):
    assert compare(QUERIES["op12_source_divergence"](spark, folder), duck(folder), SQL["op12_source_divergence"]) is None
