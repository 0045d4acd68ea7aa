"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from adspark.llm import simhash as S
from adspark.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=2):
    """Smallest id that links of all pairs reach, by id."""
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= bits and group[a] > group[b]:
                    group[a], changed = group[b], True
    return group


TEXTS = ["", None, "  \n ", "One", "one two", "ONE TWO THREE", "one two three four", "É é É x", "a a a a a a a", "no break is one word", "x " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint_of((text or "").encode()) == slow_fingerprint(text)


def linked(spark, prints, bits=2):
    distinct = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints.values())], "fp long")
    rows = components(S.near_links(distinct, bits)).collect()
    return {r["node"] & (2**64 - 1): r["component"] & (2**64 - 1) for r in rows}


@pytest.mark.parametrize("bits", [0, 2, 3, 5])
@pytest.mark.parametrize("longest", [2000, 3])
def test_links_are_those_of_all_pairs(spark, monkeypatch, bits, longest):
    monkeypatch.setattr(S, "LIST", longest)  # 3: most lists are keyed again
    rng = random.Random(bits)
    prints = {}
    for i in range(60):
        base = rng.getrandbits(64)
        for k in range(4):
            prints[len(prints)] = base
            for _ in range(rng.randint(0, bits + 1)):
                base ^= 1 << rng.randrange(64)
    prints[len(prints)] = 0
    want = classes(prints, bits)
    got = linked(spark, prints, bits)
    assert {frozenset(d for d in prints if want[d] == c) for c in want.values()} == {
        frozenset(d for d in prints if got.get(prints[d], prints[d]) == c) for c in (got.get(p, p) for p in prints.values())
    }


@pytest.mark.parametrize("bits", range(6))
def test_every_linked_pair_meets_in_a_list(bits):
    rng = random.Random(bits)
    first, second = S.index_masks(bits)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for at in rng.sample(range(64), bits):
            b ^= 1 << at
        met = [n for n, m in enumerate(first) if (a ^ b) & m & (2**64 - 1) == 0]
        assert met and all(any((a ^ b) & m & (2**64 - 1) == 0 for m in second[n]) for n in met)
    with pytest.raises(ValueError):
        S.index_masks(6)


def test_links_in_lists_is_exact():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 9, 300).astype(np.uint64))
    key = np.zeros(len(fp), dtype=np.int64)
    a, b = S.links_in_lists(key, key, fp, 2)
    prints = dict(enumerate(fp.tolist()))
    group = {int(x): int(x) for x in fp}
    for x, y in zip(a.tolist(), b.tolist()):
        group[x] = y
    assert len(set(group.values())) == len(set(classes(prints).values()))


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(7, long), (3, long), (3, long), (9, long.upper()), (1, None), (2, ""), (5, " "), (None, long + " end"), (4, "short"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    got = S.near_duplicates(docs.repartition(3)).collect()
    prints = {k: slow_fingerprint(t) for k, (_, t) in enumerate(rows)}
    group = classes(prints)
    want = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in prints if group[j] == group[k] and rows[j][0] is not None]
        want.append((d, f"{prints[k]:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert S.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "cycle", "mixed"])
def test_components(spark, shape):
    n = 300
    edges = {
        "chain": [(i, i + 1) for i in range(n)],
        "star": [(0, i) for i in range(1, n)],
        "cycle": [(i, (i + 1) % n) for i in range(n)],
        "mixed": [(i, i + 2) for i in range(n)] + [(500, 500), (None, 3), (900, 800), (900, 800)],
    }[shape]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = {x: x for e in real for x in e}
    for _ in range(n):
        for a, b in real:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
