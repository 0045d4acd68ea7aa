"""Token ids against the tokenizer itself; packing against its own constraints."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from adspark.llm import packing

ENCODER = packing.WordIds(packing.default_tokenizer())
ODD = "the, cat's <|endoftext|> <|ENDOFTEXT|> É éÉ é Ét ﬁ Ⅷ ½ 12,3 ... !?x ' 's don't «été». \x1c a\x1cb   x y ΣΑΣ İ ß.;,: _a a_ a-b ǅ ʼn 中文。 ...the"


def reference(text: str) -> list[int]:
    return ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def ids(text: str) -> list[int]:
    return np.frombuffer(ENCODER.ids([text.encode()])[0], "<u4").tolist()


def test_odd_words():
    assert ids(ODD) == reference(ODD)
    for word in ODD.split(" "):
        assert ids(word) == reference(word)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abz AZ.,'!é<|>ßÉΣ\n\t01_-")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert ids(text) == reference(text)


def test_words_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    encoder = packing.WordIds(packing.default_tokenizer())
    for text in ("one, two three four. five", "six one five two,", "one two three") * 2:
        assert np.frombuffer(encoder.ids([text.encode()])[0], "<u4").tolist() == reference(text)


def test_pieces(spark):
    long = "word " * 10_000
    rows = [(1, long), (2, None), (3, ""), (4, "short text"), (None, "no id"), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.token_pieces(docs, packing.default_tokenizer(), keep_ids=True).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        by.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for doc, text in rows[:5]:
        whole = [*reference(text or ""), 1]
        pieces = by[doc][:1] if doc == 4 else by[doc]
        assert [i for p in pieces for i in np.frombuffer(p["ids"], "<u4")] == whole
        assert [p["start"] for p in pieces] == list(range(0, len(whole), 4096))
    assert len(by[4]) == 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 3_000)])
def test_every_constraint_holds(rule, limits):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 55, 400))[::-1]
    sequence, offset = packing.best_fit(lengths, packing.Capacity(*limits, rule=rule))
    for s in range(sequence.max() + 1):
        own = lengths[sequence == s]
        assert own.sum() <= limits[0] and len(own) <= limits[1] and (own**2).sum() <= limits[2]
        assert sorted(offset[sequence == s]) == [0, *np.cumsum(own)[:-1]]
    if limits == (100, 100, 10_000) and rule == "norm":
        assert sequence.max() + 1 <= -(-lengths.sum() // 100) + 1


def test_best_fit_takes_the_tightest():
    sequence, _ = packing.best_fit(np.array([70, 60, 40, 30]), packing.Capacity(100, 10, 10**6))
    assert sequence.tolist() == [0, 1, 1, 0]


def test_too_large_a_piece():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([11]), packing.Capacity(10, 1, 1000))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(docs, packing.default_tokenizer())).collect() == []


def test_packed_groups(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (i % 50)) for i in range(600)], "doc_id long, text string")
    packed = packing.pack(packing.token_pieces(docs, packing.default_tokenizer(), limit=256), packing.Capacity(256, 256, 256 * 256), group_tokens=8000)
    rows = packed.collect()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= 256
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert len(used) <= 1.1 * sum(r["length"] for r in rows) / 256
