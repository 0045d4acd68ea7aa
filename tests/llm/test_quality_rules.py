"""Quality rules against a brute-force version and against each order of the cascade."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from adspark.llm import quality_rules as Q
from adspark.llm.queries import QUERIES, SQL
from tests.check_catalog import compare, duck

SPACES = " \t\n\x0b\x0c\r"
ROWS = [
    (1, "one two three four five six seven eight " * 5),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon phi"),
    (3, None),
    (4, ""),
    (5, " \n\t \x0b\x0c\r "),
    (6, "same line\nsame line\n\nother\nsame line\r\n \n \n"),
    (7, "a b c d e f g h " + "x" * 50 + " a b c d e f g h i a b c d e f g h"),
    (8, "no break spaces are\x1cletters # * $ % & | < > # and so on, for as long as it takes to get to twenty words or more"),
    (None, "WE ARE SHOUTING ALL OF THE TIME AND NOBODY SAID THAT WE SHOULD STOP!! " * 2),
    (2, "twice the same id"),
    (9, "stop stop stop stop stop stop stop go go go go go go go we we we we we we we are are are there there there"),
    (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27"),
    (11, "w" * 40 + " " + " ".join("v" * (20 + i) for i in range(25))),
]


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if any(c not in SPACES for c in x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_statistics(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("words", F.lit(1))
    got = sorted(map(tuple, Q.quality_rules(docs).drop("kept").collect()), key=str)
    assert got == sorted([(d, *brute(t)) for d, t in ROWS], key=str)


def test_any_order_gives_the_same_verdict(spark):
    stats = Q.statistics(spark.createDataFrame(ROWS, "doc_id long, text string")).cache()
    rules = Q.default_rules()
    verdicts = set()
    for order in itertools.islice(itertools.permutations(rules), 0, 5040, 1300):
        measured = [Q.Measured(r, 1.0, k) for k, r in enumerate(order)]
        verdicts.add(tuple(r[0] for r in stats.select(Q.cascade(measured)).collect()))
    assert len(verdicts) == 1
    want = [all(not v for v in row) for row in stats.select(Q.base_failed(), *[r.rejects for r in rules]).collect()]
    assert list(verdicts.pop()) == want and True in want


def test_cheap_and_strict_rules_come_first(spark):
    a, b, c = (Q.Measured(Q.Rule(n, F.lit(n == "b")), s, x) for n, s, x in (("a", 1.0, 0.2), ("b", 0.1, 0.1), ("c", 2.0, 0.1)))
    plan = str(Q.cascade([a, b, c]))
    assert [m.rule.name for m in sorted([a, b, c], key=lambda m: -m.worth)] == ["b", "a", "c"] and plan


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_judge(spark, rows):
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(d, 0, 0, 0, 0, 0, True, False) for d, _ in rows]


def test_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(QUERIES["op1_quality_rules"](spark, folder), duck(folder), SQL["op1_quality_rules"]) is None
