"""Every registered query against its SQL twin on the smallest tables.

The queries of the document operators have their own tests. QUICK_CATALOG=1 runs every fifth query.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.check_catalog import compare, duck

FOLDER = "/root/testdata/sf0.001"
# statistics per group need groups of some size, and the twins of the permutation tests expect every
# first redraw to be varied
LARGER = "/root/testdata/sf0.01"
ON_LARGER = ("c", "d", "g", "h", "i", "j", "k", "l", "m")
# scenarios too small for the gate are only in the smallest tables
ON_SMALLER = {"d4_scenarios_without_p_value"}
# queries whose right result on the smallest tables is empty
MAY_BE_EMPTY: set[str] = set()

QUERIES = {n: q for n, q in entry.queries().items() if n != "pipeline" and not n.startswith("op")}
TWINS = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}
CHOSEN = sorted(QUERIES)[:: 5 if os.environ.get("QUICK_CATALOG") else 1]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_twin(spark, name):
    folder = LARGER if name.startswith(ON_LARGER) and name not in ON_SMALLER else FOLDER
    df = QUERIES[name](spark, folder)
    if name in TWINS:
        problem = compare(df, duck(folder), TWINS[name])
        assert problem is None or name in MAY_BE_EMPTY and problem.startswith("no rows"), problem
    else:
        assert df.collect()


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "ad_param", "d_mean", "z", "inside"]
