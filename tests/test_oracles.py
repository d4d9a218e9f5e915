"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import ROOT, compare

from tidegauge import all_queries, oracle_statements

FOLDER = f"{ROOT}/sf0.001"
QUERIES, ORACLES = all_queries(), oracle_statements()
#: whole tree grids without SQL, minutes each whatever the size; test_boosting.py tests their parts
SLOW = {"boosted_trees_oof", "stacking"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, name):
    problem, n = compare(name, QUERIES[name], ORACLES.get(name), spark, FOLDER)
    assert problem is None, problem
    assert n >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
