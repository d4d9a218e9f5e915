"""Queries against their SQL where keys, ties and sums differ from those of the given tables."""

import pandas as pd
import pytest
from oracle import canonical, duck_rows

from tidegauge import all_queries, oracle_statements


@pytest.fixture
def folder(tmp_path):
    """A folder with every table name the SQL side opens; a test overwrites its own."""
    from oracle import TABLES

    for table in TABLES:
        pd.DataFrame({"x": [1]}).to_parquet(tmp_path / f"{table}.parquet")
    return tmp_path


def equal(spark, name, folder):
    frame = all_queries()[name](spark, str(folder))
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == canonical(*duck_rows(oracle_statements()[name], str(folder)))


def test_group_lists_weighs_large_keys_as_its_sql(spark, folder):
    rows = [(9_000_000, 7, "F", 1005.0, "1-URGENT"), (5, 7, "F", 1000.0, "2-HIGH"), (8_000_000, 8, "O", 900.0, "5-LOW"), (8_000_001, 8, "P", 3.0, "5-LOW")]
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]).to_parquet(folder / "orders.parquet")
    equal(spark, "group_lists", folder)
