"""Every registered query against its DuckDB SQL oracle at sf0.01."""

import os
import sys

import duckdb
import pytest

from keelson.plans.oracle import SQL as ORACLES
from keelson.plans.registry import QUERIES

from conftest import ROOT, SF01

sys.path.insert(0, os.path.join(ROOT, "scripts"))
from verify_oracles import TABLES, compare  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF01}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF01)
    assert compare(df, con, ORACLES[key]) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
