"""The queries that SQL can express against DuckDB, over whole tables."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF01
from keelson.llm.oracles import SQL
from keelson.llm.queries import QUERIES

sys.path.insert(0, os.path.join(ROOT, "scripts"))
from verify_oracles import compare  # noqa: E402


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    assert compare(QUERIES[key](spark, SF01), con, SQL[key]) == []
