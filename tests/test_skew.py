"""Hot-key correctness: one customer holds half of all events, orders and
line items. Every query with a SQL oracle must still match it, with AQE's
skew handling made aggressive so the split-partition join paths run."""

import os
import sys

import duckdb
import pytest

from keelson.plans.oracle import SQL as ORACLES
from keelson.plans.registry import QUERIES

from conftest import ROOT, SF01

sys.path.insert(0, os.path.join(ROOT, "scripts"))
from verify_oracles import TABLES, compare  # noqa: E402

HOT = 7


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    src = {t: f"{SF01}/{t}.parquet" for t in TABLES}
    copies = {
        # every row again, re-keyed to the hot customer
        "events": f"""SELECT * FROM read_parquet('{src["events"]}') UNION ALL
                      SELECT event_id + 1000000000, ts, {HOT}, event_type, value, props
                      FROM read_parquet('{src["events"]}')""",
        "orders": f"""SELECT * FROM read_parquet('{src["orders"]}') UNION ALL
                      SELECT o_orderkey + 1000000000, {HOT}, o_orderstatus, o_totalprice, o_orderdate,
                             o_orderpriority
                      FROM read_parquet('{src["orders"]}')""",
        "lineitem": f"""SELECT * FROM read_parquet('{src["lineitem"]}') UNION ALL
                        SELECT l_orderkey + 1000000000, l_partkey, l_suppkey, l_linenumber, l_quantity,
                               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
                        FROM read_parquet('{src["lineitem"]}')""",
    }
    for t in ("customer", "part"):
        copies[t] = f"SELECT * FROM read_parquet('{src[t]}')"
    for t, sql in copies.items():
        con.sql(f"COPY ({sql}) TO '{out}/{t}.parquet' (FORMAT PARQUET)")
    return str(out)


@pytest.fixture(scope="module")
def con(skewed_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{skewed_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def skew_conf(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_customer_holds_half(con):
    hot, total = con.sql(f"SELECT SUM(CASE WHEN user_id = {HOT} THEN 1 ELSE 0 END), COUNT(*) FROM events").fetchall()[0]
    assert hot * 2 >= total


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle_under_skew(spark, con, skewed_dir, skew_conf, key):
    df = QUERIES[key](spark, skewed_dir)
    assert compare(df, con, ORACLES[key]) == []
