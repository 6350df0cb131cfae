"""Map the driver's generated tables onto the four-table model.

The test data is a TPC-H-like star schema plus an ``events`` log; the metrics
need customers / feature usage / subscription events / support tickets. The
mapping is a set of projections and joins on the parquet scans, so column
pruning and filter pushdown still reach the files.

Fixed mapping values (they must equal the SQL oracle's views):

- plan by market segment: HOUSEHOLD -> starter, BUILDING -> growth,
  AUTOMOBILE -> pro, anything else -> enterprise
- company size by ``c_nationkey % 4``: 0 -> 1-10, 1 -> 11-50, 2 -> 51-200,
  3 -> 200+
- subscription event by ``o_orderkey % 20``: 0 -> subscription_cancel,
  1 and 2 -> plan_upgrade, 3 -> churn, otherwise renewal
- ticket sentiment by event value: < 10 positive, < 30 neutral, else negative
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources.schema import MONEY

PLAN_BY_SEGMENT = {"HOUSEHOLD": "starter", "BUILDING": "growth", "AUTOMOBILE": "pro"}
PLAN_DEFAULT = "enterprise"
SIZE_BY_NATION_MOD4 = {0: "1-10", 1: "11-50", 2: "51-200", 3: "200+"}


# Columns of the generated tables that the mapping reads. Declaring them
# avoids a footer-reading schema inference per scan, and the scan schema is
# already pruned to what the metrics use.
_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
SCHEMAS = {
    "customer": [("c_custkey", _L), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)],
    "orders": [("o_orderkey", _L), ("o_custkey", _L), ("o_totalprice", _D), ("o_orderdate", _TS)],
    "lineitem": [("l_orderkey", _L), ("l_partkey", _L), ("l_quantity", _D)],
    "part": [("p_partkey", _L), ("p_type", _S), ("p_brand", _S)],
    "events": [("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D)],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One generated table, with the declared (pruned) schema."""
    schema = T.StructType([T.StructField(c, t) for c, t in SCHEMAS[name]])
    return spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_read = read_table


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUST: one row per ``c_custkey``; signup = date of the first order."""
    c = _read(spark, sf_dir, "customer")
    first_order = (_read(spark, sf_dir, "orders")
                   .groupBy(F.col("o_custkey").alias("customer_id"))
                   .agg(F.min(F.col("o_orderdate").cast("date")).alias("signup_date")))
    plan = None
    for seg, p in PLAN_BY_SEGMENT.items():
        cond = F.col("c_mktsegment") == seg
        plan = F.when(cond, p) if plan is None else plan.when(cond, p)
    plan = plan.otherwise(PLAN_DEFAULT)
    size = None
    for k, v in SIZE_BY_NATION_MOD4.items():
        cond = (F.col("c_nationkey") % 4) == k
        size = F.when(cond, v) if size is None else size.when(cond, v)
    base = c.select(
        F.col("c_custkey").alias("customer_id"),
        plan.alias("plan"),
        size.alias("company_size"),
        F.col("c_acctbal").cast(MONEY).alias("mrr"),
    )
    return base.join(first_order, "customer_id", "left")


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UE: the clickstream as daily feature usage (feature = event type)."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("feature"),
        F.col("ts").cast("date").alias("session_date"),
        F.round(F.col("value") * 60).cast("long").alias("duration_seconds"),
    )


def usage_from_orders(spark: SparkSession, sf_dir: str, feature: str = "p_type") -> DataFrame:
    """UO, UB: one usage row per line item; feature = part type or brand, date = order date."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = _read(spark, sf_dir, "part").select("p_partkey", feature)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.col("o_custkey").alias("customer_id"),
        F.col(feature).alias("feature"),
        F.col("o_orderdate").cast("date").alias("session_date"),
        F.round(F.col("l_quantity") * 60).cast("long").alias("duration_seconds"),
    )


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUBS: every order is a subscription event; type by ``o_orderkey % 20``."""
    o = _read(spark, sf_dir, "orders")
    m = F.col("o_orderkey") % 20
    etype = (F.when(m == 0, "subscription_cancel")
             .when(m.isin(1, 2), "plan_upgrade")
             .when(m == 3, "churn")
             .otherwise("renewal"))
    return o.select(
        F.col("o_custkey").alias("customer_id"),
        etype.alias("event_type"),
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("o_totalprice").cast(MONEY).alias("mrr_at_event"),
        F.col("o_orderkey").alias("event_id"),
    )


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIX: ``error`` events are tickets; sentiment from the event value."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    sentiment = (F.when(F.col("value") < 10, "positive")
                 .when(F.col("value") < 30, "neutral")
                 .otherwise("negative"))
    return e.select(
        F.col("user_id").alias("customer_id"),
        sentiment.alias("sentiment"),
        F.col("ts").cast("timestamp_ntz").alias("opened_at"),
    )
