"""Feature value (V01-V08): usage by plan, premium use by a plan, features
used before upgrades and cancellations, upgrade likelihood, abandonment,
willingness to pay, bargain hunters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import pct, round_to
from keelson.operators.prep import as_rollup, customer_features

UPGRADE = "plan_upgrade"
CANCEL = "subscription_cancel"
STARTER = "starter"
PREMIUM_FEATURES = ("ai_insights", "automation", "reporting", "team_collab")


def _money_avg(col: str):
    return F.try_divide(F.sum(F.col(col).cast("decimal(12,2)")).cast("double"), F.count(col).cast("double"))


def usage_by_tier(cust: DataFrame, usage: DataFrame, pct_col: str = "usage_pct") -> DataFrame:
    """V01 (and K02 with ``pct_col="penetration_pct"``): users per plan and
    feature over the plan's size.

    Customers without usage still produce a (plan, NULL feature, 0) row;
    customers with a NULL plan drop out.
    """
    c = cust.select("customer_id", "plan").filter(F.col("plan").isNotNull())
    size = c.groupBy("plan").agg(F.count(F.lit(1)).alias("total_customers"))
    pairs = customer_features(usage).withColumnRenamed("customer_id", "_uid")
    j = c.join(pairs, c["customer_id"] == pairs["_uid"], "left")
    return (j.groupBy("plan", "feature").agg(F.count_distinct("_uid").alias("users"))
            .join(size, "plan")
            .select("plan", "feature", "users", pct(F.col("users"), F.col("total_customers")).alias(pct_col))
            .orderBy(F.col("plan"), F.col(pct_col).desc()))


def plan_premium_usage(cust: DataFrame, usage: DataFrame, plan: str = STARTER,
                       features=PREMIUM_FEATURES) -> DataFrame:
    """Customers of ``plan`` using any of ``features``, count and % of the plan."""
    members = cust.filter(F.col("plan") == plan).select("customer_id")
    users = (usage.filter(F.col("feature").isin(list(features)))
             .select("customer_id").distinct()
             .join(members, "customer_id"))
    denom = cust.filter(F.col("plan") == plan).agg(F.count(F.lit(1))).scalar()
    return users.agg(F.count_distinct("customer_id").alias("starter_using_premium")).select(
        "starter_using_premium", pct(F.col("starter_using_premium"), denom).alias("pct_starter_premium"))


def pre_event_usage(usage: DataFrame, subs: DataFrame, event_type: str = UPGRADE, days: int = 30,
                    out_col: str = "users_before_upgrade") -> DataFrame:
    """Per feature, customers who used it within ``days`` days up to
    and including an ``event_type`` event.

    The range condition becomes an equi-join: days are cut into stretches of
    ``days + 1``, an event is put in its own stretch and the one before, which
    together hold all of its covered days, and usage (distinct customer,
    feature and day) joins on customer and stretch, with the date range as a
    condition on what meets. An event makes two rows, whatever ``days`` is.
    """
    stretch = lambda d: F.floor(F.unix_date(d) / (days + 1)).cast("long")
    event = F.col("event_date")
    covered = (subs.filter(F.col("event_type") == event_type).select("customer_id", "event_date").distinct()
               .select("customer_id", event, F.explode(F.array(stretch(event), stretch(event) - 1)).alias("_stretch")))
    u = usage.select("customer_id", "feature", "session_date").distinct().withColumn("_stretch", stretch(F.col("session_date")))
    hits = (u.join(covered, ["customer_id", "_stretch"])
            .filter(F.col("session_date").between(F.date_sub(event, days), event))
            .select("customer_id", "feature").distinct())
    return (hits.groupBy("feature").agg(F.count("customer_id").alias(out_col))
            .orderBy(F.col(out_col).desc()))


def upgrade_likelihood(usage: DataFrame, subs: DataFrame, event_type: str = UPGRADE) -> DataFrame:
    """Share of each feature's users who ever upgraded (no time order)."""
    fu = customer_features(usage)
    up = (subs.filter(F.col("event_type") == event_type).select("customer_id").distinct()
          .withColumn("_up", F.lit(1)))
    j = fu.join(up, "customer_id", "left")
    return (j.groupBy("feature")
            .agg(F.count("customer_id").alias("users"),
                 F.count(F.when(F.col("_up") == 1, F.col("customer_id"))).alias("upgraded_users"))
            .withColumn("upgrade_likelihood_pct", pct(F.col("upgraded_users"), F.col("users")))
            .orderBy(F.col("upgrade_likelihood_pct").desc()))


def feature_abandonment(usage: DataFrame, subs: DataFrame, days: int = 30,
                        event_type: str = CANCEL) -> DataFrame:
    """(customer, feature) pairs last used strictly before cancel - ``days``,
    counted once per cancellation (a customer cancelling twice counts twice).

    Cancellations are pre-counted per (customer, day), so the join pairs each
    feature with distinct cancel days only.
    """
    last = usage.groupBy("customer_id", "feature").agg(F.max("session_date").alias("last_used"))
    ch = (subs.filter(F.col("event_type") == event_type)
          .groupBy("customer_id", F.col("event_date").alias("churn_date"))
          .agg(F.count(F.lit(1)).alias("_n")))
    return (last.join(ch, "customer_id")
            .filter(F.col("last_used") < F.date_sub("churn_date", days))
            .groupBy("feature").agg(F.sum("_n").alias("abandoned_users"))
            .orderBy(F.col("abandoned_users").desc()))


def usage_intensity(usage: DataFrame) -> DataFrame:
    """Sessions per customer (``COUNT(*)`` over raw sessions)."""
    return as_rollup(usage).groupBy("customer_id").agg(F.sum("events").alias("total_usage"))


def wtp_segments(cust: DataFrame, usage: DataFrame, hi: int = 100, mid: int = 50) -> DataFrame:
    """Average MRR and customers per plan and usage segment
    (> ``hi`` High, > ``mid`` Medium, else Low; customers without usage excluded)."""
    j = cust.join(usage_intensity(usage), "customer_id")
    seg = (F.when(F.col("total_usage") > hi, "High Usage")
           .when(F.col("total_usage") > mid, "Medium Usage").otherwise("Low Usage"))
    return (j.groupBy("plan", seg.alias("usage_segment"))
            .agg(round_to(_money_avg("mrr"), 2).alias("avg_mrr"), F.count(F.lit(1)).alias("customers"))
            .orderBy("plan"))


def bargain_hunters(cust: DataFrame, usage: DataFrame, plan: str = STARTER, min_usage: int = 50) -> DataFrame:
    """Customers of ``plan`` with more than ``min_usage`` sessions, busiest first."""
    return (cust.filter(F.col("plan") == plan)
            .join(usage_intensity(usage), "customer_id")
            .filter(F.col("total_usage") > min_usage)
            .select("customer_id", "plan", "mrr", "total_usage")
            .orderBy(F.col("total_usage").desc(), F.col("customer_id").asc()))
