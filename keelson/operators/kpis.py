"""Dashboard KPIs (K01-K12): overall adoption, penetration, score
distribution, churn-risk list, revenue by breadth, multi-feature adoption,
WAU/MAU, upgrade conversion, average score, breadth vs MRR, churn rate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.dates import as_date
from keelson.functions.numeric import pct, round_to, safe_div
from keelson.operators.prep import in_window


def money_avg(c: Column) -> Column:
    """Mean of a DECIMAL(12,2) column from its exact sum, as a double."""
    return safe_div(F.sum(c.cast("decimal(12,2)")), F.count(c))


# ------------------------------------------------------------ score table

def tier_distribution(scores: DataFrame) -> DataFrame:
    """Customers per health tier."""
    return scores.groupBy("health_tier").agg(F.count(F.lit(1)).alias("customers"))


def churn_risk_top(scores: DataFrame, n: int = 100, tier: str = "At Risk") -> DataFrame:
    """The ``n`` lowest-scoring customers of ``tier`` (ties by id).

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each task keeps
    its own top ``n`` and only those reach the final merge.
    """
    return (scores.filter(F.col("health_tier") == tier)
            .orderBy(F.col("health_score").asc(), F.col("customer_id").asc())
            .limit(n)
            .select("customer_id", "health_score", "health_tier"))


def avg_health(scores: DataFrame) -> DataFrame:
    """Mean of the (already rounded) scores, 2 dp."""
    return scores.agg(round_to(money_avg(F.col("health_score")), 2).alias("avg_health_score"))


# ------------------------------------------------------------ usage KPIs

def overall_adoption(usage: DataFrame, cust: DataFrame) -> DataFrame:
    """Customers with any usage, all customer rows, and the share."""
    total = cust.agg(F.count(F.lit(1))).scalar()
    return (usage.agg(F.count_distinct("customer_id").alias("active_customers"))
            .withColumn("total_customers", total)
            .withColumn("adoption_rate_pct", pct(F.col("active_customers"), F.col("total_customers"))))


def feature_penetration(cust: DataFrame, usage: DataFrame) -> DataFrame:
    """V01 under its dashboard name."""
    from keelson.operators.value import usage_by_tier
    return usage_by_tier(cust, usage, pct_col="penetration_pct")


def _breadth(usage: DataFrame) -> DataFrame:
    """Distinct features per customer (NULL features not counted)."""
    return usage.groupBy("customer_id").agg(F.count_distinct("feature").alias("features_used"))


def revenue_by_breadth(cust: DataFrame, usage: DataFrame, hi: int = 5, mid: int = 3) -> DataFrame:
    """Customers and average MRR per breadth bucket (>= ``hi`` High,
    >= ``mid`` Medium, else Low; customers without usage are Low)."""
    j = cust.join(_breadth(usage), "customer_id", "left")
    k = F.coalesce(F.col("features_used"), F.lit(0))
    bucket = (F.when(k >= hi, "High Feature Usage").when(k >= mid, "Medium Feature Usage")
              .otherwise("Low Feature Usage"))
    return (j.groupBy(bucket.alias("feature_bucket"))
            .agg(F.count(F.lit(1)).alias("customers"), round_to(money_avg(F.col("mrr")), 2).alias("avg_mrr")))


def multi_feature_adoption(usage: DataFrame, cust: DataFrame, min_features: int = 2) -> DataFrame:
    """% of all customers using at least ``min_features`` features."""
    total = cust.agg(F.count(F.lit(1))).scalar()
    multi = _breadth(usage).filter(F.col("features_used") >= min_features)
    return multi.agg(pct(F.count_distinct("customer_id"), total).alias("pct_multi_feature_users"))


#: Weeks in one integer.
MASK_WEEKS = 62


def _sunday_week(d) -> int:
    """Number of the week, Sunday to Saturday, of a date (1970-01-01 is a Thursday)."""
    return ((d - date(1970, 1, 1)).days + 4) // 7


def wau_mau(usage: DataFrame, win=("2024-04-01", "2024-04-30")) -> DataFrame:
    """Mean weekly actives (Sunday weeks) over actives of the window, 4 dp.

    Weeks cut by the window edges count as whole weeks. The reference names
    this column ``dau_mau_ratio``; it is a WAU/MAU ratio.

    One pass: each customer's active weeks are the bits of integers, one for
    each ``MASK_WEEKS`` weeks of the window, merged by a hash aggregate.
    """
    start, end = (as_date(x) for x in win)
    first, last = _sunday_week(start), _sunday_week(end)
    week = F.floor((F.unix_date("session_date") + 4) / 7) - first
    parts = range(0, last - first + 1, MASK_WEEKS)
    bit = lambda k: F.expr(f"CASE WHEN _week BETWEEN {k} AND {k + MASK_WEEKS - 1} THEN shiftleft(1L, cast(_week - {k} AS int)) END")
    masks = (in_window(usage, win).withColumn("_week", week).groupBy("customer_id")
             .agg(*[F.bit_or(bit(k)).alias(f"_m{k}") for k in parts]))
    known = F.col("customer_id").isNotNull()
    count = lambda c: F.coalesce(F.bit_count(c), F.lit(0))
    total = masks.agg(F.sum(F.when(known, sum(count(F.col(f"_m{k}")) for k in parts)).otherwise(0)).alias("_active"),
                      sum(count(F.bit_or(f"_m{k}")) for k in parts).alias("_weeks"), F.count("customer_id").alias("_users"))
    return total.select(round_to(safe_div(safe_div(F.col("_active"), F.col("_weeks")), F.col("_users")), 4).alias("wau_mau_ratio"))


def upgrade_conversion(usage: DataFrame, subs: DataFrame) -> DataFrame:
    """% of each feature's users with an upgrade event (equals V04's %)."""
    from keelson.operators.value import upgrade_likelihood
    return upgrade_likelihood(usage, subs).select(
        "feature", F.col("upgrade_likelihood_pct").alias("upgrade_conversion_pct"))


def breadth_vs_mrr(cust: DataFrame, usage: DataFrame, include_id: bool = False) -> DataFrame:
    """One row per customer with usage: features used and MRR."""
    j = _breadth(usage).join(cust.select("customer_id", "mrr"), "customer_id")
    cols = ["customer_id"] if include_id else []
    return j.select(*cols, "features_used", round_to(F.col("mrr"), 2).alias("avg_mrr"))


def avg_mrr_by_breadth(cust: DataFrame, usage: DataFrame) -> DataFrame:
    """Average MRR per number of features used (the documented KPI)."""
    j = _breadth(usage).join(cust.select("customer_id", "mrr"), "customer_id")
    return (j.groupBy("features_used")
            .agg(F.count(F.lit(1)).alias("customers"), round_to(money_avg(F.col("mrr")), 2).alias("avg_mrr"))
            .orderBy("features_used"))


def churn_rate(subs: DataFrame, cust: DataFrame, event_type: str = "subscription_cancel") -> DataFrame:
    """Customers with a ``event_type`` event over all customers, %."""
    total = cust.agg(F.count(F.lit(1))).scalar()
    churned = subs.filter(F.col("event_type") == event_type).agg(
        F.count_distinct("customer_id").alias("churned_customers"))
    return (churned.withColumn("total_customers", total)
            .withColumn("churn_rate_pct", pct(F.col("churned_customers"), F.col("total_customers"))))
