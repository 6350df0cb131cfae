"""Cohorts and retention.

Month offsets are completed calendar months (``TIMESTAMPDIFF(MONTH)``
semantics): activity in the month before signup truncates to 0 and counts
as month 0.
"""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.dates import as_date, lit_date, month_diff, month_key
from keelson.functions.numeric import pct
from keelson.operators.prep import in_window

DEFAULT_SIGNUP_WINDOW = ("2024-01-01", "2024-06-30")
DEFAULT_SPLIT = "2024-03-01"


def cohorts(cust: DataFrame, win=DEFAULT_SIGNUP_WINDOW) -> DataFrame:
    """Customers who signed up in ``win`` with their ``yyyy-MM-01`` cohort."""
    return (in_window(cust, win, col="signup_date")
            .select("customer_id", "signup_date",
                    month_key(F.col("signup_date")).alias("cohort_month")))


def cohort_size(coh: DataFrame) -> DataFrame:
    """Customers per cohort."""
    return coh.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("total_users"))


def _active_days(usage: DataFrame) -> DataFrame:
    """Distinct (customer, day) pairs: the only part of usage cohorts need.

    Joins run on this reduction, so a customer's many sessions of one day are
    one row, and a hot customer is bounded by the number of days."""
    return usage.select("customer_id", "session_date").distinct()


def cohort_activity(coh: DataFrame, usage: DataFrame) -> DataFrame:
    """Distinct (cohort, customer, month offset) with any activity."""
    a = _active_days(usage)
    return (coh.join(a, "customer_id")
            .select("cohort_month", "customer_id",
                    month_diff(F.col("signup_date"), F.col("session_date")).alias("month_number"))
            .distinct())


def retention_matrix(cust: DataFrame, usage: DataFrame, win=DEFAULT_SIGNUP_WINDOW,
                     months=(0, 1, 2, 3)) -> DataFrame:
    """% of each cohort active in month k, one column ``M<k>`` per k.

    Cohorts without any activity are absent (as with an inner join). The
    distinct activity triples make every conditional count a plain sum (no
    Expand of several DISTINCT aggregates).
    """
    coh = cohorts(cust, win)
    act = cohort_activity(coh, usage)
    counts = act.groupBy("cohort_month").agg(
        *[F.sum(F.when(F.col("month_number") == k, 1).otherwise(0)).alias(f"_m{k}") for k in months])
    return (counts.join(cohort_size(coh), "cohort_month")
            .select("cohort_month",
                    *[pct(F.col(f"_m{k}"), F.col("total_users")).alias(f"M{k}") for k in months])
            .orderBy("cohort_month"))


#: A cohort of so many customers at most, counted, is broadcast to the events.
BROADCAST_CUSTOMERS = 1_000_000
#: An event's order within a customer and month as one decimal: days since the month began (3 digits), id, MRR in hundredths.
_ID_SHIFT, _MONEY_SHIFT, _MONEY_ZERO = Decimal(10 ** 33), Decimal(10 ** 13), Decimal(10 ** 12)


def _event_code(event_id: Column, mrr: Column) -> Column:
    """The id (NULL lowest) and the MRR (NULL lowest) of an event as one number."""
    number = F.when(event_id.isNotNull(), event_id.cast("decimal(20,0)") + F.lit(Decimal(2 ** 63 + 1))).otherwise(F.lit(Decimal(0)))
    cents = F.when(mrr.isNotNull(), (mrr.cast("decimal(12,2)") * 100).cast("decimal(13,0)") + F.lit(_MONEY_ZERO)).otherwise(F.lit(Decimal(0)))
    return (number * F.lit(_MONEY_SHIFT) + cents).cast("decimal(34,0)")


def latest_event(coh: DataFrame, subs: DataFrame) -> DataFrame:
    """The last subscription event per customer and month offset.

    Latest by ``event_date`` then ``event_id`` (same-day ties resolve to the
    larger id, then to the larger MRR). Day, id and MRR are packed into one number of
    fixed width, whose maximum a hash aggregate takes in place.

    A cohort that has been counted to be small is broadcast, so that events of other
    customers never reach a shuffle. Beyond that, events are reduced per customer
    and day first, and joined: a customer with a huge number of events
    reaches the join with at most one row per calendar day.
    """
    events = subs.select("customer_id", "event_date", _event_code(F.col("event_id"), F.col("mrr_at_event")).alias("_code"))
    if coh.limit(BROADCAST_CUSTOMERS + 1).count() <= BROADCAST_CUSTOMERS:
        j = events.join(F.broadcast(coh), "customer_id")
    else:
        j = coh.join(events.groupBy("customer_id", "event_date").agg(F.max("_code").alias("_code")), "customer_id")
    j = j.withColumn("month_number", month_diff(F.col("signup_date"), F.col("event_date")))
    # day 100: the first of the month that the customer's month starts in
    day = F.datediff("event_date", F.add_months(F.to_date("cohort_month"), F.col("month_number"))) + 100
    key = F.coalesce(day, F.lit(0)).cast("decimal(3,0)") * F.lit(_ID_SHIFT) + F.col("_code")
    cents = (F.col("_last") % F.lit(_MONEY_SHIFT)).cast("decimal(14,0)")
    return (j.groupBy("customer_id", "cohort_month", "month_number").agg(F.max(key).alias("_last"))
            .select("customer_id", "cohort_month", "month_number",
                    F.when(cents > 0, ((cents - F.lit(_MONEY_ZERO)) / 100).cast("decimal(12,2)")).alias("mrr_at_event")))


def mrr_pivot(latest: DataFrame, start: int = 0, at: int = 3) -> DataFrame:
    """Per customer, the MRR of the last event in month ``start`` and ``at``."""
    return latest.groupBy("customer_id", "cohort_month").agg(
        F.max(F.when(F.col("month_number") == start, F.col("mrr_at_event"))).alias(f"m{start}"),
        F.max(F.when(F.col("month_number") == at, F.col("mrr_at_event"))).alias(f"m{at}"))


def nrr(cust: DataFrame, subs: DataFrame, win=DEFAULT_SIGNUP_WINDOW, at: int = 3) -> DataFrame:
    """Net revenue retention % per cohort over customers with both a
    month-0 and a month-``at`` event. Only events whose date can lie in one of
    these months are read."""
    if win is not None:
        start, end = (as_date(x) for x in win)
        subs = in_window(subs, (start - timedelta(days=32), end + timedelta(days=31 * (at + 1) + 1)), col="event_date")
    latest = latest_event(cohorts(cust, win), subs)
    piv = mrr_pivot(latest.filter(F.col("month_number").isin(0, at)), 0, at)
    valid = piv.filter(F.col("m0").isNotNull() & F.col(f"m{at}").isNotNull())
    return (valid.groupBy("cohort_month")
            .agg(pct(F.sum(f"m{at}"), F.sum("m0")).alias("NRR_pct"))
            .orderBy("cohort_month"))


def early_late(cust: DataFrame, split=DEFAULT_SPLIT) -> DataFrame:
    """Customers who signed up before ``split`` vs the rest (NULL is late)."""
    t = F.when(F.col("signup_date") < lit_date(split), "Early Cohort").otherwise("Late Cohort")
    return cust.groupBy(t.alias("cohort_type")).agg(F.count(F.lit(1)).alias("users"))


def _signup(cust: DataFrame) -> DataFrame:
    return cust.select("customer_id", "signup_date")


def early_breadth(usage: DataFrame, cust: DataFrame, days: int = 30) -> DataFrame:
    """Distinct features used from signup to signup + ``days`` (inclusive).

    Usage is reduced to distinct (customer, feature, day) before the join.
    """
    u = usage.select("customer_id", "feature", "session_date").distinct()
    s = _signup(cust)
    cond = ((u["customer_id"] == s["customer_id"])
            & u["session_date"].between(s["signup_date"], F.date_add(s["signup_date"], days)))
    return (u.join(s, cond).groupBy(u["customer_id"])
            .agg(F.count_distinct(u["feature"]).alias("features_used")))


def retained_flag(usage: DataFrame, cust: DataFrame, lo: int = 60, hi: int = 90) -> DataFrame:
    """1 when the customer used anything between signup + ``lo`` and
    signup + ``hi`` days, else 0 (every customer gets a row)."""
    a = _active_days(usage)
    s = _signup(cust)
    cond = ((a["customer_id"] == s["customer_id"])
            & a["session_date"].between(F.date_add(s["signup_date"], lo), F.date_add(s["signup_date"], hi)))
    hit = a.join(s, cond).select(a["customer_id"]).distinct().withColumn("_hit", F.lit(1))
    return (s.join(hit, "customer_id", "left")
            .select("customer_id", F.coalesce(F.col("_hit"), F.lit(0)).alias("retained_m3")))


def adoption_retention(usage: DataFrame, cust: DataFrame, min_features: int = 2, days: int = 30,
                       lo: int = 60, hi: int = 90) -> DataFrame:
    """C11: retention of customers who used >= ``min_features`` features early
    ("High Adoption") vs the rest with some early use ("Low Adoption").

    One join of distinct (customer, feature, day) usage with the signup
    dates, then both flags (early breadth as in C09, retained as in C10) as
    conditional aggregates per customer; customers without early use are
    left out.
    """
    u = usage.select("customer_id", "feature", "session_date").distinct()
    s = _signup(cust)
    d, start = F.col("session_date"), F.col("signup_date")
    early = d.between(start, F.date_add(start, days))
    kept = d.between(F.date_add(start, lo), F.date_add(start, hi))
    per = (u.join(s, "customer_id").groupBy("customer_id")
           .agg(F.max(F.when(early, 1)).alias("_early"),
                F.count_distinct(F.when(early, F.col("feature"))).alias("features_used"),
                F.max(F.when(kept, 1).otherwise(0)).alias("retained_m3"))
           .filter(F.col("_early") == 1))
    seg = F.when(F.col("features_used") >= min_features, "High Adoption").otherwise("Low Adoption")
    return (per.groupBy(seg.alias("segment"))
            .agg(F.count(F.lit(1)).alias("users"), F.sum("retained_m3").alias("retained_users"))
            .withColumn("retention_pct", pct(F.col("retained_users"), F.col("users"))))
