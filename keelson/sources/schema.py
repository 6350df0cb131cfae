"""Schemas of the four input tables and the derived score table."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
#: Durations in CSV exports may have decimals.
DURATION = T.DecimalType(18, 3)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("plan", T.StringType()),
    T.StructField("company_size", T.StringType()),
    T.StructField("mrr", MONEY),
    T.StructField("signup_date", T.DateType()),
])

FEATURE_USAGE = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("session_date", T.DateType()),
    T.StructField("duration_seconds", T.LongType()),
])

SUBSCRIPTION_EVENTS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("mrr_at_event", MONEY),
    T.StructField("event_id", T.LongType()),
])

SUPPORT_TICKETS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("opened_at", T.TimestampNTZType()),
])

HEALTH_SCORES = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("health_score", T.DoubleType()),
    T.StructField("health_tier", T.StringType()),
])

TABLES = {
    "customers": CUSTOMERS,
    "feature_usage": FEATURE_USAGE,
    "subscription_events": SUBSCRIPTION_EVENTS,
    "support_tickets": SUPPORT_TICKETS,
}

# Columns holding dates as text in the CSV exports, parsed once at ingest.
DATE_COLUMNS = {
    "customers": ["signup_date"],
    "feature_usage": ["session_date"],
    "subscription_events": ["event_date"],
    "support_tickets": [],
}
TIMESTAMP_COLUMNS = {"support_tickets": ["opened_at"]}

# Category columns normalised with trim(lower()) at CSV ingest so that the
# binary comparisons in the metrics behave like a case-insensitive collation.
CATEGORY_COLUMNS = {
    "customers": ["plan"],
    "feature_usage": [],
    "subscription_events": ["event_type"],
    "support_tickets": ["sentiment"],
}
