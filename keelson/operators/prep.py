"""Shared preparation (S05-S08) and the customer-feature-day rollup.

Usage inputs come in two shapes and every metric accepts both:

- raw sessions: ``customer_id, feature, session_date, duration_seconds``
- the rollup:   ``customer_id, feature, session_date, events, events_pos,
  duration_sum`` (one row per customer, feature and day)

``as_rollup`` turns a raw row into a one-event rollup row with a projection
(no shuffle). Because the rollup is associative, a metric written against the
rollup columns gives the same answer on raw sessions, on a daily rollup and on
any coarser pre-aggregate of it. At scale the rollup is built once, stored
partitioned by month, and every metric reads that far smaller table.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.dates import as_date, lit_date, monday_week, month_period

Window_ = tuple  # (start, end) inclusive; str 'yyyy-MM-dd' or date

ROLLUP_COLUMNS = ("customer_id", "feature", "session_date", "events", "events_pos", "duration_sum")


def is_rollup(usage: DataFrame) -> bool:
    return "events" in usage.columns


def as_rollup(usage: DataFrame) -> DataFrame:
    """Raw sessions -> one-event rollup rows (projection only). Apply window
    filters before this projection: it drops the month partition column."""
    if is_rollup(usage):
        return usage.select(*ROLLUP_COLUMNS)
    d = F.col("duration_seconds")
    return usage.select(
        "customer_id", "feature", "session_date",
        F.lit(1).cast("long").alias("events"),
        F.when(d > 0, 1).otherwise(0).cast("long").alias("events_pos"),
        (d if dict(usage.dtypes)["duration_seconds"].startswith("decimal") else d.cast("long")).alias("duration_sum"),
    )


def usage_daily(usage: DataFrame) -> DataFrame:
    """The customer-feature-day rollup.

    One hash aggregate with map-side partial aggregation: a customer holding a
    third of all sessions contributes at most one row per feature and day per
    map task to the shuffle. NULL keys stay as their own groups, so unwindowed
    counts still see rows whose date failed to parse. ``duration_sum`` stays
    NULL when every duration of the group is NULL.
    """
    r = as_rollup(usage)
    return (r.groupBy("customer_id", "feature", "session_date")
             .agg(F.sum("events").alias("events"),
                  F.sum("events_pos").alias("events_pos"),
                  F.sum("duration_sum").alias("duration_sum")))


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                cluster_by: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Write ``df`` to ``path`` (a shared folder) and read it back.

    Used to cut lineage for tables several metrics reuse (the rollup, the
    score table); a restarted job re-reads the files instead of replaying
    the whole plan, and a lost executor never loses the materialised data.
    With ``partition_by``, rows are range-partitioned on the partition and
    ``cluster_by`` columns first, so each partition value is written as a few
    large files while a large value still spreads over many tasks.
    """
    if partition_by:
        keys = [*partition_by, *[c for c in cluster_by if c in df.columns]]
        df = df.repartitionByRange(*keys)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_month(df: DataFrame, col: str = "session_date", name: str = "usage_month") -> DataFrame:
    """Add a ``yyyy-MM`` partition column for storing the rollup."""
    return df.withColumn(name, F.date_format(F.col(col), "yyyy-MM"))


PARTITION_COLUMN = "usage_month"


def _month_text(d) -> str:
    return as_date(d).strftime("%Y-%m")


def in_window(df: DataFrame, win: Window_ | None, col: str = "session_date") -> DataFrame:
    """Inclusive date-window filter (S05). ``None`` keeps every row.

    Applied to a typed DATE column, so the bounds reach the parquet scan as
    pushed filters. On usage stored partitioned by month (``usage_month``)
    the matching month range is added as a partition filter, so months
    outside the window are never listed or read.
    """
    if win is None:
        return df
    start, end = win
    if col == "session_date" and PARTITION_COLUMN in df.columns:
        df = df.filter(F.col(PARTITION_COLUMN).between(_month_text(start), _month_text(end)))
    return df.filter(F.col(col).between(lit_date(start), lit_date(end)))


def window_flag(win: Window_ | None, col: str = "session_date") -> Column:
    """Boolean column: row inside ``win`` (TRUE everywhere when ``win`` is None)."""
    if win is None:
        return F.lit(True)
    start, end = win
    return F.coalesce(F.col(col).between(lit_date(start), lit_date(end)), F.lit(False))


def select_features(df: DataFrame, features: Iterable[str] | None = None) -> DataFrame:
    """Keep the selected features (S08); ``None`` keeps all."""
    if features is None:
        return df
    return df.filter(F.col("feature").isin(list(features)))


def active_sessions(usage: DataFrame, win: Window_ | None = None,
                    features: Iterable[str] | None = None) -> DataFrame:
    """Sessions with positive duration inside ``win`` (S06, dashboard population).

    Works on raw sessions (``duration_seconds > 0``) and on the rollup
    (``events_pos > 0``).
    """
    df = in_window(usage, win)
    if is_rollup(df):
        df = df.filter(F.col("events_pos") > 0)
    else:
        df = df.filter(F.col("duration_seconds") > 0)
    return select_features(df, features)


def with_periods(df: DataFrame, col: str = "session_date") -> DataFrame:
    """Add ``date``, Monday ``week`` label and ``yyyy-MM`` ``month``."""
    d = F.col(col)
    return df.withColumns({"date": d, "week": monday_week(d), "month": month_period(d)})


def customer_features(usage: DataFrame, win: Window_ | None = None) -> DataFrame:
    """Distinct (customer_id, feature) pairs used inside ``win``.

    The basic pre-aggregate for every "who used what" metric: joins run on
    this instead of on raw sessions, so a hot customer has at most one row
    per feature on the join side. One hash aggregate with map-side combining.
    """
    return in_window(usage, win).select("customer_id", "feature").distinct()


def feature_sets(usage: DataFrame, win: Window_ | None = None) -> DataFrame:
    """One row per customer with the sorted array of features used.

    Sessions are first reduced to distinct pairs by a hash aggregate with
    map-side combining; the array is bounded by the feature catalogue.
    NULL features are dropped, as ``COUNT(DISTINCT feature)`` drops them.
    """
    return (in_window(usage, win).select("customer_id", "feature").distinct()
            .groupBy("customer_id")
            .agg(F.sort_array(F.collect_list("feature")).alias("features")))


def month_masks(usage: DataFrame, win: Window_ | None = None) -> DataFrame:
    """``feature, customer_id, month, days``: the active days of each customer,
    feature and month as the bits of an integer (bit 0: the 1st).

    One hash aggregate, combined map-side: a month of sessions is one row of
    fixed width per task, however many days it has. ``month`` is its first day;
    sessions without a date have a NULL month and no days.
    """
    bit = F.expr("shiftleft(1, dayofmonth(session_date) - 1)")
    return (in_window(usage, win).groupBy("feature", "customer_id", F.trunc("session_date", "MM").alias("month"))
            .agg(F.bit_or(bit).alias("days")))


def daily_monthly_actives(masks: DataFrame) -> DataFrame:
    """Per feature and month of ``month_masks``: the sum of the daily actives,
    the days with activity, and the monthly actives.

    A missing customer is not counted, but its days are days with activity
    (``COUNT(DISTINCT customer_id)`` of such a day is 0).
    """
    active = F.when(F.col("customer_id").isNotNull(), F.bit_count("days")).otherwise(0)
    return masks.filter(F.col("month").isNotNull()).groupBy("feature", "month").agg(
        F.sum(active).alias("_dau_sum"), F.bit_count(F.bit_or("days")).alias("_days"), F.count("customer_id").alias("mau"))


def daily_actives(masks: DataFrame) -> DataFrame:
    """``feature, day, dau`` of ``month_masks``: one counter per day of the month.

    Sessions without a date are one group (a NULL day) per feature."""
    on = lambda mask, i: F.shiftright(mask, i).bitwiseAND(F.lit(1))
    known = F.col("customer_id").isNotNull()
    per = masks.groupBy("feature", "month").agg(
        F.bit_or("days").alias("_any"), F.count("customer_id").alias("_users"),
        *[F.sum(F.when(known, on(F.col("days"), i)).otherwise(0)).alias(f"_d{i}") for i in range(31)])
    days = per.select("feature", "month", "_any", "_users", F.posexplode(F.array(*[F.col(f"_d{i}") for i in range(31)])).alias("_pos", "_n"))
    dated = F.col("month").isNotNull()
    return (days.filter((dated & (F.expr("shiftright(_any, _pos) & 1") == 1)) | (~dated & (F.col("_pos") == 0)))
            .select("feature", F.expr("date_add(month, _pos)").alias("day"), F.when(dated, F.col("_n")).otherwise(F.col("_users")).alias("dau")))
