"""Feature adoption (A01-A12): reach, stickiness, time to first use, power
users, activation, weekly actives, adoption by segment and co-usage.

Defaults equal the reference's constants (window Jan-Apr 2024, 5 active
days, 7 days to activate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.dates import month_key, yearweek
from keelson.functions.numeric import pct, round_to, safe_div
from keelson.operators.prep import customer_features, daily_actives, daily_monthly_actives, feature_sets, in_window, month_masks

DEFAULT_WINDOW = ("2024-01-01", "2024-04-30")


def total_customers(cust: DataFrame, distinct: bool = True) -> Column:
    """Scalar subquery: number of customers (distinct ids or all rows)."""
    agg = F.count_distinct("customer_id") if distinct else F.count(F.lit(1))
    return cust.agg(agg.alias("n")).scalar()


def adoption_rate(usage: DataFrame, cust: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Per feature, distinct users in the window and their share of all
    customers. Users are not matched against the customer table, so ids
    missing from it still count."""
    users = (in_window(usage, win).groupBy("feature")
             .agg(F.count_distinct("customer_id").alias("users_used")))
    return (users.withColumn("total_customers", total_customers(cust))
                 .withColumn("adoption_rate_pct", pct(F.col("users_used"), F.col("total_customers"))))


def dau(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Daily active users per feature, from the monthly day masks."""
    return daily_actives(month_masks(usage, win))


def mau(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Monthly active users per feature; month is ``yyyy-MM-01`` text."""
    return (month_masks(usage, win).groupBy("feature", "month").agg(F.count("customer_id").alias("mau"))
            .select("feature", month_key(F.col("month")).alias("month"), "mau"))


def stickiness(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Average DAU over the days with activity, MAU, and their ratio.

    One pass over the sessions (``prep.month_masks``). Sessions
    without a feature belong to no row.
    """
    dm = daily_monthly_actives(month_masks(usage.filter(F.col("feature").isNotNull()), win))
    avg_dau = F.col("_dau_sum").cast("double") / F.col("_days").cast("double")
    return dm.select("feature", month_key(F.col("month")).alias("month"),
                     round_to(avg_dau, 2).alias("avg_dau"),
                     "mau",
                     round_to(safe_div(avg_dau, F.col("mau")), 4).alias("dau_mau_ratio"))


def _first_use(usage: DataFrame, win) -> DataFrame:
    return (in_window(usage, win).groupBy("feature", "customer_id")
            .agg(F.min("session_date").alias("first_use")))


def _with_launch(first: DataFrame) -> DataFrame:
    """Attach each feature's first use in the window (its "launch").

    The launches come from the per-customer first uses as one map with an entry
    per feature of the catalogue (a scalar subquery over the same shuffle), so
    no per-customer row is moved by ``feature``. The key is wrapped in a struct,
    which a missing feature may be in.
    """
    launches = first.groupBy("feature").agg(F.min("first_use").alias("launch"))
    entries = F.collect_list(F.struct(F.struct("feature").alias("k"), F.col("launch").alias("v")))
    by_feature = launches.agg(F.map_from_entries(entries).alias("m")).scalar()
    return first.withColumn("launch", F.element_at(by_feature, F.struct("feature")))


def first_use_lag(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Days from the feature's first use in the window to each
    customer's first use of it."""
    return (_with_launch(_first_use(usage, win))
            .select("feature", "customer_id",
                    F.datediff("first_use", "launch").alias("days_to_first_use")))


def time_to_first_use(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Mean of A05 per feature, 4 dp.

    Computed without a join: ``avg(x - min x) = (sum x - n * min x) / n``
    in exact integer arithmetic over epoch days.
    """
    x = F.unix_date(F.col("first_use")).cast("long")
    return (_first_use(usage, win).groupBy("feature")
            .agg(F.sum(x).alias("_s"), F.count(x).alias("_n"), F.min(x).alias("_m"))
            .select("feature",
                    round_to(safe_div(F.col("_s") - F.col("_n") * F.col("_m"), F.col("_n")), 4)
                    .alias("avg_days_to_first_use")))


def power_users(usage: DataFrame, win=DEFAULT_WINDOW, min_days: int = 5) -> DataFrame:
    """Customers with at least ``min_days`` active days in a month,
    counted per feature and month (months without any are absent)."""
    active = month_masks(usage, win).filter(F.coalesce(F.bit_count("days"), F.lit(0)) >= min_days)
    return (active.groupBy("feature", "month").agg(F.count(F.lit(1)).alias("power_users_count"))
            .select("feature", month_key(F.col("month")).alias("month"), "power_users_count"))


def activation_rate(usage: DataFrame, cust: DataFrame, win=DEFAULT_WINDOW, days: int = 7) -> DataFrame:
    """Customers whose first use came within ``days`` of the feature's
    first use; count and share of all customers.

    One chain over the sessions: customers are counted per (feature,
    first-use day), and each feature's days, at most one entry per calendar
    day, are gathered into one array. The launch day and the cut-off are
    applied to that array, so no per-customer row is joined on ``feature``.
    """
    hist = (_first_use(usage, win).groupBy("feature", "first_use")
            .agg(F.count(F.lit(1)).alias("n")))
    per_feature = hist.groupBy("feature").agg(
        F.min("first_use").alias("launch"),
        F.collect_list(F.struct("first_use", "n")).alias("_days"))
    within = F.aggregate(
        F.filter(F.col("_days"), lambda d: F.datediff(d["first_use"], F.col("launch")) <= days),
        F.lit(0).cast("long"), lambda acc, d: acc + d["n"])
    return (per_feature.select("feature", within.alias("activated_users"))
            .filter(F.col("activated_users") > 0)
            .withColumn("activation_rate_pct",
                        pct(F.col("activated_users"), total_customers(cust))))


def weekly_active(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Weekly active users per feature, Sunday weeks (``YEARWEEK``)."""
    return (in_window(usage, win)
            .groupBy("feature", yearweek(F.col("session_date")).alias("week"))
            .agg(F.count_distinct("customer_id").alias("active_users")))


def adoption_by(usage: DataFrame, cust: DataFrame, dim: str, win=DEFAULT_WINDOW) -> DataFrame:
    """Users per ``dim`` (``plan``, ``company_size``) and feature.

    Sessions are reduced to distinct (customer, feature) pairs before the
    inner join, so usage without a customer row drops out and a customer with
    many sessions adds one row per feature to the join.
    """
    pairs = customer_features(usage, win)
    return (pairs.join(cust.select("customer_id", dim), "customer_id")
            .groupBy(dim, "feature").agg(F.count_distinct("customer_id").alias("users")))


#: Features of a set are taken in blocks of so many when pairs are made.
PAIR_BLOCK = 64


def pair_rows(sets: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Rows (feature_1 < feature_2, n) of ``sets`` (features: sorted array, n).

    A blocked sparse product: a set is cut into blocks, every block meets every
    later one and itself, and a pair of blocks is unfolded into rows by two
    explodes, so no array holds more than ``block`` features of either side. The
    pairs of blocks of a set beyond one block are dealt out over the tasks.
    """
    def product(rows: DataFrame) -> DataFrame:
        return (rows.select(F.explode("left").alias("feature_1"), "right", "n")
                .select("feature_1", F.explode("right").alias("feature_2"), "n")
                .filter(F.col("feature_1") < F.col("feature_2")))

    one = sets.filter(F.size("features") <= block).select(F.col("features").alias("left"), F.col("features").alias("right"), "n")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("features") - 1) / block).cast("int"), F.lit(0))),
                      lambda i: F.slice(F.col("features"), i * block + 1, F.lit(block)))
    more = (sets.filter(F.size("features") > block).select(cut.alias("blocks"), "n")
            .select(F.posexplode("blocks").alias("i", "left"), "blocks", "n")
            .select("left", F.explode(F.expr("slice(blocks, i + 1, size(blocks))")).alias("right"), "n"))
    return product(one).unionByName(product(more.repartition("left", "right")))


def feature_co_usage(usage: DataFrame, win=DEFAULT_WINDOW) -> DataFrame:
    """Customers using both features of each pair (``feature_1 < feature_2``).

    Customers are first reduced to their feature set, the sets are counted,
    and pairs are generated per *distinct set* with its count as weight. The
    work is linear in customers; pair generation (``pair_rows``) only touches the
    distinct feature combinations.
    """
    sets = (feature_sets(usage, win).filter(F.col("customer_id").isNotNull())
            .groupBy("features").agg(F.count(F.lit(1)).alias("n")))
    return pair_rows(sets).groupBy("feature_1", "feature_2").agg(F.sum("n").alias("common_users"))
