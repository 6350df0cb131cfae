"""Dashboard data (P01-P09): KPI cards, stickiness per feature and month,
Monday-week actives, adoption by segment, the customer x feature usage
matrix and its phi-correlation, and the stickiest feature.

All start from the dashboard population: sessions with positive duration
inside the window, optionally restricted to selected features. Rows with a
NULL feature or customer never form a group (as in the dataframe groupby the
dashboard was written with).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.dates import monday_week, month_period
from keelson.functions.numeric import round_to
from keelson.operators.prep import active_sessions, customer_features, daily_monthly_actives, month_masks

DEFAULT_WINDOW = ("2024-01-01", "2024-04-30")


def population(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    return (active_sessions(usage, win, features)
            .filter(F.col("feature").isNotNull() & F.col("customer_id").isNotNull()))


def _ratios(masks: DataFrame) -> DataFrame:
    dm = daily_monthly_actives(masks.filter(F.col("feature").isNotNull()))
    avg_dau = F.col("_dau_sum").cast("double") / F.col("_days").cast("double")
    return dm.select("feature", month_period(F.col("month")).alias("month"), avg_dau.alias("avg_dau"), "mau",
                     (avg_dau / F.col("mau").cast("double")).alias("ratio"))


def stickiness_ratio(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Mean daily actives over monthly actives per feature and month
    (``yyyy-MM``), unrounded. Days without activity do not enter the mean.
    One pass over the sessions (``prep.month_masks``)."""
    return _ratios(month_masks(population(usage, win, features)))


def kpi_cards(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Active users, features used, mean stickiness (3 dp).

    All three come from the day masks of the population, which the sessions are
    scanned and shuffled for once. Users whose sessions name no feature count as
    active users, as the dashboard counts them.
    """
    masks = month_masks(active_sessions(usage, win, features).filter(F.col("customer_id").isNotNull()))
    cards = _ratios(masks).agg(
        F.struct(F.count_distinct("feature").alias("features_used"),
                 round_to(F.avg("ratio"), 3).alias("avg_stickiness")).alias("s")).scalar()
    return (masks.agg(F.count_distinct("customer_id").alias("total_active_users"))
            .withColumn("_s", cards)
            .select("total_active_users", "_s.features_used", "_s.avg_stickiness"))


def weekly_active_iso(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Users per feature and Monday-Sunday week (``start/end`` label)."""
    return (population(usage, win, features)
            .groupBy("feature", monday_week(F.col("session_date")).alias("week"))
            .agg(F.count_distinct("customer_id").alias("users")))


def adoption_by(usage: DataFrame, cust: DataFrame, dim: str, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Users per feature and ``dim``; usage without a customer row or
    with a NULL ``dim`` is dropped."""
    pairs = customer_features(population(usage, win, features))
    c = cust.select("customer_id", dim).filter(F.col(dim).isNotNull())
    return (pairs.join(c, "customer_id")
            .groupBy("feature", dim).agg(F.count_distinct("customer_id").alias("users")))


def usage_matrix(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """The binary customer x feature matrix in long form (used cells only)."""
    return (population(usage, win, features).select("customer_id", "feature").distinct()
            .withColumn("used", F.lit(1)))


def feature_phi(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Pearson correlation of the 0/1 usage columns (phi), full square.

    From counts: ``n`` customers in the matrix, ``n_i`` users of each feature
    and ``n_ij`` users of both; phi is
    ``(n*n_ij - n_i*n_j) / sqrt(n_i(n-n_i) * n_j(n-n_j))``, NULL when a
    feature is used by everyone (a constant column).

    Customers -> their feature set -> distinct sets with a weight -> weighted
    counts of every ordered feature pair, as rows. The diagonal gives ``n_i``;
    the grid of all pairs, zero cells included, is each feature unfolded over
    the list of features (its size is that of the output).
    """
    pop = population(usage, win, features)
    pairs = pop.select("customer_id", "feature").distinct()
    sets = pairs.groupBy("customer_id").agg(F.sort_array(F.collect_list("feature")).alias("fs"))
    weighted = sets.groupBy("fs").agg(F.count(F.lit(1)).alias("w"))
    both = (weighted.select(F.explode("fs").alias("feature_1"), "fs", "w")
            .select("feature_1", F.explode("fs").alias("feature_2"), "w")
            .groupBy("feature_1", "feature_2").agg(F.sum("w").alias("n12")))
    own = both.filter(F.col("feature_1") == F.col("feature_2"))
    names = own.agg(F.sort_array(F.collect_list("feature_1")).alias("names")).scalar()
    n = weighted.agg(F.sum("w").alias("n")).scalar()
    grid = own.select("feature_1", F.col("n12").alias("n1"), F.explode(names).alias("feature_2"))
    g = (grid.join(own.select("feature_2", F.col("n12").alias("n2")), "feature_2")
         .join(both, ["feature_1", "feature_2"], "left")
         .withColumn("n12", F.coalesce("n12", F.lit(0).cast("long"))).withColumn("n", n))
    # products of counts in exact decimal: n * n_ij overflows a long beyond
    # about three billion customers
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("n", "n12", "n1", "n2")}
    num = (wide["n"] * wide["n12"] - wide["n1"] * wide["n2"]).cast("double")
    den = F.sqrt((wide["n1"] * (wide["n"] - wide["n1"])).cast("double")
                 * (wide["n2"] * (wide["n"] - wide["n2"])).cast("double"))
    return g.select("feature_1", "feature_2", F.when(den > 0, num / den).alias("phi"))


def feature_stickiness(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """Mean P02 ratio per feature, stickiest first."""
    return (stickiness_ratio(usage, win, features).groupBy("feature")
            .agg(F.avg("ratio").alias("ratio"))
            .orderBy(F.col("ratio").desc(), F.col("feature")))


def top_feature(usage: DataFrame, win=DEFAULT_WINDOW, features=None) -> DataFrame:
    """The stickiest feature and its ratio (3 dp); ties by feature name."""
    fs = feature_stickiness(usage, win, features).withColumn("_r", round_to(F.col("ratio"), 10))
    return (fs.orderBy(F.col("_r").desc(), F.col("feature").asc()).limit(1)
            .select("feature", round_to(F.col("ratio"), 3).alias("ratio")))
