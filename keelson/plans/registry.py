"""Registered queries: each metric bound to the driver tables and the
fixture parameters of FIXTURES.md section 2.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables; nothing is sampled or capped except where the metric itself is
a top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.dates import parse_date
from keelson.functions.numeric import round_to
from keelson.operators import adoption, cohorts, dashboard, health, kpis, prep, stats, value
from keelson.sources import driver_tables as dt
from keelson.sources import ingest, io, work
from keelson.sources.work import shared_dir

#: Raised by hand when a derived table's definition changes.
DERIVED_VERSION = 1
W24 = ("2024-01-01", "2024-04-30")
W99 = ("1999-01-01", "1999-04-30")
# part types standing in for the "new" features on the order-based usage
NEW_FEATURES_UO = ("ECONOMY", "SMALL", "LARGE", "PROMO")
# brands standing in for the premium features on the brand-based usage
PREMIUM_BRANDS = ("Brand#11", "Brand#22")
USAGE_COLUMNS = ["customer_id", "feature", "session_date", "duration_seconds"]


class Tables:
    """The four-table model over one scale-factor directory.

    Built once from the generated tables and stored in the shared folder
    (``keelson.sources.ingest``); every query scans the stored model. Usage
    is partitioned by month, so windowed metrics prune partitions.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return ingest.model_table(self.spark, self.sf_dir, shared_dir(self.spark), name)

    @cached_property
    def model(self) -> dict[str, DataFrame]:
        return ingest.model_tables(self.spark, self.sf_dir, shared_dir(self.spark))

    @cached_property
    def cust(self) -> DataFrame:
        return self._table("customers")

    @cached_property
    def ue(self) -> DataFrame:
        return self._table("usage_events")

    @cached_property
    def uo(self) -> DataFrame:
        return self._table("usage_orders")

    @cached_property
    def ub(self) -> DataFrame:
        """The line items with the part's brand as feature (25 brands, so that
        breadth differs between customers)."""
        return self._table("usage_brands")

    @cached_property
    def subs(self) -> DataFrame:
        return self._table("subscription_events")

    @cached_property
    def tix(self) -> DataFrame:
        return self._table("support_tickets")

    def persisted(self, name: str, build) -> DataFrame:
        """A table derived from the model, stored next to it and scanned.

        For metrics that take several passes over a derived table: the table
        is computed once, the passes read files, and the lineage is cut, so a
        lost executor recomputes nothing upstream of the written table. The
        table is written once per model and version (the folder is keyed
        by both) and then shared by every query that needs it, the way the
        original's dashboard queries share its materialised score table.
        """
        model = ingest.model_dir(self.spark, self.sf_dir, shared_dir(self.spark))
        path = f"{model}/derived-{DERIVED_VERSION}/{name}"
        return ingest.stored(self.spark, path, build)


def _rounded(df: DataFrame, cols, digits: int) -> DataFrame:
    """Present unrounded double statistics at a fixed precision (exact
    decimal rounding), so engines that differ in the last bit agree."""
    return df.withColumns({c: round_to(df[c], digits) for c in cols})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Callable[[Tables], DataFrame]) -> Query:
        if key in QUERIES:
            raise KeyError(key)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        return run
    return deco


# ------------------------------------------------------------- adoption

@query("a01_adoption_rate")
def _(t: Tables):
    return adoption.adoption_rate(t.uo, t.cust, W99)


@query("a02_dau")
def _(t: Tables):
    return adoption.dau(t.ue, W24)


@query("a03_mau")
def _(t: Tables):
    return adoption.mau(t.ue, W24)


@query("a04_stickiness")
def _(t: Tables):
    return adoption.stickiness(t.ue, W24)


@query("a05_first_use_lag")
def _(t: Tables):
    return adoption.first_use_lag(t.ue, W24)


@query("a06_time_to_first_use")
def _(t: Tables):
    return adoption.time_to_first_use(t.ue, W24)


@query("a07_power_users")
def _(t: Tables):
    return adoption.power_users(t.ue, W24, min_days=5)


@query("a07_power_users_10d")
def _(t: Tables):
    """A07 with the reference's first threshold (10 days)."""
    return adoption.power_users(t.ue, W24, min_days=10)


@query("a08_activation_rate")
def _(t: Tables):
    return adoption.activation_rate(t.ue, t.cust, W24, days=7)


@query("a09_weekly_active")
def _(t: Tables):
    return adoption.weekly_active(t.ue, W24)


@query("a10_adoption_by_plan")
def _(t: Tables):
    return adoption.adoption_by(t.uo, t.cust, "plan", W99)


@query("a11_adoption_by_company_size")
def _(t: Tables):
    return adoption.adoption_by(t.uo, t.cust, "company_size", W99)


@query("a12_feature_co_usage")
def _(t: Tables):
    return adoption.feature_co_usage(t.uo, W99)


# ------------------------------------------------------------- health

def _scores_v2(t: Tables):
    return health.health_scores(t.cust, t.uo, t.subs, t.tix, features=NEW_FEATURES_UO, **health.V2)


def _score_table(t: Tables):
    """The persisted V2 score table, as the original's dashboard and
    validation queries read it (tier counts, risk list, average, histogram,
    tier means, box statistics, churn alignment): written once per model and
    code version into the shared folder, then scanned."""
    return t.persisted("health_scores_v2", lambda: _scores_v2(t))


@query("h01_feature_score")
def _(t: Tables):
    return health.feature_score(t.uo, None)


@query("h01_feature_score_windowed")
def _(t: Tables):
    return health.feature_score(t.uo, W99)


@query("h02_login_score")
def _(t: Tables):
    return health.login_score(t.uo, None)


@query("h03_support_score")
def _(t: Tables):
    return health.support_score(t.tix)


@query("h04_payment_score")
def _(t: Tables):
    return health.payment_score(t.subs, "subscription_cancel")


@query("h04_payment_score_churn")
def _(t: Tables):
    return health.payment_score(t.subs, "churn")


@query("h05_new_feature_score")
def _(t: Tables):
    return health.new_feature_score(t.uo, NEW_FEATURES_UO)


@query("h06_health_raw")
def _(t: Tables):
    return health.health_raw(t.cust, t.uo, t.subs, t.tix, features=NEW_FEATURES_UO, **health.V2)


@query("h07_health_scores")
def _(t: Tables):
    """V2 preset (all time, ``subscription_cancel``): the dashboard's table."""
    return _scores_v2(t)


@query("h07_health_scores_v1")
def _(t: Tables):
    """V1 preset (``churn`` literal, windowed usage scores)."""
    return health.health_scores(t.cust, t.uo, t.subs, t.tix, win=W99, churn_type="churn",
                                features=NEW_FEATURES_UO)


@query("k03_tier_distribution")
def _(t: Tables):
    return kpis.tier_distribution(_score_table(t))


@query("k04_churn_risk_top")
def _(t: Tables):
    return kpis.churn_risk_top(_score_table(t), 100)


@query("k09_avg_health")
def _(t: Tables):
    return kpis.avg_health(_score_table(t))


# ------------------------------------------------------------- cohorts

W95 = ("1995-01-01", "1995-06-30")


@query("c01_cohorts")
def _(t: Tables):
    return cohorts.cohorts(t.cust, W95)


@query("c02_cohort_size")
def _(t: Tables):
    return cohorts.cohort_size(cohorts.cohorts(t.cust, W95))


@query("c03_cohort_activity")
def _(t: Tables):
    return cohorts.cohort_activity(cohorts.cohorts(t.cust, W95), t.uo)


@query("c04_retention_matrix")
def _(t: Tables):
    return cohorts.retention_matrix(t.cust, t.uo, W95)


@query("c04_retention_matrix_m12")
def _(t: Tables):
    """C04 with the documented later months."""
    return cohorts.retention_matrix(t.cust, t.uo, W95, months=(0, 1, 2, 3, 6, 12))


@query("c05_latest_event")
def _(t: Tables):
    return cohorts.latest_event(cohorts.cohorts(t.cust, W95), t.subs)


@query("c06_mrr_pivot")
def _(t: Tables):
    return cohorts.mrr_pivot(cohorts.latest_event(cohorts.cohorts(t.cust, W95), t.subs))


@query("c07_nrr")
def _(t: Tables):
    return cohorts.nrr(t.cust, t.subs, W95, at=3)


@query("c08_early_late")
def _(t: Tables):
    return cohorts.early_late(t.cust, "1995-06-01")


@query("c09_early_breadth")
def _(t: Tables):
    return cohorts.early_breadth(t.uo, t.cust, 30)


@query("c10_retained_flag")
def _(t: Tables):
    return cohorts.retained_flag(t.uo, t.cust, 60, 90)


@query("c11_adoption_retention")
def _(t: Tables):
    return cohorts.adoption_retention(t.uo, t.cust, 2)


# ------------------------------------------------------------- feature value

@query("v01_usage_by_tier")
def _(t: Tables):
    return value.usage_by_tier(t.cust, t.ub)


@query("v02_plan_premium_usage")
def _(t: Tables):
    return value.plan_premium_usage(t.cust, t.ub, "starter", PREMIUM_BRANDS)


@query("v03_pre_upgrade_usage")
def _(t: Tables):
    return value.pre_event_usage(t.uo, t.subs, "plan_upgrade", 30, "users_before_upgrade")


@query("v04_upgrade_likelihood")
def _(t: Tables):
    return value.upgrade_likelihood(t.ub, t.subs)


@query("v05_pre_cancel_usage")
def _(t: Tables):
    return value.pre_event_usage(t.uo, t.subs, "subscription_cancel", 30, "churn_users")


@query("v06_feature_abandonment")
def _(t: Tables):
    return value.feature_abandonment(t.uo, t.subs, 30)


@query("v07_wtp_segments")
def _(t: Tables):
    return value.wtp_segments(t.cust, t.uo, hi=50, mid=30)


@query("v08_bargain_hunters")
def _(t: Tables):
    return value.bargain_hunters(t.cust, t.uo, "starter", 50)


# ------------------------------------------------------------- KPIs

@query("k01_overall_adoption")
def _(t: Tables):
    return kpis.overall_adoption(t.ub, t.cust)


@query("k02_feature_penetration")
def _(t: Tables):
    return kpis.feature_penetration(t.cust, t.ub)


@query("k05_revenue_by_breadth")
def _(t: Tables):
    return kpis.revenue_by_breadth(t.cust, t.ub, hi=22, mid=19)


@query("k06_multi_feature_adoption")
def _(t: Tables):
    return kpis.multi_feature_adoption(t.ub, t.cust, 20)


@query("k07_wau_mau")
def _(t: Tables):
    return kpis.wau_mau(t.uo, ("1999-04-01", "1999-04-30"))


@query("k08_upgrade_conversion")
def _(t: Tables):
    return kpis.upgrade_conversion(t.ub, t.subs)


@query("k10_breadth_vs_mrr")
def _(t: Tables):
    return kpis.breadth_vs_mrr(t.cust, t.ub)


@query("k11_avg_mrr_by_breadth")
def _(t: Tables):
    return kpis.avg_mrr_by_breadth(t.cust, t.ub)


@query("k12_churn_rate")
def _(t: Tables):
    return kpis.churn_rate(t.subs, t.cust)


# ------------------------------------------------------------- statistics

def _bucketed(t: Tables):
    return stats.breadth_bucket(stats.breadth(t.ub, t.cust), lo=18, mid=21)


@query("t01_breadth")
def _(t: Tables):
    return stats.breadth(t.ub, t.cust)


@query("t02_breadth_bucket")
def _(t: Tables):
    return _bucketed(t).select("customer_id", "feature_count", "usage_bucket", "mrr")


@query("t03_mrr_by_bucket")
def _(t: Tables):
    return stats.mrr_by_bucket(_bucketed(t))


@query("t04_welch_t")
def _(t: Tables):
    """Welch statistics (6 dp); the p-value is in ``t04_welch_t_pvalue``."""
    s = stats.welch_stats(_bucketed(t), "usage_bucket", "High", "Medium", "mrr")
    return _rounded(s, ["mean_a", "mean_b", "var_a", "var_b", "t_stat", "dof"], 6)


@query("t04_welch_t_pvalue")
def _(t: Tables):
    """The full test including the p-value and the verdict (6 dp)."""
    s = stats.welch_t(_bucketed(t), "usage_bucket", "High", "Medium", "mrr")
    return _rounded(s, ["mean_a", "mean_b", "var_a", "var_b", "t_stat", "dof", "p_value"], 6)


@query("t05_pearson")
def _(t: Tables):
    return _rounded(stats.pearson(_bucketed(t), "feature_count", "mrr"), ["corr"], 10)


@query("t06_contingency")
def _(t: Tables):
    return stats.contingency(_bucketed(t), "usage_bucket", "mrr")


@query("t07_chi_square")
def _(t: Tables):
    """Chi-square statistic and dof (6 dp); the p-value is in ``t07_chi_square_pvalue``."""
    return _rounded(stats.chi_square_stats(_bucketed(t), "usage_bucket", "mrr"), ["chi2"], 6)


@query("t07_chi_square_pvalue")
def _(t: Tables):
    """The full test including the p-value and the verdict (6 dp)."""
    return _rounded(stats.chi_square(_bucketed(t), "usage_bucket", "mrr"), ["chi2", "p_value"], 6)


@query("t08_histogram")
def _(t: Tables):
    return _rounded(stats.histogram(_score_table(t), "health_score", 50), ["bin_lo", "bin_hi"], 10)


@query("t09_tier_counts")
def _(t: Tables):
    return stats.tier_counts(_score_table(t))


@query("t10_tier_means")
def _(t: Tables):
    return stats.tier_means(_score_table(t))


@query("t11_box_stats")
def _(t: Tables):
    cols = ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]
    return _rounded(stats.box_stats(_score_table(t), "health_tier", "health_score"), cols, 6)


@query("t12_churn_alignment")
def _(t: Tables):
    return stats.churn_alignment(_score_table(t), t.subs)


# ------------------------------------------------------------- dashboard

@query("p01_kpi_cards")
def _(t: Tables):
    return dashboard.kpi_cards(t.ue, W24)


@query("p02_stickiness_ratio")
def _(t: Tables):
    return dashboard.stickiness_ratio(t.ue, W24)


@query("p03_weekly_active_iso")
def _(t: Tables):
    return dashboard.weekly_active_iso(t.ue, W24)


@query("p04_adoption_by_plan")
def _(t: Tables):
    return dashboard.adoption_by(t.uo, t.cust, "plan", W99)


@query("p05_adoption_by_company_size")
def _(t: Tables):
    return dashboard.adoption_by(t.uo, t.cust, "company_size", W99)


@query("p06_usage_matrix")
def _(t: Tables):
    return dashboard.usage_matrix(t.uo, W99)


@query("p07_feature_phi")
def _(t: Tables):
    return _rounded(dashboard.feature_phi(t.uo, W99), ["phi"], 10)


@query("p08_feature_stickiness")
def _(t: Tables):
    return _rounded(dashboard.feature_stickiness(t.ue, W24), ["ratio"], 10)


@query("p09_top_feature")
def _(t: Tables):
    return dashboard.top_feature(t.ue, W24)


# ------------------------------------------------------------- sources and preparation

@query("s01_customers")
def _(t: Tables):
    return t.cust


@query("s01_feature_usage")
def _(t: Tables):
    return t.uo.select(*USAGE_COLUMNS)


@query("s01_subscription_events")
def _(t: Tables):
    return t.subs


@query("s01_support_tickets")
def _(t: Tables):
    return t.tix


def _exported(t: Tables, df: DataFrame) -> str:
    """``df`` as CSV text with a header, in a fresh folder of the shared one."""
    path = work.fresh(t.spark, "csv")
    df.write.option("header", True).csv(path)
    return path


@query("s01_csv_customers")
def _(t: Tables):
    """S01 over a CSV export of all customers: text ids, columns in another
    order, one-digit months, and no date for each 97th customer."""
    day = F.when(F.col("customer_id") % 97 == 0, "n/a").otherwise(F.date_format("signup_date", "yyyy-M-d"))
    text = t.cust.select("mrr", day.alias("signup_date"), F.upper("plan").alias("plan"), "company_size",
                         F.format_string("C%06d", "customer_id").alias("customer_id"))
    back = io.read_table(t.spark, _exported(t, text), "customers")
    return back.withColumn("mrr", F.col("mrr").cast("double"))


@query("s01_csv_feature_usage")
def _(t: Tables):
    """S01 over a CSV export of all usage, with decimal durations."""
    text = t.uo.select("feature", (F.col("duration_seconds").cast("decimal(18,3)") / 8).cast("decimal(18,3)").alias("duration_seconds"),
                       F.format_string("C%06d", "customer_id").alias("customer_id"),
                       F.date_format("session_date", "yyyy-M-d HH:mm").alias("session_date"))
    back = io.read_table(t.spark, _exported(t, text), "feature_usage")
    return back.withColumn("duration_seconds", F.col("duration_seconds").cast("double"))


@query("s01_parquet_feature_usage")
def _(t: Tables):
    """S01 over a parquet export of all usage, with decimal durations and dates as text."""
    path = work.fresh(t.spark, "parquet")
    t.uo.select("customer_id", "feature", (F.col("duration_seconds").cast("decimal(18,3)") / 8).cast("decimal(18,3)").alias("duration_seconds"),
                F.date_format("session_date", "yyyy-M-d HH:mm").alias("session_date")).write.parquet(path)
    back = io.read_table(t.spark, path, "feature_usage", "parquet")
    return back.withColumn("duration_seconds", F.col("duration_seconds").cast("double"))


@query("s01_rejects")
def _(t: Tables):
    """What a CSV export of all usage with damaged cells and short records rejects, by
    column and rule."""
    c, cell = F.col("customer_id"), lambda every, bad, good: F.when(F.col("customer_id") % every == 0, F.lit(bad)).otherwise(good)
    whole = F.concat_ws(",", cell(83, " ", F.format_string("C%06d", c)), "feature", cell(97, "2024-13-01", F.date_format("session_date", "yyyy-M-d")),
                        cell(89, "12s", F.col("duration_seconds").cast("string")))
    short = F.concat_ws(",", cell(83, " ", F.format_string("C%06d", c)), "feature")
    line = F.when(c % 79 == 0, short).otherwise(whole)
    path = work.fresh(t.spark, "csv")
    # one text column whose name is the header; no cell holds the separator, so nothing is quoted
    text = t.uo.select(line.alias("customer_id,feature,session_date,duration_seconds"))
    text.write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).csv(path)
    return io.reject_counts(io.rejects(t.spark, path, "feature_usage")).withColumnRenamed("column", "column_name")


@query("s02_read_scores_csv")
def _(t: Tables):
    """S02 over a CSV export of the score table."""
    return io.read_scores(t.spark, _exported(t, _score_table(t).select("health_tier", "customer_id", "health_score")), "csv")


@query("s03_health_scores_table")
def _(t: Tables):
    """S03 then S02: write the score table to a fresh folder (readers of an
    earlier one are not disturbed), read it back."""
    path = work.fresh(t.spark, "scores")
    io.write_scores(_scores_v2(t), path)
    return io.read_scores(t.spark, path)


@query("s04_parse_dates")
def _(t: Tables):
    """S04 over a whole table: order timestamps exported as text
    (``yyyy-MM-dd HH:mm:ss``) and parsed back to dates."""
    o = dt.read_table(t.spark, t.sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", parse_date(text).alias("order_date"))


@query("s05_in_window")
def _(t: Tables):
    return prep.in_window(t.ue, W24).select(*USAGE_COLUMNS)


@query("s06_active_sessions")
def _(t: Tables):
    return prep.active_sessions(t.ue, W24).select(*USAGE_COLUMNS)


@query("s07_with_periods")
def _(t: Tables):
    return prep.with_periods(prep.active_sessions(t.ue, W24)).select(*USAGE_COLUMNS, "date", "week", "month")


@query("s08_select_features")
def _(t: Tables):
    return prep.select_features(prep.in_window(t.ue, W24), ["click", "view"]).select(*USAGE_COLUMNS)


@query("s09_usage_daily")
def _(t: Tables):
    """The customer-feature-day rollup every usage metric can run on."""
    return prep.usage_daily(t.uo)
