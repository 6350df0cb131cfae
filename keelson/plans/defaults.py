"""Every metric with the original project's default parameters, over a
user's four tables (customers, feature usage, subscription events, support
tickets).

This is the switch-over path for the original workflow: load the CSV
exports, write the health-score table once (as its dashboard script does),
then compute every adoption, health, cohort, value, KPI, statistics and
dashboard result from those tables. ``python -m keelson`` drives it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import adoption, cohorts, dashboard, health, kpis, prep, stats, value
from keelson.sources import io

ADOPTION_WINDOW = ("2024-01-01", "2024-04-30")
SIGNUP_WINDOW = ("2024-01-01", "2024-06-30")
WAU_WINDOW = ("2024-04-01", "2024-04-30")


@dataclass
class UserTables:
    cust: DataFrame
    usage: DataFrame
    subs: DataFrame
    tix: DataFrame
    scores_path: str | None = None
    _scores: DataFrame | None = field(default=None, repr=False)

    @property
    def scores(self) -> DataFrame:
        """The V2 score table; written once to ``scores_path`` and re-read."""
        if self._scores is None:
            s = health.health_scores_v2(self.cust, self.usage, self.subs, self.tix)
            if self.scores_path:
                io.write_scores(s, self.scores_path)
                s = io.read_scores(self.cust.sparkSession, self.scores_path)
            self._scores = s
        return self._scores

    @property
    def buckets(self) -> DataFrame:
        return stats.breadth_bucket(stats.breadth(self.usage, self.cust))


TABLE_NAMES = ("customers", "feature_usage", "subscription_events", "support_tickets")


def report_rejects(spark: SparkSession, data_dir: str, out: str) -> DataFrame:
    """What the four CSV exports hold that ``load`` cannot use, counted by table, column
    and rule; stored in ``out`` and read back."""
    counts = [io.reject_counts(io.rejects(spark, f"{data_dir.rstrip('/')}/{n}.csv", n)).select(F.lit(n).alias("table"), "*") for n in TABLE_NAMES]
    reduce(lambda a, b: a.unionByName(b), counts).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def load(spark: SparkSession, data_dir: str, fmt: str = "csv", store: str | None = None) -> UserTables:
    """With ``store``, text is parsed once: the typed tables are written there
    (usage by month) and every metric scans them. Read ``customers``, ``feature_usage``, ``subscription_events`` and
    ``support_tickets`` (``<name>.csv`` or ``<name>`` folders) from ``data_dir``."""
    ext = ".csv" if fmt == "csv" else ""
    r = {n: io.read_table(spark, f"{data_dir.rstrip('/')}/{n}{ext}", n, fmt=fmt) for n in TABLE_NAMES}
    if store:
        for n, df in r.items():
            usage = n == "feature_usage"
            r[n] = prep.materialize(prep.with_month(df) if usage else df, f"{store.rstrip('/')}/{n}",
                                    ["usage_month"] if usage else (), ("customer_id", "session_date", "feature"))
    return UserTables(r["customers"], r["feature_usage"], r["subscription_events"], r["support_tickets"])


W, S = ADOPTION_WINDOW, SIGNUP_WINDOW
METRICS: dict[str, Callable[[UserTables], DataFrame]] = {
    "s06_active_sessions": lambda t: prep.active_sessions(t.usage, W),
    "s09_usage_daily": lambda t: prep.usage_daily(t.usage),
    "a01_adoption_rate": lambda t: adoption.adoption_rate(t.usage, t.cust, W),
    "a02_dau": lambda t: adoption.dau(t.usage, W),
    "a03_mau": lambda t: adoption.mau(t.usage, W),
    "a04_stickiness": lambda t: adoption.stickiness(t.usage, W),
    "a05_first_use_lag": lambda t: adoption.first_use_lag(t.usage, W),
    "a06_time_to_first_use": lambda t: adoption.time_to_first_use(t.usage, W),
    "a07_power_users": lambda t: adoption.power_users(t.usage, W, 5),
    "a08_activation_rate": lambda t: adoption.activation_rate(t.usage, t.cust, W, 7),
    "a09_weekly_active": lambda t: adoption.weekly_active(t.usage, W),
    "a10_adoption_by_plan": lambda t: adoption.adoption_by(t.usage, t.cust, "plan", W),
    "a11_adoption_by_company_size": lambda t: adoption.adoption_by(t.usage, t.cust, "company_size", W),
    "a12_feature_co_usage": lambda t: adoption.feature_co_usage(t.usage, W),
    "h06_health_raw_v1": lambda t: health.health_raw(t.cust, t.usage, t.subs, t.tix, **health.V1),
    "h07_health_scores_v1": lambda t: health.health_scores_v1(t.cust, t.usage, t.subs, t.tix),
    "h07_health_scores": lambda t: t.scores,
    "c02_cohort_size": lambda t: cohorts.cohort_size(cohorts.cohorts(t.cust, S)),
    "c04_retention_matrix": lambda t: cohorts.retention_matrix(t.cust, t.usage, S),
    "c05_latest_event": lambda t: cohorts.latest_event(cohorts.cohorts(t.cust, S), t.subs),
    "c07_nrr": lambda t: cohorts.nrr(t.cust, t.subs, S),
    "c08_early_late": lambda t: cohorts.early_late(t.cust),
    "c11_adoption_retention": lambda t: cohorts.adoption_retention(t.usage, t.cust),
    "v01_usage_by_tier": lambda t: value.usage_by_tier(t.cust, t.usage),
    "v02_plan_premium_usage": lambda t: value.plan_premium_usage(t.cust, t.usage),
    "v03_pre_upgrade_usage": lambda t: value.pre_event_usage(t.usage, t.subs),
    "v04_upgrade_likelihood": lambda t: value.upgrade_likelihood(t.usage, t.subs),
    "v05_pre_cancel_usage": lambda t: value.pre_event_usage(t.usage, t.subs, value.CANCEL, 30, "churn_users"),
    "v06_feature_abandonment": lambda t: value.feature_abandonment(t.usage, t.subs),
    "v07_wtp_segments": lambda t: value.wtp_segments(t.cust, t.usage),
    "v08_bargain_hunters": lambda t: value.bargain_hunters(t.cust, t.usage),
    "k01_overall_adoption": lambda t: kpis.overall_adoption(t.usage, t.cust),
    "k02_feature_penetration": lambda t: kpis.feature_penetration(t.cust, t.usage),
    "k03_tier_distribution": lambda t: kpis.tier_distribution(t.scores),
    "k04_churn_risk_top": lambda t: kpis.churn_risk_top(t.scores),
    "k05_revenue_by_breadth": lambda t: kpis.revenue_by_breadth(t.cust, t.usage),
    "k06_multi_feature_adoption": lambda t: kpis.multi_feature_adoption(t.usage, t.cust),
    "k07_wau_mau": lambda t: kpis.wau_mau(t.usage, WAU_WINDOW),
    "k08_upgrade_conversion": lambda t: kpis.upgrade_conversion(t.usage, t.subs),
    "k09_avg_health": lambda t: kpis.avg_health(t.scores),
    "k10_breadth_vs_mrr": lambda t: kpis.breadth_vs_mrr(t.cust, t.usage),
    "k11_avg_mrr_by_breadth": lambda t: kpis.avg_mrr_by_breadth(t.cust, t.usage),
    "k12_churn_rate": lambda t: kpis.churn_rate(t.subs, t.cust),
    "t03_mrr_by_bucket": lambda t: stats.mrr_by_bucket(t.buckets),
    "t04_welch_t": lambda t: stats.welch_t(t.buckets),
    "t05_pearson": lambda t: stats.pearson(stats.breadth(t.usage, t.cust)),
    "t07_chi_square": lambda t: stats.chi_square(t.buckets),
    "t08_histogram": lambda t: stats.histogram(t.scores),
    "t09_tier_counts": lambda t: stats.tier_counts(t.scores),
    "t10_tier_means": lambda t: stats.tier_means(t.scores),
    "t11_box_stats": lambda t: stats.box_stats(t.scores),
    "t12_churn_alignment": lambda t: stats.churn_alignment(t.scores, t.subs),
    "p01_kpi_cards": lambda t: dashboard.kpi_cards(t.usage, W),
    "p02_stickiness_ratio": lambda t: dashboard.stickiness_ratio(t.usage, W),
    "p03_weekly_active_iso": lambda t: dashboard.weekly_active_iso(t.usage, W),
    "p04_adoption_by_plan": lambda t: dashboard.adoption_by(t.usage, t.cust, "plan", W),
    "p05_adoption_by_company_size": lambda t: dashboard.adoption_by(t.usage, t.cust, "company_size", W),
    "p06_usage_matrix": lambda t: dashboard.usage_matrix(t.usage, W),
    "p07_feature_phi": lambda t: dashboard.feature_phi(t.usage, W),
    "p08_feature_stickiness": lambda t: dashboard.feature_stickiness(t.usage, W),
    "p09_top_feature": lambda t: dashboard.top_feature(t.usage, W),
}


def run_all(tables: UserTables, out_dir: str, fmt: str = "parquet", only=None) -> list[str]:
    """Compute the selected metrics and write each to ``out_dir/<id>``."""
    out_dir = out_dir.rstrip("/")
    if tables.scores_path is None:
        tables.scores_path = f"{out_dir}/customer_health_scores"
    done = []
    for key, fn in METRICS.items():
        if only and not any(key.startswith(p) for p in only):
            continue
        w = fn(tables).write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(f"{out_dir}/{key}")
        done.append(key)
    return done
