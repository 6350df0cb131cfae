"""Hand-made rows for the rules the generated data cannot exercise
(FIXTURES.md section 3). Expected values are worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.operators import adoption, cohorts, dashboard, health, kpis, value
from keelson.sources import schema as S

W24 = ("2024-01-01", "2024-04-30")
D = dt.date


def d(s):
    return None if s is None else dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def tables(spark):
    cust = spark.createDataFrame([
        (1, "starter", "1-10", Decimal("100.00"), d("2024-01-31")),
        (2, "growth", "11-50", Decimal("200.00"), d("2024-01-10")),
        (3, "pro", "51-200", Decimal("300.00"), d("2024-02-01")),
        (4, "starter", "200+", Decimal("50.00"), d("2024-01-01")),
        (5, None, "1-10", Decimal("10.00"), None),
        (6, "enterprise", "11-50", Decimal("500.00"), d("2024-03-15")),
        (7, "growth", "11-50", Decimal("70.00"), d("2024-01-05")),
        (8, "pro", "1-10", Decimal("80.00"), d("2024-01-02")),
    ], S.CUSTOMERS)
    u = [
        # customer 1: month-end signup; use 10 days before signup, on 02-29 and 03-31
        (1, "dashboard", d("2024-01-21"), 100), (1, "dashboard", d("2024-02-29"), 100),
        (1, "reporting", d("2024-03-31"), 100),
        # customer 2: week edges and signup offsets (+30, +31, +60, +90); NULL date row
        (2, "w", d("2023-12-31"), 10), (2, "w", d("2024-01-01"), 10), (2, "w", d("2024-01-07"), 10),
        (2, "x30", d("2024-02-09"), 10), (2, "x31", d("2024-02-10"), 10),
        (2, "x60", d("2024-03-10"), 10), (2, "x90", d("2024-04-09"), 10),
        (2, "w", None, 10),
        # customer 3: last use exactly cancel - 30 for 'a', earlier for 'b'
        (3, "a", d("2024-03-02"), 10), (3, "b", d("2024-02-01"), 10),
        # customer 4: a zero-duration session
        (4, "dashboard", d("2024-02-01"), 0),
        # customer 7: every duration NULL
        (7, "dashboard", d("2024-02-01"), None), (7, "automation", d("2024-02-02"), None),
        # orphan usage (no customer row)
        (99, "dashboard", d("2024-02-01"), 30),
        # customer 8: raw score exactly 32 -> 40.00 (At Risk edge):
        # 10 sessions (2.0) + 25000 s (5.0) + 2 listed features (10) + payment 15
        *[(8, "ai_insights" if i < 5 else "automation", d("2030-01-01") + dt.timedelta(days=i), 2500)
          for i in range(10)],
    ]
    usage = spark.createDataFrame(u, S.FEATURE_USAGE)
    subs = spark.createDataFrame([
        (3, "subscription_cancel", d("2024-04-01"), Decimal("300.00"), 1),
        (3, "subscription_cancel", d("2024-04-20"), Decimal("300.00"), 2),
        (4, "churn", d("2024-03-01"), Decimal("50.00"), 3),
        (8, "renewal", d("2024-03-01"), Decimal("80.00"), 4),
    ], S.SUBSCRIPTION_EVENTS)
    tix = spark.createDataFrame(
        [(3, "negative", None)] * 40 + [(4, "positive", None), (1, None, None), (1, "unknown", None)],
        S.SUPPORT_TICKETS)
    return cust, usage, subs, tix


def as_dict(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_login_all_null_durations_scores_zero(tables):
    cust, usage, subs, tix = tables
    assert as_dict(health.login_score(usage), "customer_id", "login_score")[7] is None
    comp = as_dict(health.health_components(cust, usage, subs, tix), "customer_id", "login_score")
    assert comp[7] == 0


def test_support_score_rules(tables):
    cust, usage, subs, tix = tables
    s = as_dict(health.support_score(tix), "customer_id", "support_score")
    assert s[3] == 5.0          # 40 negative tickets: floor 5
    assert s[4] == 21.5         # one positive ticket: no upper clamp
    assert s[1] == 17.0         # NULL and unknown sentiment count as -2
    comp = as_dict(health.health_components(cust, usage, subs, tix), "customer_id", "support_score")
    assert comp[2] == 0         # no tickets at all: 0, not 20


def test_payment_score_and_presets(tables):
    cust, usage, subs, tix = tables
    v2 = as_dict(health.health_components(cust, usage, subs, tix, **health.V2), "customer_id", "payment_score")
    v1 = as_dict(health.health_components(cust, usage, subs, tix, **health.V1), "customer_id", "payment_score")
    assert v2[2] == 0 and v2[3] == 0 and v2[4] == 15 and v2[8] == 15
    assert v1[3] == 15 and v1[4] == 0


def test_raw_32_is_at_risk_edge(tables):
    cust, usage, subs, tix = tables
    sc = {r["customer_id"]: r for r in health.health_scores_v2(cust, usage, subs, tix).collect()}
    assert sc[8]["health_score"] == 40.0 and sc[8]["health_tier"] == "At Risk"


def test_tier_edges(spark):
    rows = spark.createDataFrame([(Decimal(x),) for x in ("40.00", "40.004", "65.00", "65.01", "85.00", "85.001")],
                                 "s decimal(10,3)")
    got = [r["t"] for r in rows.select(health.tier(F.col("s")).alias("t")).collect()]
    assert got == ["At Risk", "Needs Attention", "Needs Attention", "Healthy", "Healthy", "Champions"]


def test_null_date_only_in_unwindowed_feature_score(tables):
    _, usage, _, _ = tables
    allt = as_dict(health.feature_score(usage, None), "customer_id", "feature_score")
    win = as_dict(health.feature_score(usage, W24), "customer_id", "feature_score")
    # customer 2 has 8 rows, 7 with a date, 6 of them inside Jan-Apr 2024
    assert allt[2] == pytest.approx(8 * 0.2) and win[2] == pytest.approx(6 * 0.2)


def test_orphan_usage_in_a01_not_a10(tables):
    cust, usage, _, _ = tables
    a01 = as_dict(adoption.adoption_rate(usage, cust, W24), "feature", "users_used")
    assert a01["dashboard"] == 4          # customers 1, 4, 7 and orphan 99
    a10 = adoption.adoption_by(usage, cust, "plan", W24).filter(F.col("feature") == "dashboard")
    assert sum(r["users"] for r in a10.collect()) == 3


def test_zero_duration_in_a01_not_in_dashboard(tables):
    _, usage, _, _ = tables
    pairs = dashboard.usage_matrix(usage, W24).filter(F.col("customer_id") == 4).count()
    assert pairs == 0


def test_v01_null_plan_and_plan_without_usage(tables):
    cust, usage, _, _ = tables
    rows = value.usage_by_tier(cust, usage).collect()
    assert all(r["plan"] is not None for r in rows)
    ent = [r for r in rows if r["plan"] == "enterprise"]
    assert [(r["feature"], r["users"], r["usage_pct"]) for r in ent] == [(None, 0, 0.0)]


def test_month_offsets_at_month_end(tables):
    cust, usage, _, _ = tables
    coh = cohorts.cohorts(cust, ("2024-01-01", "2024-06-30"))
    act = cohorts.cohort_activity(coh, usage).filter(F.col("customer_id") == 1)
    assert sorted(r["month_number"] for r in act.collect()) == [0, 2]


def test_signup_offsets_inclusive(tables):
    cust, usage, _, _ = tables
    eb = as_dict(cohorts.early_breadth(usage, cust, 30), "customer_id", "features_used")
    # customer 2 (signup 01-10): the w sessions are before signup, x30 is on +30, x31 on +31
    assert eb[2] == 1
    rf = as_dict(cohorts.retained_flag(usage, cust, 60, 90), "customer_id", "retained_m3")
    assert rf[2] == 1 and rf[5] == 0 and rf[6] == 0
    only_plus31 = usage.filter(~F.col("feature").isin("x60", "x90"))
    assert as_dict(cohorts.retained_flag(only_plus31, cust), "customer_id", "retained_m3")[2] == 0


def test_abandonment_strict_and_counts_each_cancel(tables):
    _, usage, subs, _ = tables
    ab = as_dict(value.feature_abandonment(usage, subs, 30), "feature", "abandoned_users")
    # cancel 04-01: cutoff 03-02 -> 'a' (03-02) not abandoned, 'b' (02-01) abandoned
    # cancel 04-20: cutoff 03-21 -> both abandoned
    assert ab == {"b": 2, "a": 1}


def test_week_systems_differ(tables):
    _, usage, _, _ = tables
    w = usage.filter((F.col("customer_id") == 2) & (F.col("feature") == "w") & F.col("session_date").isNotNull())
    yw = sorted(r["week"] for r in adoption.weekly_active(w, None).collect())
    assert yw == [202353, 202401]
    iso = sorted(r["week"] for r in dashboard.weekly_active_iso(w, None).collect())
    assert iso == ["2023-12-25/2023-12-31", "2024-01-01/2024-01-07"]


def test_phi_null_for_feature_used_by_everyone(spark):
    u = spark.createDataFrame([(1, "all", d("2024-01-02"), 5), (2, "all", d("2024-01-02"), 5),
                               (1, "x", d("2024-01-02"), 5)], S.FEATURE_USAGE)
    phi = {(r["feature_1"], r["feature_2"]): r["phi"] for r in dashboard.feature_phi(u, W24).collect()}
    assert phi[("all", "x")] is None and phi[("all", "all")] is None
    assert phi[("x", "x")] == 1.0


def test_empty_customers_gives_null_pct(spark, tables):
    _, usage, _, _ = tables
    empty = spark.createDataFrame([], S.CUSTOMERS)
    rows = adoption.adoption_rate(usage, empty, W24).collect()
    assert rows and all(r["adoption_rate_pct"] is None and r["total_customers"] == 0 for r in rows)
    assert kpis.overall_adoption(usage, empty).first()["adoption_rate_pct"] is None


def test_pre_event_usage_keeps_null_feature_and_window_edges(spark):
    u = spark.createDataFrame([
        (1, None, d("2024-03-01"), 5),       # NULL feature inside the window
        (1, "a", d("2024-01-31"), 5),        # exactly event - 30: inside
        (1, "b", d("2024-01-30"), 5),        # event - 31: outside
        (1, "c", d("2024-03-01"), 5),        # the event day itself: inside
        (2, "a", d("2024-03-05"), 5),        # after the event: outside
    ], S.FEATURE_USAGE)
    subs = spark.createDataFrame([(1, "plan_upgrade", d("2024-03-01"), Decimal("1.00"), 1),
                                  (2, "plan_upgrade", d("2024-03-01"), Decimal("1.00"), 2)],
                                 S.SUBSCRIPTION_EVENTS)
    got = as_dict(value.pre_event_usage(u, subs), "feature", "users_before_upgrade")
    assert got == {None: 1, "a": 1, "c": 1}


def test_stickiness_day_with_only_null_customer(spark):
    u = spark.createDataFrame([(1, "f", d("2024-01-02"), 5), (None, "f", d("2024-01-03"), 5),
                               (2, "f", d("2024-01-02"), 5)], S.FEATURE_USAGE)
    r = adoption.stickiness(u, W24).first()
    # days with activity: 01-02 (2 users) and 01-03 (0 counted users) -> mean 1.0; MAU 2
    assert (r["avg_dau"], r["mau"], r["dau_mau_ratio"]) == (1.0, 2, 0.5)


def test_welch_with_an_empty_group(spark):
    from keelson.operators import stats
    df = spark.createDataFrame([("Medium", Decimal("10.00")), ("Medium", Decimal("14.00"))],
                               "usage_bucket string, mrr decimal(12,2)")
    r = stats.welch_t(df).first()
    assert (r["n_a"], r["n_b"], r["mean_b"], r["var_b"]) == (0, 2, 12.0, 8.0)
    assert r["t_stat"] is None and r["p_value"] is None
