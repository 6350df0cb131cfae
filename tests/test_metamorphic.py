"""Metamorphic properties: the rollup path equals the raw path, duplicated
sessions change no distinct-count metric, and related metrics agree."""

import pytest

from keelson.operators import adoption, dashboard, health, kpis, stats, value
from keelson.operators.prep import in_window, usage_daily
from keelson.plans.registry import W24, W99, Tables

from conftest import SF01


def rows(df):
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF01)


USAGE_METRICS = {
    "a01": lambda u, t: adoption.adoption_rate(u, t.cust, W99),
    "a04": lambda u, t: adoption.stickiness(u, W99),
    "a06": lambda u, t: adoption.time_to_first_use(u, W99),
    "a07": lambda u, t: adoption.power_users(u, W99, 2),
    "a09": lambda u, t: adoption.weekly_active(u, W99),
    "a12": lambda u, t: adoption.feature_co_usage(u, W99),
    "h07": lambda u, t: health.health_scores_v2(t.cust, u, t.subs, t.tix),
    "h07v1": lambda u, t: health.health_scores(t.cust, u, t.subs, t.tix, win=W99, churn_type="churn"),
    "v01": lambda u, t: value.usage_by_tier(t.cust, u),
    "v03": lambda u, t: value.pre_event_usage(u, t.subs),
    "v06": lambda u, t: value.feature_abandonment(u, t.subs),
    "v07": lambda u, t: value.wtp_segments(t.cust, u, 50, 30),
    "k05": lambda u, t: kpis.revenue_by_breadth(t.cust, u),
    "t01": lambda u, t: stats.breadth(u, t.cust),
    "p02": lambda u, t: dashboard.stickiness_ratio(u, W99),
    "p07": lambda u, t: dashboard.feature_phi(u, W99),
}


@pytest.mark.parametrize("name", sorted(USAGE_METRICS))
def test_rollup_equals_raw(t, name):
    fn = USAGE_METRICS[name]
    assert rows(fn(t.uo, t)) == rows(fn(usage_daily(t.uo), t))


DISTINCT_METRICS = {
    "a01": lambda u, t: adoption.adoption_rate(u, t.cust, W24),
    "a02": lambda u, t: adoption.dau(u, W24),
    "a03": lambda u, t: adoption.mau(u, W24),
    "a04": lambda u, t: adoption.stickiness(u, W24),
    "a05": lambda u, t: adoption.first_use_lag(u, W24),
    "a06": lambda u, t: adoption.time_to_first_use(u, W24),
    "a07": lambda u, t: adoption.power_users(u, W24, 5),
    "a08": lambda u, t: adoption.activation_rate(u, t.cust, W24),
    "a09": lambda u, t: adoption.weekly_active(u, W24),
    "a10": lambda u, t: adoption.adoption_by(u, t.cust, "plan", W24),
    "a11": lambda u, t: adoption.adoption_by(u, t.cust, "company_size", W24),
    "a12": lambda u, t: adoption.feature_co_usage(u, W24),
    "v01": lambda u, t: value.usage_by_tier(t.cust, u),
    "v02": lambda u, t: value.plan_premium_usage(t.cust, u, "starter", ("click", "view")),
    "v03": lambda u, t: value.pre_event_usage(u, t.subs),
    "v04": lambda u, t: value.upgrade_likelihood(u, t.subs),
    "v05": lambda u, t: value.pre_event_usage(u, t.subs, "subscription_cancel", 30, "n"),
    "v06": lambda u, t: value.feature_abandonment(u, t.subs),
}


@pytest.mark.parametrize("name", sorted(DISTINCT_METRICS))
def test_duplicated_sessions_change_nothing(t, name):
    fn = DISTINCT_METRICS[name]
    assert rows(fn(t.ue, t)) == rows(fn(t.ue.unionAll(t.ue), t))


def test_shuffled_partitioning_changes_nothing(t):
    scores = health.health_scores_v2(t.cust, t.uo, t.subs, t.tix)
    again = health.health_scores_v2(t.cust, t.uo.repartition(13, "feature"), t.subs.repartition(3), t.tix)
    assert rows(scores) == rows(again)


def test_k08_equals_v04(t):
    v04 = {r["feature"]: r["upgrade_likelihood_pct"] for r in value.upgrade_likelihood(t.ub, t.subs).collect()}
    k08 = {r["feature"]: r["upgrade_conversion_pct"] for r in kpis.upgrade_conversion(t.ub, t.subs).collect()}
    assert v04 == k08


def test_tier_counts_cover_all_customers(t):
    scores = health.health_scores_v2(t.cust, t.uo, t.subs, t.tix)
    assert sum(r["customers"] for r in kpis.tier_distribution(scores).collect()) == t.cust.count()


def test_co_usage_matches_pairwise_brute_force(t):
    pairs = in_window(t.uo, W99).select("customer_id", "feature").distinct().toPandas()
    by = pairs.groupby("customer_id")["feature"].apply(set)
    want = {}
    for feats in by:
        for a in feats:
            for b in feats:
                if a < b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    got = {(r["feature_1"], r["feature_2"]): r["common_users"]
           for r in adoption.feature_co_usage(t.uo, W99).collect()}
    assert got == want


def test_phi_matches_numpy(t):
    import numpy as np
    m = (dashboard.usage_matrix(t.uo, W99).toPandas()
         .pivot_table(index="customer_id", columns="feature", values="used", fill_value=0))
    want = np.corrcoef(m.values.T.astype(float))
    got = {(r["feature_1"], r["feature_2"]): r["phi"] for r in dashboard.feature_phi(t.uo, W99).collect()}
    cols = list(m.columns)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            assert got[(a, b)] == pytest.approx(want[i, j], abs=1e-12)


def test_welch_and_pearson_match_numpy(t):
    import numpy as np
    b = stats.breadth_bucket(stats.breadth(t.ub, t.cust), 18, 21).toPandas()
    b["mrr"] = b["mrr"].astype(float)
    hi, me = b[b.usage_bucket == "High"]["mrr"], b[b.usage_bucket == "Medium"]["mrr"]
    va, vb = hi.var(ddof=1), me.var(ddof=1)
    tt = (hi.mean() - me.mean()) / np.sqrt(va / len(hi) + vb / len(me))
    r = stats.welch_t(stats.breadth_bucket(stats.breadth(t.ub, t.cust), 18, 21)).first()
    assert r["t_stat"] == pytest.approx(tt, rel=1e-9)
    assert 0 <= r["p_value"] <= 1
    corr = stats.pearson(stats.breadth(t.ub, t.cust)).first()["corr"]
    assert corr == pytest.approx(np.corrcoef(b.feature_count.astype(float), b.mrr)[0, 1], rel=1e-9)
