"""Counts measured independently on the sf0.01 fixture (FIXTURES.md section 2)."""

import pytest

from keelson.plans.registry import QUERIES

from conftest import SF01


def q(spark, key):
    return QUERIES[key](spark, SF01)


def test_tier_counts(spark):
    got = {r["health_tier"]: r["customers"] for r in q(spark, "k03_tier_distribution").collect()}
    assert got == {"At Risk": 127, "Needs Attention": 1001, "Healthy": 359, "Champions": 13}


def test_early_late_and_churn_rate(spark):
    got = {r["cohort_type"]: r["users"] for r in q(spark, "c08_early_late").collect()}
    assert got == {"Early Cohort": 677, "Late Cohort": 823}
    k12 = q(spark, "k12_churn_rate").first()
    assert (k12["churned_customers"], k12["total_customers"]) == (588, 1500)


def test_starter_premium(spark):
    r = q(spark, "v02_plan_premium_usage").first()
    assert (r["starter_using_premium"], r["pct_starter_premium"]) == (270, 93.43)


def test_upgrade_by_brand(spark):
    r = [x for x in q(spark, "v04_upgrade_likelihood").collect() if x["feature"] == "Brand#11"][0]
    assert (r["users"], r["upgraded_users"], r["upgrade_likelihood_pct"]) == (1099, 732, 66.61)


def test_breadth_over_all_usage(spark):
    t01 = q(spark, "t01_breadth")
    assert t01.count() == 1500
    dist = {r["feature_count"]: r["count"] for r in t01.groupBy("feature_count").count().collect()}
    assert (min(dist), max(dist)) == (3, 25) and [dist[k] for k in (18, 19, 20, 21, 22)] == [123, 179, 203, 194, 139]
    buckets = {r["usage_bucket"]: r["count"] for r in q(spark, "t02_breadth_bucket").groupBy("usage_bucket").count().collect()}
    assert buckets == {"Low": 531, "Medium": 576, "High": 393}


def test_a12_pairs_and_v01_rows(spark):
    a12 = q(spark, "a12_feature_co_usage").collect()
    assert len(a12) == 15 and all(164 <= r["common_users"] <= 202 for r in a12)
    v01 = q(spark, "v01_usage_by_tier").collect()
    assert len(v01) == 100 and not any(r["feature"] is None for r in v01)


def test_k07_and_pre_event_pairs(spark):
    assert q(spark, "k07_wau_mau").first()["wau_mau_ratio"] == pytest.approx(0.2064)
    assert sum(r["users_before_upgrade"] for r in q(spark, "v03_pre_upgrade_usage").collect()) == 3615
    assert sum(r["churn_users"] for r in q(spark, "v05_pre_cancel_usage").collect()) == 2076


def test_adoption_retention_segments(spark):
    got = {r["segment"]: (r["users"], r["retained_users"]) for r in q(spark, "c11_adoption_retention").collect()}
    assert got == {"High Adoption": (1349, 154), "Low Adoption": (126, 15)}


def test_bargain_hunters_and_wtp(spark):
    assert q(spark, "v08_bargain_hunters").count() == 74
    seg = {}
    for r in q(spark, "v07_wtp_segments").collect():
        seg[r["usage_segment"]] = seg.get(r["usage_segment"], 0) + r["customers"]
    assert seg == {"High Usage": 330, "Medium Usage": 769, "Low Usage": 401}


def test_power_users_thresholds(spark):
    five = [r["power_users_count"] for r in q(spark, "a07_power_users").collect()]
    ten = [r["power_users_count"] for r in q(spark, "a07_power_users_10d").collect()]
    assert all(148 <= n <= 150 for n in five) and all(100 <= n <= 109 for n in ten)


def test_revenue_by_breadth_active_buckets(spark):
    got = {r["feature_bucket"]: r["customers"] for r in q(spark, "k05_revenue_by_breadth").collect()}
    assert got == {"High Feature Usage": 393, "Medium Feature Usage": 576, "Low Feature Usage": 531}


def test_cohorts_and_nrr_pairs(spark):
    sizes = [r["total_users"] for r in q(spark, "c02_cohort_size").collect()]
    assert len(sizes) == 6 and all(100 <= n <= 177 for n in sizes)
    piv = q(spark, "c06_mrr_pivot").filter("m0 IS NOT NULL AND m3 IS NOT NULL")
    assert piv.count() == 94


def test_abandonment_and_activation_ranges(spark):
    ab = [r["abandoned_users"] for r in q(spark, "v06_feature_abandonment").collect()]
    assert all(51 <= n <= 83 for n in ab)
    act = [r["activated_users"] for r in q(spark, "a08_activation_rate").collect()]
    assert all(142 <= n <= 148 for n in act)


def test_stickiness_and_weekly_ranges(spark):
    ratios = [r["dau_mau_ratio"] for r in q(spark, "a04_stickiness").collect()]
    assert all(0.356 <= round(x, 3) <= 0.359 for x in ratios)   # FIXTURES quotes 3 dp
    wau = [r["active_users"] for r in q(spark, "a09_weekly_active").collect()]
    assert all(103 <= n <= 146 for n in wau)


def test_adoption_rate_range_and_window_rows(spark):
    rows = q(spark, "a01_adoption_rate").collect()
    assert all(310 <= r["users_used"] <= 345 and 20.67 <= r["adoption_rate_pct"] <= 23.00 for r in rows)
    from keelson.plans.registry import Tables
    assert Tables(spark, SF01).ub.count() == 60000
    assert q(spark, "k06_multi_feature_adoption").first()[0] == pytest.approx(52.67)
    assert q(spark, "t05_pearson").first()["corr"] == pytest.approx(-0.0193105455, abs=1e-9)
