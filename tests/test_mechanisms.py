"""Day masks, packed event keys, ranks by ranges, blocked pairs, exact moments: on rows that the generated tables do not hold."""

import contextlib
import datetime as dt
import io
import itertools
import random
import statistics
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import adoption, cohorts, dashboard, kpis, prep, stats
from keelson.plans.registry import QUERIES
from keelson.sources import work

from conftest import SF01

USAGE = "customer_id string, feature string, session_date date, duration_seconds bigint"


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(4)
    days = [d("2023-12-25") + dt.timedelta(days=k) for k in range(140)] + [None]
    return [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None]), rng.choice(days), rng.choice([0, 5, None])) for _ in range(900)]


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def users(rows):
    return len({r[0] for r in rows if r[0] is not None})


@pytest.mark.parametrize("win", [None, ("2024-01-01", "2024-04-30")])
def test_daily_and_monthly_actives_against_sets(spark, sessions, win):
    usage = spark.createDataFrame(sessions, USAGE)
    rows = [r for r in sessions if win is None or (r[2] and d(win[0]) <= r[2] <= d(win[1]))]
    day = {k: users(v) for k, v in groups(rows, lambda r: (r[1], r[2])).items()}
    assert {(r["feature"], r["day"]): r["dau"] for r in adoption.dau(usage, win).collect()} == day
    month = {k: users(v) for k, v in groups(rows, lambda r: (r[1], r[2] and f"{r[2]:%Y-%m}-01")).items()}
    assert {(r["feature"], r["month"]): r["mau"] for r in adoption.mau(usage, win).collect()} == month
    want = {}
    for (f, m), mau in month.items():
        if f is not None and m is not None:
            seen = [n for (g, x), n in day.items() if g == f and x and f"{x:%Y-%m}-01" == m]
            want[f, m] = (round(sum(seen) / len(seen) + 1e-12, 2), mau)
    assert {(r["feature"], r["month"]): (r["avg_dau"], r["mau"]) for r in adoption.stickiness(usage, win).collect()} == want


def test_power_users_against_sets(spark, sessions):
    usage = spark.createDataFrame(sessions, USAGE)
    got = {(r["feature"], r["month"]): r["power_users_count"] for r in adoption.power_users(usage, None, 3).collect()}
    want = defaultdict(int)
    for (f, c, m), rows in groups([r for r in sessions if r[2]], lambda r: (r[1], r[0], f"{r[2]:%Y-%m}-01")).items():
        want[f, m] += len({r[2] for r in rows}) >= 3
    assert got == {k: v for k, v in want.items() if v}


def test_cards_count_users_without_a_feature(spark):
    rows = [("a", "x", d("2024-01-01"), 5), ("b", None, d("2024-01-02"), 5), ("c", "x", d("2024-01-02"), 0), (None, "x", d("2024-01-03"), 5)]
    r = dashboard.kpi_cards(spark.createDataFrame(rows, USAGE)).first()
    assert (r["total_active_users"], r["features_used"], r["avg_stickiness"]) == (2, 1, 1.0)
    assert dashboard.kpi_cards(spark.createDataFrame([], USAGE)).first()["total_active_users"] == 0


@pytest.mark.parametrize("win", [("2024-01-03", "2024-03-20"), ("2020-01-01", "2026-12-31")])  # the second has 366 weeks
def test_weekly_over_window_actives_against_sets(spark, sessions, win):
    rows = [r for r in sessions if r[2] and d(win[0]) <= r[2] <= d(win[1])]
    sunday = lambda x: x - dt.timedelta(days=(x.weekday() + 1) % 7)
    weeks = [users(v) for v in groups(rows, lambda r: sunday(r[2])).values()]
    got = kpis.wau_mau(spark.createDataFrame(sessions, USAGE), win).first()[0]
    assert got == pytest.approx(round(sum(weeks) / len(weeks) / users(rows), 4))
    assert kpis.wau_mau(spark.createDataFrame([], USAGE), win).first()[0] is None


# ------------------------------------------------------------- latest events

SUBS = "customer_id string, event_type string, event_date date, mrr_at_event decimal(12,2), event_id bigint"
CUST = "customer_id string, plan string, company_size string, mrr decimal(12,2), signup_date date"


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_latest_event_against_sorting(spark, monkeypatch, limit):
    """Broadcast and joined cohorts: the last by day, id and MRR, missing ones lowest."""
    monkeypatch.setattr(cohorts, "BROADCAST_CUSTOMERS", limit)
    rng = random.Random(7)
    cust = [(f"c{i}", "p", "s", Decimal(1), d("2024-01-01") + dt.timedelta(days=rng.randrange(180))) for i in range(12)]
    ids = [None, -(2 ** 63), -5, 0, 7, 2 ** 63 - 1]
    money = [None, Decimal("-9999999999.99"), Decimal("0.00"), Decimal("12.34"), Decimal("9999999999.99")]
    subs = [(f"c{rng.randrange(15)}", "renewal", None if rng.random() < 0.05 else d("2023-11-20") + dt.timedelta(days=rng.randrange(400)),
             rng.choice(money), rng.choice(ids)) for _ in range(1500)]
    coh = cohorts.cohorts(spark.createDataFrame(cust, CUST), ("2024-01-01", "2024-12-31"))
    got = {(r["customer_id"], r["cohort_month"], r["month_number"]): r["mrr_at_event"]
           for r in cohorts.latest_event(coh, spark.createDataFrame(subs, SUBS)).collect()}

    def months(a, b):
        if b is None:
            return None
        if b < a:
            return -months(b, a)
        return (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day)

    low = lambda x: (x is not None, x if x is not None else 0)
    best = {}
    for c, _, day, mrr, number in subs:
        for cid, _, _, _, signup in cust:
            if cid == c:
                key = (c, f"{signup:%Y-%m}-01", months(signup, day))
                order = (day or dt.date.min, low(number), low(mrr))
                if key not in best or order > best[key][0]:
                    best[key] = (order, mrr)
    assert got == {k: v for k, (_, v) in best.items()}


def explained(spark, key, details=False):
    buf = io.StringIO()
    df = QUERIES[key](spark, SF01)
    df.collect()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text[:text.index("Initial Plan")] if "Initial Plan" in text and not details else text


@pytest.mark.parametrize("key", ["c05_latest_event", "c06_mrr_pivot", "c07_nrr"])
def test_cohort_comes_before_the_shuffle_of_events(spark, key):
    plan = explained(spark, key)
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    # one exchange of events, after the join
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning") if "Exchange hashpartitioning" in plan else True


def test_nrr_reads_only_events_of_its_months(spark):
    plan = explained(spark, "c07_nrr", details=True)
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x and "event_date" in x]
    assert pushed, [x for x in plan.splitlines() if "Filters" in x]
    assert all("GreaterThanOrEqual(event_date,1994-11-30)" in x and "LessThanOrEqual(event_date," in x for x in pushed)


@pytest.mark.parametrize("key", ["a02_dau", "a03_mau", "a04_stickiness", "a07_power_users", "k07_wau_mau", "p01_kpi_cards", "p02_stickiness_ratio",
                                 "p08_feature_stickiness", "p09_top_feature"])
def test_masks_are_hash_aggregates(spark, key):
    plan = explained(spark, key)
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("key", ["v01_usage_by_tier", "v04_upgrade_likelihood", "k02_feature_penetration", "k08_upgrade_conversion", "a10_adoption_by_plan"])
def test_pairs_are_not_gathered(spark, key):
    assert "ObjectHashAggregate" not in explained(spark, key)


# ------------------------------------------------------------- ranks

def box(values, whis=1.5):
    q1, m, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
    inside = [v for v in values if v >= low], [v for v in values if v <= high]
    return len(values), q1, m, q3, min(inside[0]), max(inside[1]), sum(v < low or v > high for v in values)


def test_box_of_many_distinct_values(spark):
    """200,000 distinct values in one group, beside small and odd ones."""
    big = spark.range(200_000).select(F.lit("big").alias("g"), (F.pow(F.col("id") / 1000, F.lit(3.0))).alias("v"))
    few = [("one", 3.5), ("two", 1.0), ("two", 2.0), ("ties", 1.0), ("ties", 1.0), ("ties", 1.0), ("ties", 50.0), ("none", None), (None, 1.0)]
    df = big.unionByName(spark.createDataFrame(few, "g string, v double")).repartition(5)
    got = {r["g"]: r for r in stats.box_stats(df, "g", "v").collect()}
    assert sorted(got) == ["big", "one", "ties", "two"]
    want = {"big": [(k / 1000) ** 3 for k in range(200_000)], "one": [3.5], "two": [1.0, 2.0], "ties": [1.0, 1.0, 1.0, 50.0]}
    for g, values in want.items():
        r = got[g]
        assert (r["n"], r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"], r["outliers"]) == pytest.approx(box(values))
    plan = stats.box_stats(df, "g", "v")._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "percentile" not in plan
    assert stats.box_stats(df.limit(0), "g", "v").count() == 0


def test_no_range_holds_a_group(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were much more
    try:
        _, starts = stats.counted_ranges(df, "g", F.col("v"))
        rows = starts.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 1 and max(r["_in"] for r in rows) < 60_000 and sum(r["_in"] for r in rows) == 100_000 == rows[0]["n"]


# ------------------------------------------------------------- pairs

def test_pairs_of_a_large_set(spark):
    """5,000 features in one set: 12,497,500 pairs, no array of more than a block."""
    sets = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.format_string("f%05d", i)).alias("features"), F.lit(3).cast("long").alias("n"))
    got = adoption.pair_rows(sets).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"),
                                       F.sum(F.when(F.col("feature_1") < F.col("feature_2"), 1)).alias("ordered"),
                                       F.bit_xor(F.xxhash64("feature_1", "feature_2")).alias("x")).first()
    assert got["rows"] == got["ordered"] == 5000 * 4999 // 2 and got["n"] == 3 * got["rows"]


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_pairs_against_combinations(spark, block):
    rng = random.Random(block)
    sets = [(sorted(rng.sample([f"f{i}" for i in range(20)], rng.randrange(0, 15))), rng.randrange(1, 9)) for _ in range(25)]
    want = defaultdict(int)
    for fs, n in sets:
        for pair in itertools.combinations(fs, 2):
            want[pair] += n
    df = adoption.pair_rows(spark.createDataFrame(sets, "features array<string>, n long"), block)
    got = {(r["feature_1"], r["feature_2"]): r["s"] for r in df.groupBy("feature_1", "feature_2").agg(F.sum("n").alias("s")).collect()}
    assert got == want


# ------------------------------------------------------------- moments

def welch(a, b):
    va, vb = statistics.variance(a), statistics.variance(b)
    qa, qb = va / len(a), vb / len(b)
    t = (statistics.mean(a) - statistics.mean(b)) / (qa + qb) ** Decimal("0.5")
    return float(va), float(vb), float(t), float((qa + qb) ** 2 / (qa ** 2 / (len(a) - 1) + qb ** 2 / (len(b) - 1)))


@pytest.mark.parametrize("base", ["1000000.00", "0.00", "-9999999000.00", "12.50"])
def test_welch_far_from_zero(spark, base):
    """Values far from zero with a spread of a hundredth."""
    rng = random.Random(base)
    a = [Decimal(base) + Decimal(rng.randrange(3)) / 100 for _ in range(300)]
    b = [Decimal(base) + Decimal(rng.randrange(1, 4)) / 100 for _ in range(200)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v decimal(12,2)")
    r = stats.welch_stats(df, "g", "a", "b", "v").first()
    assert (r["var_a"], r["var_b"], r["t_stat"], r["dof"]) == pytest.approx(welch(a, b), rel=1e-12)


def test_welch_of_two_neighbours(spark):
    rows = [(g, Decimal("1000000.00") + Decimal(i % 2) / 100) for g in ("a", "b") for i in range(2000)]
    r = stats.welch_stats(spark.createDataFrame(rows, "g string, v decimal(12,2)"), "g", "a", "b", "v").first()
    assert r["var_a"] == pytest.approx(2.5e-5 * 2000 / 1999, rel=1e-12) and r["t_stat"] == 0.0


def test_pearson_far_from_zero(spark):
    rng = random.Random(11)
    x = [10 ** 6 + rng.randrange(5) for _ in range(400)]
    y = [Decimal("5000000.00") + Decimal(v - 10 ** 6 + rng.randrange(4)) / 100 for v in x]
    r = stats.pearson(spark.createDataFrame(list(zip(x, y)), "x long, y decimal(12,2)"), "x", "y").first()
    assert r["corr"] == pytest.approx(np.corrcoef(np.array(x) - 10 ** 6, np.array([float(v - 5000000) for v in y]))[0, 1], rel=1e-9)


# ------------------------------------------------------------- work folders

def test_work_folders_are_removed_when_old(spark):
    path = work.fresh(spark, "test")
    spark.range(3).write.parquet(path)
    assert work.remove_work(spark, 1.0) == 0
    assert spark.read.parquet(path).count() == 3
    assert work.remove_work(spark, -1.0) >= 1 and work.remove_work(spark, -1.0) == 0
