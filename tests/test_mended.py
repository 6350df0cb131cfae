"""Answers on input that the generated tables do not hold."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from keelson.functions import special
from keelson.functions.dates import as_date, parse_date
from keelson.operators import adoption, health, prep, value

USAGE = "customer_id string, feature string, session_date date, duration_seconds bigint"


def d(text):
    return dt.date.fromisoformat(text)


def test_windows_with_unpadded_text_on_stored_usage(spark, scratch):
    df = spark.createDataFrame([("C1", "f", d("2024-01-01"), 5), ("C2", "f", d("2024-04-30"), 5), ("C3", "f", d("2024-05-01"), 5)], USAGE)
    stored = prep.materialize(prep.with_month(df), f"{scratch}/u", ["usage_month"])
    for table in (df, stored):
        assert prep.in_window(table, ("2024-1-1", "2024-4-30")).count() == 2
    with pytest.raises(ValueError):
        prep.in_window(df, ("2024-01-01", None))
    with pytest.raises(ValueError):
        as_date("January")


def test_dates_with_one_digit(spark):
    texts = ["2024-1-7", "2024-01-07", " 2024-1-07 10:00", "2024-12-1T00:00", "2024-13-01", "x", None, "2024-01-071"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date("t").alias("d"))
    assert [r["d"] for r in df.collect()] == [d("2024-01-07")] * 3 + [d("2024-12-01"), None, None, None, None]


def test_more_listed_features_than_bits_in_a_word(spark):
    names = [f"f{i}" for i in range(100)]
    rows = [("a", n, d("2024-01-01"), 1) for n in ("f0", "f70")] + [("b", "f99", d("2024-01-01"), 1), ("c", "other", d("2024-01-01"), 1)]
    got = {r["customer_id"]: r["new_feature_score"] for r in health.new_feature_score(spark.createDataFrame(rows, USAGE), names).collect()}
    assert got == {"a": 10.0, "b": 5.0}


def test_stickiness_has_no_row_for_a_missing_feature(spark):
    df = spark.createDataFrame([("a", None, d("2024-01-01"), 1), ("a", "f", d("2024-01-01"), 1)], USAGE)
    assert [r["feature"] for r in adoption.stickiness(df).collect()] == ["f"]


def test_health_of_missing_and_repeated_ids(spark):
    cust = spark.createDataFrame([(None,), ("x",), ("x",)], "customer_id string")
    usage = spark.createDataFrame([(None, "f", d("2024-01-01"), 50_000), ("x", "f", d("2024-01-01"), 50_000)], USAGE)
    subs = spark.createDataFrame([(None, "renewal")], "customer_id string, event_type string")
    tix = spark.createDataFrame([(None, "positive")], "customer_id string, sentiment string")
    got = sorted(((r["customer_id"], r["raw_score"]) for r in health.health_raw(cust, usage, subs, tix).collect()), key=str)
    assert got == [("x", 10.2), ("x", 10.2), (None, 0.0)]


@pytest.mark.parametrize("days", [0, 1, 30])
def test_usage_before_events_against_all_pairs(spark, days):
    usage = [(f"c{i % 5}", None if i % 11 == 0 else f"f{i % 3}", d("2024-01-01") + dt.timedelta(days=i * 7 % 120), 1) for i in range(150)]
    events = [(f"c{i % 6}", "plan_upgrade", d("2023-12-20") + dt.timedelta(days=i * 13 % 140)) for i in range(40)]
    want = {}
    for c, f, day, _ in usage:
        if any(e == c and 0 <= (at - day).days <= days for e, _, at in events):
            want.setdefault(f, set()).add(c)
    df = value.pre_event_usage(spark.createDataFrame(usage, USAGE), spark.createDataFrame(events, "customer_id string, event_type string, event_date date"), days=days)
    assert {r["feature"]: r["users_before_upgrade"] for r in df.collect()} == {f: len(c) for f, c in want.items()}


@pytest.mark.parametrize("a,b,x", [(2.5, 1.5, 0.3), (40.0, 0.5, 0.97), (0.5, 3.0, 0.02)])
def test_incomplete_beta_against_integration(a, b, x):
    n = 400_000  # substitution t = x * u^4 removes the singularity at 0
    total = 0.0
    for i in range(n):
        u = (i + 0.5) / n
        t = x * u ** 4
        total += math.exp((a - 1) * math.log(t) + (b - 1) * math.log1p(-t)) * x * 4 * u ** 3 / n
    want = total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    assert special.betainc(a, b, x) == pytest.approx(want, rel=2e-4)


def test_large_parameters_approach_the_normal():
    assert special.betainc(1e6, 0.5, 1 - 1e-6) == pytest.approx(math.erfc(1), rel=1e-5)


def test_not_a_number_ends():
    assert math.isnan(special.continued_fraction(iter([(0.0, 1.0), (math.nan, 1.0)])))


def test_decimal_durations_are_summed(spark):
    df = spark.createDataFrame([("a", "f", d("2024-01-01"))] * 2, "customer_id string, feature string, session_date date")
    df = df.withColumn("duration_seconds", F.lit("12.5").cast("decimal(18,3)"))
    assert float(prep.usage_daily(df).first()["duration_sum"]) == 25.0
