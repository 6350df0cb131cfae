"""Scalar helpers: rounding, dates, NULL rules."""

import datetime as dt

from pyspark.sql import functions as F

from keelson.functions import dates as D
from keelson.functions import numeric as N


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_round_half_away_from_zero(spark):
    assert one(spark, N.round_to(F.lit(1.005), 2)) == 1.01
    assert one(spark, N.round_to(F.lit(2.675), 2)) == 2.68
    assert one(spark, N.round_to(F.lit(-1.005), 2)) == -1.01
    assert one(spark, N.round_to(F.lit(0.12345), 4)) == 0.1235


def test_pct_zero_denominator_is_null(spark):
    assert one(spark, N.pct(F.lit(3), F.lit(0))) is None
    assert one(spark, N.pct(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, N.safe_div(F.lit(1), F.lit(None).cast("long"))) is None


def test_capped_least_propagates_null(spark):
    assert one(spark, N.capped_least(20, F.lit(None).cast("double"))) is None
    assert one(spark, N.capped_least(20, F.lit(25.0))) == 20
    assert one(spark, N.floored_greatest(5, F.lit(None).cast("double"))) is None
    assert one(spark, N.floored_greatest(5, F.lit(2.0))) == 5


def test_parse_date_rules(spark):
    assert one(spark, D.parse_date(F.lit("2024-01-05"))) == dt.date(2024, 1, 5)
    assert one(spark, D.parse_date(F.lit("2024-01-05 10:00"))) == dt.date(2024, 1, 5)
    assert one(spark, D.parse_date(F.lit("2024-13-01"))) is None
    assert one(spark, D.parse_date(F.lit("garbage"))) is None
    assert one(spark, D.parse_date(F.lit(None).cast("string"))) is None


def test_yearweek_mode0(spark):
    cases = {
        "2024-01-01": 202353,  # Monday before the year's first Sunday
        "2024-01-07": 202401,  # first Sunday
        "2023-12-31": 202353,
        "1987-01-01": 198652,
        "2000-01-01": 199952,
        "2000-01-02": 200001,
    }
    for d, want in cases.items():
        assert one(spark, D.yearweek(F.to_date(F.lit(d)))) == want, d


def test_monday_week_label(spark):
    assert one(spark, D.monday_week(F.to_date(F.lit("2024-01-03")))) == "2024-01-01/2024-01-07"
    assert one(spark, D.monday_week(F.to_date(F.lit("2023-12-31")))) == "2023-12-25/2023-12-31"


def test_month_diff_completed_months(spark):
    def md(a, b):
        return one(spark, D.month_diff(F.to_date(F.lit(a)), F.to_date(F.lit(b))))
    assert md("2024-01-31", "2024-02-29") == 0
    assert md("2024-01-31", "2024-03-31") == 2
    assert md("2024-01-31", "2024-01-21") == 0     # ten days before signup: month 0
    assert md("2024-01-15", "2023-12-14") == -1
    assert md("2024-01-15", "2024-04-15") == 3
    assert md("2024-01-15", "2024-04-14") == 2


def test_month_diff_matches_formula(spark):
    import random
    rng = random.Random(7)
    base = dt.date(2020, 1, 1)
    pairs = [(base + dt.timedelta(days=rng.randrange(2000)), base + dt.timedelta(days=rng.randrange(2000)))
             for _ in range(400)]
    df = spark.createDataFrame(pairs, "a date, b date")
    got = [r["m"] for r in df.select(D.month_diff(F.col("a"), F.col("b")).alias("m")).collect()]

    def ref(a, b):
        if b >= a:
            return (b.year - a.year) * 12 + b.month - a.month - (b.day < a.day)
        return -((a.year - b.year) * 12 + a.month - b.month - (a.day < b.day))
    assert got == [ref(a, b) for a, b in pairs]


def test_sized_conf_scales_with_input():
    from keelson.session import sized_conf
    small = sized_conf(100 << 20, 8)
    big = sized_conf(100 * (1 << 40), 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) > 100_000
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
