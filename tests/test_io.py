"""Readers and writers."""

import datetime as dt

from keelson.operators import health
from keelson.plans.registry import NEW_FEATURES_UO, Tables
from keelson.sources import io

from conftest import SF001


def test_csv_ingest_types_and_bad_dates(spark, tmp_path):
    p = tmp_path / "feature_usage.csv"
    p.write_text("customer_id,feature,session_date,duration_seconds\n"
                 "1,dashboard,2024-01-05,30\n"
                 "2,reporting,2024-13-01,10\n"
                 "3,automation,2024-01-05 10:00,x\n"
                 "4,dashboard,,5\n")
    df = io.read_table(spark, str(p), "feature_usage")
    got = {r["customer_id"]: (r["session_date"], r["duration_seconds"]) for r in df.collect()}
    assert got == {"1": (dt.date(2024, 1, 5), 30), "2": (None, 10), "3": (dt.date(2024, 1, 5), None), "4": (None, 5)}
    assert dict(df.dtypes) == {"customer_id": "string", "feature": "string", "session_date": "date",
                               "duration_seconds": "decimal(18,3)"}


def test_csv_text_ids_decimals_and_column_order(spark, tmp_path):
    from keelson.operators import adoption
    p, c = tmp_path / "feature_usage.csv", tmp_path / "customers.csv"
    p.write_text("duration_seconds,feature,customer_id,session_date\n12.5,f, C001 ,2024-1-7\n0.25,f,C002,2024-01-08\n")
    c.write_text("plan,customer_id\nPro,C001\nPro,C002\nPro,C003\n")
    usage, cust = io.read_table(spark, str(p), "feature_usage"), io.read_table(spark, str(c), "customers")
    assert [(r["customer_id"], float(r["duration_seconds"])) for r in usage.orderBy("customer_id").collect()] == [("C001", 12.5), ("C002", 0.25)]
    r = adoption.adoption_rate(usage, cust, ("2024-1-1", "2024-1-31")).first()
    assert (r["users_used"], r["total_customers"]) == (2, 3)
    s = tmp_path / "scores.csv"
    s.write_text("health_tier,customer_id,health_score\nHealthy,C001,70.5\n")
    assert tuple(io.read_scores(spark, str(s), "csv").first()) == ("C001", 70.5, "Healthy")


def test_rejects_by_column_and_rule(spark, tmp_path):
    p = tmp_path / "feature_usage.csv"
    p.write_text("customer_id,feature,session_date,duration_seconds,extra\n"
                 "1,dashboard,2024-01-05,30,\n2,reporting,2024-13-01,10,x\n3,automation,2024-1-5 10:00,x9,\n ,dashboard,,5,\n"
                 "5,short\n6,dashboard,never,2,3,4\n7,\"a,b\", 2024-02-30 , 7.25 ,\n\n")
    got = {(r["column"], r["rule"]): (r["rejected"], r["example"]) for r in io.reject_counts(io.rejects(spark, str(p), "feature_usage")).collect()}
    assert got == {(None, "row_shape"): (2, "5,short"), ("customer_id", "no_id"): (1, " "),
                   ("session_date", "bad_date"): (3, " 2024-02-30 "), ("duration_seconds", "bad_number"): (1, "x9")}
    assert io.read_table(spark, str(p), "feature_usage").count() == 7  # rejected cells are NULL, their rows stay
    c = tmp_path / "tickets.csv"
    c.write_text("opened_at,customer_id\n2024-01-05 10:00:00,1\nsoon,2\n,3\n")
    assert [tuple(r) for r in io.rejects(spark, str(c), "support_tickets").collect()] == [("opened_at", "bad_timestamp", "soon")]
    c.write_text("opened_at,customer_id\n")
    assert io.rejects(spark, str(c), "support_tickets").count() == 0


def test_sources_are_listed_once_until_they_change(spark, tmp_path, monkeypatch):
    from keelson.sources import ingest
    flat, parts = str(tmp_path / "flat.parquet"), str(tmp_path / "parts.parquet")
    spark.range(5).write.parquet(flat)
    spark.range(5).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(parts)
    walks, real = [], ingest.files
    monkeypatch.setattr(ingest, "files", lambda s, path: walks.append(path) or real(s, path))
    first = ingest.listing(spark, flat)
    assert ingest.listing(spark, flat) == first and walks == [flat]
    spark.range(3).write.mode("append").parquet(flat)
    assert len(ingest.listing(spark, flat)) > len(first) and walks == [flat] * 2
    for _ in range(2):  # a change within a partition does not show in the table's folder
        ingest.listing(spark, parts)
    assert walks[2:] == [parts] * 2
    assert ingest.listing(spark, str(tmp_path / "none")) == [f"{tmp_path}/none: none"]


def test_csv_categories_normalised(spark, tmp_path):
    p = tmp_path / "subs.csv"
    p.write_text("customer_id,event_type,event_date,mrr_at_event\n1, Plan_Upgrade ,2024-02-01,12.5\n")
    r = io.read_table(spark, str(p), "subscription_events").first()
    assert r["event_type"] == "plan_upgrade" and r["event_id"] is None and float(r["mrr_at_event"]) == 12.5


def test_scores_roundtrip(spark, tmp_path):
    t = Tables(spark, SF001)
    scores = health.health_scores_v2(t.cust, t.uo, t.subs, t.tix, NEW_FEATURES_UO)
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / f"scores_{fmt}")
        io.write_scores(scores, path, fmt=fmt)
        io.write_scores(scores, path, fmt=fmt)     # replace, not append
        back = io.read_scores(spark, path, fmt=fmt)
        same = lambda df: sorted((str(r[0]), r[1], r[2]) for r in df.collect())
        assert same(back) == same(scores)


def test_checkpoint_dir_is_read_from_session(spark):
    d = io.checkpoint_dir(spark)
    assert d and not d.endswith("/")


def test_parquet_ingest_casts_and_fills_missing_columns(spark, tmp_path):
    p = str(tmp_path / "subs")
    spark.createDataFrame([(1, "plan_upgrade", dt.date(2024, 2, 1), 12.5)],
                          "customer_id int, event_type string, event_date date, mrr_at_event double") \
        .write.parquet(p)
    df = io.read_table(spark, p, "subscription_events", fmt="parquet")
    r = df.first()
    assert dict(df.dtypes)["customer_id"] == "bigint" and dict(df.dtypes)["mrr_at_event"] == "decimal(12,2)"
    assert r["event_id"] is None and float(r["mrr_at_event"]) == 12.5


def test_parquet_durations_and_text(spark, tmp_path):
    p = str(tmp_path / "usage")
    rows = [("C1", "f", "2024-1-5 10:00", "12.5"), ("C2", "f", "2024-13-01", "x"), ("C3", "f", None, " 7 ")]
    df = spark.createDataFrame(rows, "customer_id string, feature string, session_date string, duration_seconds string")
    df.write.parquet(p)
    got = [(r["customer_id"], r["session_date"], r["duration_seconds"] and float(r["duration_seconds"]))
           for r in io.read_table(spark, p, "feature_usage", "parquet").orderBy("customer_id").collect()]
    assert got == [("C1", dt.date(2024, 1, 5), 12.5), ("C2", None, None), ("C3", None, 7.0)]
    for kind, want in (("decimal(10,2)", 12.5), ("double", 12.5), ("bigint", 12.0)):
        q = f"{p}-{kind[:4]}"
        spark.sql(f"SELECT 1L AS customer_id, 'f' AS feature, DATE'2024-01-05' AS session_date, CAST(12.5 AS {kind}) AS duration_seconds").write.parquet(q)
        assert float(io.read_table(spark, q, "feature_usage", "parquet").first()["duration_seconds"]) == want
