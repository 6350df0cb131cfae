"""The incremental rollup equals the batch rollup, and metrics agree on it."""

from keelson.operators import health
from keelson.operators.prep import usage_daily
from keelson.plans.registry import NEW_FEATURES_UO, Tables
from keelson.streaming import rollup_stream

from conftest import SF001


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_rollup_matches_batch(spark, tmp_path):
    t = Tables(spark, SF001)
    usage = t.uo
    src, target = str(tmp_path / "src"), str(tmp_path / "rollup")
    # the sessions arrive as three files (one per order-date range)
    parts = [usage.filter("session_date < date'1996-01-01'"),
             usage.filter("session_date >= date'1996-01-01' AND session_date < date'1999-01-01'"),
             usage.filter("session_date >= date'1999-01-01'")]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("overwrite").parquet(f"{src}/part{i}")
    q = rollup_stream.start(spark, f"{src}/*", target, name=f"t{abs(hash(str(tmp_path)))}",
                            available_now=True)
    q.awaitTermination(300)
    partial = rollup_stream.read_rollup(spark, target)
    assert rows(usage_daily(partial)) == rows(usage_daily(usage))
    compacted = rollup_stream.compact(spark, target, str(tmp_path / "compact"))
    assert "usage_month" in compacted.columns
    assert rows(compacted.drop("usage_month")) == rows(usage_daily(usage))
    a = health.health_scores_v2(t.cust, usage, t.subs, t.tix, NEW_FEATURES_UO)
    b = health.health_scores_v2(t.cust, partial, t.subs, t.tix, NEW_FEATURES_UO)
    assert rows(a) == rows(b)


def test_stream_from_csv_matches_batch_csv(spark, tmp_path):
    from keelson.sources import io
    src, target = tmp_path / "csv", str(tmp_path / "rollup")
    src.mkdir()
    (src / "a.csv").write_text("customer_id,feature,session_date,duration_seconds\n"
                               "1,dashboard,2024-01-05,30\n1,dashboard,2024-01-05,10\n"
                               "2,reporting,2024-13-01,5\n")
    (src / "b.csv").write_text("customer_id,feature,session_date,duration_seconds\n"
                               "1,dashboard,2024-01-05 09:00,1\n3,automation,2024-02-01,x\n")
    q = rollup_stream.start(spark, str(src), target, fmt="csv",
                            name=f"c{abs(hash(str(tmp_path)))}", available_now=True)
    q.awaitTermination(300)
    batch = io.read_table(spark, str(src), "feature_usage")
    assert rows(usage_daily(rollup_stream.read_rollup(spark, target))) == rows(usage_daily(batch))
