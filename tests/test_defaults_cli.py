"""The switch-over path: the four tables as CSV exports -> every metric."""

import os

from keelson.operators import health
from keelson.plans.defaults import METRICS, load, report_rejects, run_all
from keelson.plans.registry import Tables

from conftest import SF001


def test_csv_exports_to_all_metrics(spark, tmp_path):
    t = Tables(spark, SF001)
    data = tmp_path / "data"
    exports = {"customers": t.cust, "feature_usage": t.ue.drop("usage_month"),
               "subscription_events": t.subs, "support_tickets": t.tix}
    for name, df in exports.items():
        df.coalesce(1).write.option("header", True).csv(str(data / f"{name}.csv"))
    out = tmp_path / "out"
    tables = load(spark, str(data), store=str(out / "_tables"))
    assert "usage_month" in tables.usage.columns and dict(tables.cust.dtypes)["customer_id"] == "string"
    done = run_all(tables, str(out))
    assert done == list(METRICS)
    assert all(os.path.exists(out / k / "_SUCCESS") for k in done)
    assert report_rejects(spark, str(data), str(out / "_rejects")).count() == 0
    # the score table written by the run equals a direct computation
    direct = health.health_scores_v2(t.cust, t.ue, t.subs, t.tix)
    back = spark.read.parquet(str(out / "h07_health_scores"))
    assert sorted(map(tuple, back.collect())) == sorted((str(i), *rest) for i, *rest in direct.collect())  # ids are text
