"""Registered queries run from several driver threads at once give the same
results as run one by one (shared ingest, per-call persisted tables)."""

from concurrent.futures import ThreadPoolExecutor

from keelson.plans.registry import QUERIES

from conftest import SF001

KEYS = ["t08_histogram", "t10_tier_means", "t11_box_stats", "s03_health_scores_table",
        "t07_chi_square", "a01_adoption_rate", "c04_retention_matrix", "h07_health_scores"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parallel_equals_sequential(spark):
    q = QUERIES
    seq = {k: rows(q[k](spark, SF001)) for k in KEYS}
    with ThreadPoolExecutor(max_workers=4) as ex:
        par = dict(zip(KEYS, ex.map(lambda k: rows(q[k](spark, SF001)), KEYS * 1)))
    assert par == seq
