"""Physical-plan properties every registered query must keep."""

import contextlib
import io

import pytest

from keelson.plans.registry import QUERIES

from conftest import SF01

PYTHON_OK = {"t04_welch_t_pvalue", "t07_chi_square_pvalue"}
# metrics over the order usage of Jan-Apr 1999, or of April 1999
PRUNED = {"a01_adoption_rate", "a10_adoption_by_plan", "a11_adoption_by_company_size",
          "a12_feature_co_usage", "p04_adoption_by_plan", "p06_usage_matrix", "p07_feature_phi",
          "k07_wau_mau"}


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for k, fn in QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, SF01).explain("formatted")
        out[k] = buf.getvalue()
    return out


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(plans, key):
    assert "CartesianProduct" not in plans[key]
    assert "BroadcastNestedLoopJoin" not in plans[key]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_python_only_for_p_values(plans, key):
    has_python = "ArrowEvalPython" in plans[key] or "BatchEvalPython" in plans[key]
    assert has_python == (key in PYTHON_OK)


@pytest.mark.parametrize("key", sorted(PRUNED))
def test_usage_window_prunes_partitions(plans, key):
    scans = [line for line in plans[key].splitlines() if "PartitionFilters" in line and "usage_month" in line]
    assert scans, "expected a usage_month partition filter"


def test_scans_read_only_needed_columns(plans):
    # the model's usage table has 5 columns; A02 needs 3 of them
    reads = [line for line in plans["a02_dau"].splitlines() if "ReadSchema" in line]
    assert reads and all("duration_seconds" not in line for line in reads)


@pytest.mark.parametrize("key", ["k02_feature_penetration", "k08_upgrade_conversion", "t01_breadth", "v04_upgrade_likelihood"])
def test_unwindowed_metrics_read_all_months(plans, key):
    assert "usage_month" not in "".join(line for line in plans[key].splitlines() if "PartitionFilters" in line)


@pytest.mark.parametrize("key", ["a10_adoption_by_plan", "a12_feature_co_usage", "v04_upgrade_likelihood", "p07_feature_phi"])
def test_pairs_are_made_distinct_by_hash_aggregates(plans, key):
    first = plans[key].index("HashAggregate")
    assert "ObjectHashAggregate" not in plans[key][plans[key].rindex("Scan parquet"):first] and "SortAggregate" not in plans[key]
