"""Compute every metric from a folder of the four tables.

    python -m keelson --data data/ --out results/ [--in-format csv|parquet]
                      [--out-format parquet|csv] [--only a0 k0 ...]

Reads customers, feature_usage, subscription_events and support_tickets,
stores them typed under ``_tables`` in the output folder (text is parsed once),
writes the health-score table, then one output folder per metric, and counts of
what a CSV export holds that cannot be read (``_rejects``).
"""

from __future__ import annotations

import argparse

from keelson.plans.defaults import load, report_rejects, run_all
from keelson.session import get_session


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="keelson")
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--in-format", default="csv")
    ap.add_argument("--out-format", default="parquet")
    ap.add_argument("--only", nargs="*")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    done = run_all(load(spark, a.data, a.in_format, f"{a.out.rstrip('/')}/_tables"), a.out, a.out_format, a.only)
    if a.in_format == "csv":
        for r in report_rejects(spark, a.data, f"{a.out.rstrip('/')}/_rejects").orderBy("table", "column", "rule").collect():  # a row per column and rule
            print(f"{r['table']}: {r['rejected']} {r['rule']} in {r['column'] or 'records'}, such as {r['example']!r}")
    print(f"wrote {len(done)} metrics to {a.out}")


if __name__ == "__main__":
    main()
