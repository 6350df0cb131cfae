"""keelson: product-analytics metrics (adoption, health, cohorts, feature
value, KPIs, statistics) as Spark DataFrame functions."""

__version__ = "0.1.0"
