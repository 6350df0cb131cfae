"""Metric operators: each a function from DataFrames to a DataFrame.


- ``prep``: S05-S08 (window, positive sessions, periods, feature selection),
  the customer-feature-day rollup, shared pre-aggregates
- ``adoption``: A01-A12
- ``health``: H01-H07 (presets ``V1``, ``V2``)
- ``cohorts``: C01-C11
- ``value``: V01-V08
- ``kpis``: K01-K12
- ``stats``: T01-T12
- ``dashboard``: P01-P09

Usage arguments accept raw sessions or the rollup (see ``prep``).
"""
