"""Numeric column helpers shared by every metric.

All of them are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact intermediate type: 18 integer digits, 10 fractional digits.
EXACT = "decimal(28,10)"


def exact(c: Column) -> Column:
    """Cast to the exact decimal type used for comparisons and rounding."""
    return c.cast(EXACT)


def round_to(c: Column, digits: int) -> Column:
    """Round half away from zero at ``digits`` and return a double.

    ``round`` on a double rounds the binary value, so ``1.005`` gives 1.0 in
    some engines and 1.01 in others. Going through an exact decimal first
    makes the result independent of the engine.
    """
    return F.round(exact(c), digits).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as a double, NULL when ``den`` is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column, digits: int | None = 2) -> Column:
    """``100 * num / den`` rounded to ``digits`` (NULL when den is 0)."""
    v = F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))
    return v if digits is None else round_to(v, digits)


def capped_least(cap, x: Column) -> Column:
    """``LEAST(cap, x)`` with SQL-standard NULL propagation.

    Spark's ``least`` skips NULL arguments, so ``least(20, NULL)`` is 20.
    The metric definitions need NULL there (a customer whose durations are
    all NULL scores 0 after COALESCE, not the cap).
    """
    return F.when(x.isNotNull(), F.least(F.lit(cap), x))


def floored_greatest(floor, x: Column) -> Column:
    """``GREATEST(floor, x)`` with NULL propagation (see ``capped_least``)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(floor), x))
