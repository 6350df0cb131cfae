"""Column-level helpers: rounding, dates, p-values."""

from keelson.functions.dates import (lit_date, month_diff, month_key, month_period, monday_week,
                                     parse_date, to_date_any, yearweek)
from keelson.functions.numeric import (EXACT, capped_least, exact, floored_greatest, pct, round_to,
                                       safe_div)

__all__ = [
    "EXACT", "capped_least", "exact", "floored_greatest", "lit_date", "monday_week", "month_diff",
    "month_key", "month_period", "parse_date", "pct", "round_to", "safe_div", "to_date_any", "yearweek",
]
