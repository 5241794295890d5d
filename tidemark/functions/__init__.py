"""Column and driver-side functions: periods, dates, types."""

from tidemark.functions.periods import (
    Period,
    as_periods,
    in_period,
    current,
    last_day_of_month,
    month_end,
    month_end_date,
    month_start,
    period_columns,
    period_index,
    period_key,
    period_of_path,
    period_range,
    previous,
    shift_date,
    shift_months,
)
from tidemark.functions.types import SIMPLE_TYPE_NAMES, cast_columns, spark_type

__all__ = [
    "Period", "as_periods", "in_period", "current", "last_day_of_month", "month_end", "month_end_date",
    "month_start", "period_columns", "period_index", "period_key", "period_of_path", "period_range", "previous",
    "shift_date", "shift_months", "SIMPLE_TYPE_NAMES", "cast_columns", "spark_type",
]
