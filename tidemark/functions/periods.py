"""Periods: a (year, month) pair, month arithmetic, and the same as Column functions.

A period's *index* is ``year * 12 + month - 1``; adding or subtracting months
is integer arithmetic on it, and ordering by it is chronological order.
Driver-side values (``Period``) are used to name partitions; the Column
functions do the same work on the executors.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass
from typing import Iterable, Union

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Period:
    year: int
    month: int

    def __post_init__(self):
        if not isinstance(self.year, int) or not isinstance(self.month, int):
            raise TypeError(f"year and month must be int, got {self.year!r}, {self.month!r}")
        if not 1 <= self.month <= 12:
            raise ValueError(f"month must be 1..12, got {self.month}")
        if not 1 <= self.year <= 9999:
            raise ValueError(f"year must be 1..9999, got {self.year}")

    @property
    def index(self) -> int:
        return self.year * 12 + self.month - 1

    @classmethod
    def from_index(cls, index: int) -> "Period":
        return cls(index // 12, index % 12 + 1)

    @classmethod
    def of(cls, value: "PeriodLike") -> "Period":
        """Accepts a Period, a (year, month) pair, a date/datetime, or 'YYYY-MM' / 'YYYY.MM'."""
        if isinstance(value, Period):
            return value
        if isinstance(value, (dt.date, dt.datetime)):
            return cls(value.year, value.month)
        if isinstance(value, tuple) and len(value) == 2:
            return cls(int(value[0]), int(value[1]))
        if isinstance(value, str):
            for sep in ("-", "."):
                if sep in value:
                    y, m = value.split(sep, 1)
                    return cls(int(y), int(m))
        raise ValueError(f"cannot read a period from {value!r}")

    def minus(self, months: int) -> "Period":
        """The period ``months`` before this one (negative moves forward)."""
        return Period.from_index(self.index - int(months))

    def plus(self, months: int) -> "Period":
        return self.minus(-int(months))

    @property
    def key(self) -> str:
        """'YYYY.MM', month zero-padded: string order is time order."""
        return f"{self.year}.{self.month:02d}"

    @property
    def first_day(self) -> dt.date:
        return dt.date(self.year, self.month, 1)

    @property
    def last_day(self) -> dt.date:
        return dt.date(self.year, self.month, calendar.monthrange(self.year, self.month)[1])

    def __str__(self) -> str:
        return f"{self.year}-{self.month:02d}"


PeriodLike = Union[Period, tuple, dt.date, dt.datetime, str]


def period_of_path(path: str) -> Period:
    """The period of a ``.../year=YYYY/month=M[/...]`` path (the last such pair)."""
    year = month = None
    for seg in path.rstrip("/").split("/"):
        if seg.startswith("year="):
            year, month = seg[5:], None
        elif seg.startswith("month=") and year is not None:
            month = seg[6:]
    if year is None or month is None:
        raise ValueError(f"not a year=YYYY/month=M path: {path}")
    return Period(int(year), int(month))


def period_range(start: PeriodLike, end: PeriodLike) -> list[Period]:
    """Every calendar month from ``start`` to ``end``, both included."""
    lo, hi = Period.of(start), Period.of(end)
    return [Period.from_index(i) for i in range(lo.index, hi.index + 1)]


def as_periods(periods: Iterable[PeriodLike]) -> list[Period]:
    return sorted({Period.of(p) for p in periods})


# Offset policies. A dependency is read at the run month minus its offset.

def current() -> int:
    """The same month as the run."""
    return 0


def previous(offset: int = 1) -> int:
    """``offset`` months before the run (one by default)."""
    if offset < 0:
        raise ValueError("offsets count months back and cannot be negative")
    return offset


def shift_date(day: dt.date, months: int) -> dt.date:
    """A date moved by whole months, the day clamped to the month's end (as add_months)."""
    target = Period.of(day).plus(months)
    return dt.date(target.year, target.month, min(day.day, target.last_day.day))


def last_day_of_month(value: Union[dt.date, dt.datetime]) -> Union[dt.date, dt.datetime]:
    """Last day of the value's month; a datetime keeps its time of day."""
    return value.replace(day=calendar.monthrange(value.year, value.month)[1])


# Column functions (JVM-side, inside whole-stage codegen).

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_index(year="year", month="month") -> Column:
    return _col(year) * 12 + _col(month) - 1


def period_key(year="year", month="month") -> Column:
    """'YYYY.MM' from year and month columns."""
    return F.format_string("%d.%02d", _col(year), _col(month))


def month_end(c) -> Column:
    """A timestamp moved to the last day of its month, its time of day kept.

    The result is a timestamp; for dates, ``month_end_date`` gives a date.
    """
    c = _col(c)
    days_left = F.datediff(F.last_day(F.to_date(c)), F.to_date(c))
    return F.when(c.isNull(), None).otherwise(F.timestamp_add("DAY", days_left, c))


def month_end_date(c) -> Column:
    """The last day of the month, as a date."""
    return F.last_day(_col(c))


def shift_months(c, months: int) -> Column:
    """A date moved by whole months, the day clamped to the month's end."""
    return F.add_months(_col(c), int(months))


def month_start(c) -> Column:
    return F.trunc(_col(c), "month")


def period_columns(ts) -> dict[str, Column]:
    """Integer ``year`` and ``month`` columns from a date or timestamp column."""
    return {"year": F.year(_col(ts)), "month": F.month(_col(ts))}


def in_period(df, column: str, period: PeriodLike) -> Column:
    """``first day <= column < first day of the next month`` with literals of the column's own type.

    The bounds fold to constants, so the predicate reaches the parquet reader
    as a pushed range filter.
    """
    from pyspark.sql import types as T

    p, nxt = Period.of(period), Period.of(period).plus(1)
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.TimestampNTZType):
        make = lambda q: F.make_timestamp_ntz(F.lit(q.year), F.lit(q.month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    elif isinstance(dtype, T.TimestampType):
        make = lambda q: F.make_timestamp(F.lit(q.year), F.lit(q.month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    elif isinstance(dtype, T.DateType):
        make = lambda q: F.make_date(F.lit(q.year), F.lit(q.month), F.lit(1))
    else:
        raise TypeError(f"column {column!r} is {dtype.simpleString()}, not a date or timestamp")
    c = F.col(column)
    return (c >= make(p)) & (c < make(nxt))
