"""Calendar expressions: period labels and business period ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS_PER_YEAR = {"D": 252, "W": 52, "M": 12, "Q": 4}


def period_label(day: Column, frequency: str) -> Column:
    """The calendar end of the period: the day, its Friday, its month's or its quarter's end."""
    return {
        "D": day,
        "W": F.next_day(F.date_sub(day, 1), "FRI"),
        "M": F.last_day(day),
        "Q": F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
    }[frequency]


def last_business_day(month_end: Column) -> Column:
    """A month end moved back over a weekend."""
    return F.date_sub(month_end, F.greatest(F.weekday(month_end) - 4, F.lit(0)))


def period_is_complete(last_day: Column, frequency: str) -> Column:
    """Whether the last observation is on the business end of its period."""
    if frequency == "D":
        return F.lit(True)
    if frequency == "W":
        return F.weekday(last_day) == 4
    return last_business_day(period_label(last_day, frequency)) == last_day


def years_after(day: Column, years: float) -> Column:
    """Calendar years if whole, else days of 365.2425 a year."""
    return F.add_months(day, int(12 * years)) if float(years).is_integer() else F.date_add(day, int(years * 365.2425))


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
