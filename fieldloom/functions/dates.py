"""ISO checks for dates and date-times given as text: extended and basic forms, days and weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings. A cast alone would also take '2024-1-5'.
DAY_PATTERN = r"\d{4}-\d{2}-\d{2}|\d{8}"
WEEK_PATTERN = r"\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?"
_HOUR, _PART = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_CLOCK = rf"{_HOUR}(?::{_PART}(?::{_PART}(?:[.,]\d+)?)?|{_PART}(?:{_PART}(?:[.,]\d+)?)?)?"
_OFFSET = rf"(?:Z|[+-]{_HOUR}(?::?{_PART}(?::?{_PART})?)?)?"
STAMP_PATTERN = rf"^(?:{DAY_PATTERN}|{WEEK_PATTERN})(?:[T ]{_CLOCK}{_OFFSET})?\z"


def _real_day(text: Column) -> Column:
    plain = F.replace(F.regexp_extract(text, f"^(?:{DAY_PATTERN})", 0), F.lit("-"), F.lit(""))
    dashed = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    return (F.length(plain) == 8) & (F.substring(text, 1, 4) != "0000") & dashed.try_cast("date").isNotNull()


def _real_week(text: Column) -> Column:
    year = F.substring(text, 1, 4).try_cast("int")
    week = F.regexp_extract(text, r"^\d{4}-?W(\d{2})", 1).try_cast("int")
    # A year has 53 weeks when it begins on a Thursday, or on a Wednesday and is a leap year.
    first = F.dayofweek(F.make_date(year, F.lit(1), F.lit(1)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    long_year = (first == 5) | ((first == 4) & leap)
    return (year > 0) & (week >= 1) & (week <= F.when(long_year, 53).otherwise(52))


def is_iso_date(text: Column) -> Column:
    """A date, or a date with a time and an optional offset (``Z`` for UTC)."""
    week = text.rlike(f"^(?:{WEEK_PATTERN})")
    real = F.when(week, _real_week(text)).otherwise(_real_day(text))
    return F.coalesce(text.rlike(STAMP_PATTERN) & real, F.lit(False))


# The date-time rule takes the same spellings: the time part is optional for both.
is_iso_datetime = is_iso_date
