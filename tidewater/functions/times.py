"""Truncation, time zones, calendar rebasing and table-format partition transforms."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First Gregorian day, and the day offsets of the two calendars (fixed values).
CUTOVER = -141427


def truncate_date(col: Column, unit: Column | str) -> Column:
    """Date truncated to YEAR, QUARTER, MONTH or WEEK (and their short names); null for other units."""
    return F.call_function("trunc", col, unit if isinstance(unit, Column) else F.lit(unit))


def truncate_time(col: Column, unit: Column | str) -> Column:
    """Timestamp truncated to a unit from YEAR to MICROSECOND; null for other units."""
    return F.call_function("date_trunc", unit if isinstance(unit, Column) else F.lit(unit), col)


def local_to_utc(col: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(col, zone)


def utc_to_local(col: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(col, zone)


def rezone(col: Column, writer: str, reader: str) -> Column:
    """Moves a timestamp that was written as local time in one zone to local time in another."""
    return F.to_utc_timestamp(F.from_utc_timestamp(col, writer), reader)


def years(col: Column) -> Column:
    """Years since 1970."""
    return F.year(col) - 1970


def months(col: Column) -> Column:
    """Months since January 1970."""
    return (F.year(col) - 1970) * 12 + F.month(col) - 1


def days(col: Column) -> Column:
    """The date of a date or timestamp."""
    return F.to_date(col)


def hours(col: Column) -> Column:
    """Hours since 1970 of a timestamp, rounded down in integer arithmetic."""
    micros = F.unix_micros(col)
    return _div(micros, 3_600_000_000).cast("int")


def truncate_number(col: Column, width: int, scale: int = 0) -> Column:
    """An integer rounded down to a multiple of ``width``, or a decimal to a multiple of ``width`` units of its last
    digit; ``scale`` is the decimal's scale."""
    if width <= 0 or scale < 0:
        raise ValueError("width must be positive and scale not negative")
    return col - F.pmod(col, F.lit(Decimal(width).scaleb(-scale)) if scale else F.lit(width))


def truncate_text(col: Column, width: int) -> Column:
    """The first ``width`` characters of a string or bytes of a binary."""
    if width <= 0:
        raise ValueError("width must be positive")
    return F.substring(col, 1, width)


def _div(a: Column, b: int) -> Column:
    return F.round((a - F.pmod(a, F.lit(b))) / b).cast("long")


def _julian_day(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a date of the Julian calendar: years begin in March."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    m = F.pmod(month + 9, F.lit(12))
    return y * 365 + _div(y, 4) + _div(m * 153 + 2, 5) + day - 1 - 719470


def gregorian_to_julian_days(col: Column) -> Column:
    """Days whose Julian date has the same year, month and day as the Gregorian date of ``col`` (days since
    1970); days from 1582-10-15 stay, and dates that the switch skipped become that day."""
    date = F.date_from_unix_date(col.cast("int"))
    julian = _julian_day(F.year(date).cast("long"), F.month(date).cast("long"), F.dayofmonth(date).cast("long"))
    return F.when(col >= CUTOVER, col.cast("long")).when(col > CUTOVER - 11, F.lit(CUTOVER).cast("long")).otherwise(julian)


def julian_to_gregorian_days(col: Column) -> Column:
    """Days of the Gregorian date with the year, month and day of the Julian date, for days before 1582-10-15;
    a 29 February that the Gregorian year lacks becomes 1 March."""
    z = col.cast("long") + 719470
    y = _div(z * 4 + 3, 1461)
    of_year = z - (y * 365 + _div(y, 4))
    m = _div(of_year * 5 + 2, 153)
    day = of_year - _div(m * 153 + 2, 5) + 1
    month = F.pmod(m + 2, F.lit(12)) + 1
    year = y + F.when(month <= 2, 1).otherwise(0)
    return F.when(col >= CUTOVER, col.cast("long")).otherwise(F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))).cast("long") + day - 1)


#: Julian days of 29 February 1500 (since 1970), and of 100 years.
_LEAP_1500, _CENTURY = -171596, 36_525


def _lacks(col: Column, day: int) -> Column:
    since = col.cast("long") - _LEAP_1500 * day
    of_400 = F.pmod(since, F.lit(4 * _CENTURY * day))
    return (col < CUTOVER * day) & (F.pmod(since, F.lit(_CENTURY * day)) < day) & ((of_400 < _CENTURY * day) | (of_400 >= _CENTURY * day + day))


def gregorian_lacks(col: Column) -> Column:
    """Whether the Julian date of a day before 1582-10-15 (days since 1970) is a 29 February that the Gregorian year lacks.

    Two days become one there, so these alone don't return from ``julian_to_gregorian_days`` and back, but as the day after.
    """
    return _lacks(col, 1)


_DAY = 86_400_000_000


def _by_day(col: Column, rebase) -> Column:
    day = _div(col, _DAY)
    return col + (rebase(day) - day) * _DAY


def gregorian_to_julian_micros(col: Column) -> Column:
    """Microseconds (UTC) moved as their day is; the time of day stays."""
    return _by_day(col, gregorian_to_julian_days)


def julian_to_gregorian_micros(col: Column) -> Column:
    """Microseconds (UTC) moved as their day is; the time of day stays."""
    return _by_day(col, julian_to_gregorian_days)


def gregorian_lacks_micros(col: Column) -> Column:
    """``gregorian_lacks`` of the day of microseconds (UTC)."""
    return _lacks(col, _DAY)
