"""Hour arithmetic on zone-free values.

An hour is a number, hours since 1970-01-01 00:00. It is computed from the four integers of a
traffic row, so no step depends on the session time zone or on daylight saving.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def hour_number(year, month, day, hour) -> Column:
    """Hour number from year, month, day and hour (columns or names)."""
    date = F.make_date(_col(year), _col(month), _col(day))
    return F.unix_date(date).cast("bigint") * 24 + _col(hour)


def hour_number_of(ts) -> Column:
    """Hour number of a zone-free timestamp (a zoned one is read in the session zone)."""
    return F.unix_date(_col(ts).cast("date")).cast("bigint") * 24 + F.hour(_col(ts))


def hour_number_from(value: dt.datetime) -> int:
    """Hour number of a Python datetime, its zone ignored."""
    seconds = (value.replace(tzinfo=None) - EPOCH).total_seconds()
    return int(seconds // 3600)


def day_number(hour_no) -> Column:
    """Days since 1970-01-01 of an hour number."""
    hours = _col(hour_no)
    return ((hours - F.pmod(hours, F.lit(24))) / 24).cast("int")


def date_of(hour_no) -> Column:
    return F.date_from_unix_date(day_number(hour_no))


def timestamp_of(hour_no) -> Column:
    """Zone-free timestamp of an hour number."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_add("HOUR", _col(hour_no), epoch)


def calendar_fields(hour_no) -> list[Column]:
    """year, month, day and hour columns of an hour number."""
    date = date_of(hour_no)
    return [
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.dayofmonth(date).alias("day"),
        F.pmod(_col(hour_no), F.lit(24)).cast("int").alias("hour"),
    ]


def add_hours(ts, hours) -> Column:
    return F.timestamp_add("HOUR", _int(hours), _col(ts))


def add_days(ts, days) -> Column:
    return F.timestamp_add("DAY", _int(days), _col(ts))


def diff_hours(start, end) -> Column:
    """Whole hours from start to end, cut towards zero."""
    return F.timestamp_diff("HOUR", _col(start), _col(end))


def diff_days(start, end) -> Column:
    """Whole days from start to end, cut towards zero."""
    return F.timestamp_diff("DAY", _col(start), _col(end))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _int(value) -> Column:
    return F.lit(value) if isinstance(value, int) else _col(value)
