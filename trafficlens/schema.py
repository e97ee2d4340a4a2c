"""Schemas of the tables that jobs hand to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.hours import calendar_fields, hour_number, timestamp_of

PAGE = ("project", "title")

ANOMALIES_DDL = (
    "project string, title string, year int, month int, day int, "
    "visit_max bigint, relative_to_quantile double, relative_to_norm double"
)

TRAFFIC_FIELDS = ("project", "title", "requests", "bytes", "year", "month", "day", "hour")
ANOMALIES_FIELDS = (
    "project", "title", "year", "month", "day",
    "visit_max", "relative_to_quantile", "relative_to_norm",
)


def with_hour_number(traffic: DataFrame) -> DataFrame:
    """Add ``hour_no``, hours since 1970-01-01 00:00, unless it is there."""
    if "hour_no" in traffic.columns:
        return traffic
    return traffic.withColumn("hour_no", hour_number("year", "month", "day", "hour"))


def with_timestamp(traffic: DataFrame) -> DataFrame:
    """Add ``ts``, the hour as a zone-free timestamp, unless it is there."""
    if "ts" in traffic.columns:
        return traffic
    return traffic.withColumn("ts", timestamp_of(hour_number("year", "month", "day", "hour")))


def hourly(traffic: DataFrame) -> DataFrame:
    """One row per page and hour, counts added up.

    Repeated lines of one hour collapse before the shuffle, so a hot page ends up with at most
    one row per hour of the calendar (8,784 a year) however many input rows it has. Operators
    that keep a page's history together rely on that bound.
    """
    summed = with_hour_number(traffic).groupBy(*PAGE, "hour_no").agg(
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes")
    )
    return summed.select(
        *PAGE, "requests", "bytes", *calendar_fields("hour_no"),
        timestamp_of("hour_no").alias("ts"), "hour_no",
    )
