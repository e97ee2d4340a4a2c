"""Traffic from tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.hours import EPOCH, calendar_fields, hour_number_of, timestamp_of
from trafficlens.operators.stats import time_bounds
from trafficlens.schema import with_timestamp


def read_traffic_table(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None,
    dates: list[dt.date] | None = None,
) -> DataFrame:
    """Traffic stored by :func:`trafficlens.sinks.write_traffic_table`, dates inclusive.

    Bounds on the date, or the list of dates, prune partitions before anything is read.
    """
    table = spark.read.parquet(path)
    if start is not None:
        table = table.where(F.col("date") >= F.lit(start))
    if end is not None:
        table = table.where(F.col("date") <= F.lit(end))
    if dates is not None:
        table = table.where(F.col("date").isin(dates))
    return with_timestamp(table.drop("date"))


def table_bounds(
    spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None
) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last hour of a stored table, None if it is empty.

    The dates come from the partitions; then only the first and the last of them are read.
    """
    table = spark.read.parquet(path)
    if start is not None:
        table = table.where(F.col("date") >= F.lit(start))
    if end is not None:
        table = table.where(F.col("date") <= F.lit(end))
    first, last = table.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return None
    low, high = time_bounds(table.where(F.col("date").isin([first, last]))).first()
    return EPOCH + dt.timedelta(hours=low), EPOCH + dt.timedelta(hours=high)


def events_as_traffic(events: DataFrame, project: Column, title: Column) -> DataFrame:
    """Count events into traffic rows: one per (project, title, hour), bytes in cents of value.

    Keeps hour_no, so that operators need not work it out again.
    """
    cents = F.round(F.col("value") * 100).cast("bigint")
    counted = events.groupBy(
        project.alias("project"), title.alias("title"), hour_number_of("ts").alias("hour_no")
    ).agg(F.count("*").alias("requests"), F.sum(cents).alias("bytes"))
    return counted.select(
        "project", "title", "requests", "bytes", *calendar_fields("hour_no"),
        timestamp_of("hour_no").alias("ts"), "hour_no",
    )
