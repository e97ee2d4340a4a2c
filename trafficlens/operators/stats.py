"""Summaries of traffic: per day, per page, over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.hours import date_of, day_number
from trafficlens.schema import PAGE, with_hour_number


def day_sums(traffic: DataFrame) -> DataFrame:
    """Requests and bytes per page and day."""
    return traffic.groupBy(*PAGE, "year", "month", "day").agg(
        F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes")
    )


def page_stats(sums: DataFrame) -> DataFrame:
    """Per page: totals over the calendar days from its first to its last day, largest day.

    Days without traffic inside the span count in the average. Input is :func:`day_sums`.
    """
    date = F.make_date("year", "month", "day")
    grouped = sums.groupBy(*PAGE).agg(
        F.sum("requests").alias("requests"),
        F.sum("bytes").alias("bytes"),
        F.max("requests").alias("max_requests"),
        F.max("bytes").alias("max_bytes"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    span = F.datediff("last_date", "first_date").cast("double") + 1
    return grouped.select(
        *PAGE,
        (F.col("requests") / span).alias("avg_requests"),
        (F.col("bytes") / span).alias("avg_bytes"),
        "max_requests",
        "max_bytes",
    )


def time_bounds(traffic: DataFrame) -> DataFrame:
    """One row: first and last hour number. Reads only the columns that make the hour."""
    return with_hour_number(traffic).agg(
        F.min("hour_no").alias("first_hour"), F.max("hour_no").alias("last_hour")
    )


def edge_records(traffic: DataFrame) -> DataFrame:
    """Two rows, the earliest and the latest record (edge 'first', 'last'); ties go by page."""
    record = F.struct("hour_no", *PAGE, "requests", "bytes")
    edges = with_hour_number(traffic).agg(F.min(record).alias("first"), F.max(record).alias("last"))
    return edges.select(F.explode(F.array(
        F.struct(F.lit("first").alias("edge"), F.col("first.*")),
        F.struct(F.lit("last").alias("edge"), F.col("last.*")),
    )).alias("e")).select("e.*")


def running_totals(log: DataFrame) -> DataFrame:
    """Running file count, bytes, seconds and mean speed (MB/s) over a fetch log.

    ``log`` has one row per hour file: hour_no, bytes, seconds. Hours run within their day; then a
    window over one row per calendar day, which holds that day's few hours, adds the days before.
    """
    within = Window.partitionBy("day_no").orderBy("hour_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    names = ("files", "bytes", "seconds")
    hours = log.withColumn("day_no", day_number("hour_no")).where("day_no is not null")
    running = hours.select(
        "day_no",
        "hour_no",
        F.count("*").over(within).alias("files"),
        F.sum("bytes").over(within).alias("bytes"),
        F.sum("seconds").over(within).alias("seconds"),
    )
    # A day's hours lie together after the window above, and are summed there, without a shuffle.
    rows = F.array_sort(F.collect_list(F.struct("hour_no", *names)))
    days = running.groupBy("day_no").agg(rows.alias("rows"))
    last = F.element_at("rows", -1)
    before = Window.orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = [F.coalesce(F.sum(last[c]).over(before), F.lit(0)).alias(f"{c}_before") for c in names]
    flat = days.select("rows", *offset).select(*[f"{c}_before" for c in names], F.inline("rows"))
    total = {c: F.col(c) + F.col(f"{c}_before") for c in names}
    return flat.select(
        "hour_no",
        date_of("hour_no").alias("date"),
        total["files"].alias("files"),
        total["bytes"].alias("total_bytes"),
        total["seconds"].alias("total_seconds"),
        F.try_divide(total["bytes"] / 1e6, total["seconds"]).alias("mean_speed"),
    )
