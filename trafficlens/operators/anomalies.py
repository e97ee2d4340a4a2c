"""Per-day anomalies and the reports on them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.windows import DAY, WEEK, daily_scores
from trafficlens.schema import ANOMALIES_FIELDS, PAGE
from trafficlens.session import written

PER_DAY = [*PAGE, "year", "month", "day"]
DATE = ["year", "month", "day"]
TASK_CUT = 1000  # the engine's limit for cutting ranks before a shuffle
DAY_PARTS = 256


def moving_average_anomalies(
    traffic: DataFrame, size: int = WEEK, step: int = DAY, anchor="global", last=None,
    window_count: str = "days", deviations: float = 3.0,
) -> DataFrame:
    """Days with an hour more than ``deviations`` off the centred window's mean."""
    return anomalies_from_scores(daily_scores(traffic, size, step, anchor, last, window_count), deviations)


def anomalies_from_scores(days: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Per-day anomalies from :func:`trafficlens.operators.windows.daily_scores`."""
    date = F.date_from_unix_date("day_no")
    return days.where(F.col("z_max") > deviations).select(
        *PAGE,
        F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"),
        "visit_max",
        F.col("z_max").alias("relative_to_quantile"),
        F.col("ratio_max").alias("relative_to_norm"),
    )


def daily_from_scores(
    scored: DataFrame, deviations: float = 3.0, as_written: bool = False
) -> DataFrame:
    """Daily maxima of scored hours beyond ``deviations``: count, z, count over mean.

    The three maxima may come from different hours. ``as_written`` groups by the ratio itself and
    the month instead of by day, the day being the group's first.
    """
    rows = scored.select(
        *PER_DAY, "requests", "z_requests", (F.col("requests") / F.col("avg_requests")).alias("ratio")
    )
    keys = [*PAGE, "ratio", "year", "month"] if as_written else PER_DAY
    days = rows.groupBy(*keys).agg(
        F.max("requests").alias("visit_max"),
        F.max("z_requests").alias("relative_to_quantile"),
        *([] if as_written else [F.max("ratio").alias("relative_to_norm")]),
        *([F.min("day").alias("day")] if as_written else []),
    )
    if as_written:
        days = days.withColumnRenamed("ratio", "relative_to_norm")
    return days.where(F.col("relative_to_quantile") > deviations).select(*ANOMALIES_FIELDS)


def daily_from_residuals(residuals: DataFrame) -> DataFrame:
    """Daily maxima of the hours whose residual exceeds the page's threshold."""
    ratio = F.col("abs_diff") / F.col("threshold")
    days = (
        residuals.where(F.col("abs_diff") > F.col("threshold"))
        .groupBy(*PER_DAY)
        .agg(
            F.max("original").alias("original"),
            F.max("predicted").alias("predicted"),
            F.max(ratio).alias("relative_to_quantile"),
        )
    )
    return days.where(F.col("relative_to_quantile") > 1).select(
        *PER_DAY,
        F.col("original").cast("bigint").alias("visit_max"),
        "relative_to_quantile",
        F.try_divide("original", "predicted").alias("relative_to_norm"),
    )


def top_per_day(anomalies: DataFrame, k: int = 5, distinct_pages: bool = False) -> DataFrame:
    """The k largest of each day; optionally each page once, at its best day.

    Ties go by project, then title. Up to 1,000, Spark itself cuts each task's rows to k per day
    before the shuffle; beyond that each of many parts of a day is cut to k first, so that no task
    sorts a whole day.
    """
    order = [F.desc("relative_to_quantile"), F.asc("project"), F.asc("title")]
    rows = anomalies
    if k > TASK_CUT:
        part = F.pmod(F.xxhash64(*PAGE), F.lit(DAY_PARTS))
        in_part = F.row_number().over(Window.partitionBy(*DATE, part).orderBy(*order))
        rows = rows.withColumn("rank", in_part).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy(*DATE).orderBy(*order))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    if distinct_pages:
        best = Window.partitionBy(*PAGE).orderBy(F.desc("relative_to_quantile"), *DATE)
        top = top.withColumn("best", F.row_number().over(best)).where(F.col("best") == 1)
        top = top.drop("best")
    return top


def top_k(anomalies: DataFrame, k: int | None = None) -> DataFrame:
    """Largest anomalies over all days, ranked; all of them in order when k is None."""
    ranked = anomalies.orderBy(F.desc("relative_to_quantile"), *PAGE, *DATE)
    return ranked if k is None else ranked.limit(k)


def numbered(anomalies: DataFrame) -> DataFrame:
    """All anomalies with ``rank``, their number from 1 in the order of :func:`top_k`.

    No task sees them all: rows are sorted into ranges, each range is counted, and what comes before
    a range is added to the number within it. Equal rows get different numbers. The sorted rows are
    kept in a scratch table, so that both passes see the same ranges.
    """
    order = [F.desc("relative_to_quantile"), *map(F.asc, (*PAGE, *DATE))]
    parts = anomalies.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # The number of the task is in the upper bits, that of the row in the lower 33.
    rows = written(parts.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "anomalies-in-order")
    # A number for each range: as many as there are tasks.
    counts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    offsets = rows.sparkSession.createDataFrame([(part, n) for (part, _), n in zip(counts, before)], "part bigint, before bigint")
    return rows.join(offsets, "part").select(*anomalies.columns, (F.col("before") + F.col("place") + 1).alias("rank"))


def distinct_titles(traffic: DataFrame) -> DataFrame:
    return traffic.select("title").distinct()
