"""Sliding windows over hours: which window covers which row, and per-page models of them.

Window k covers hours k*step .. k*step + size after the anchor, both ends included; its middle is
k*step + size div 2. All windows of all pages come from one grouped aggregation: hours are first
summed into slices of ``step`` hours, each cut at ``size mod step`` into a head and a rest, because
a window's last slice is covered up to that offset only. The slice parts of a page, at most two
per slice of the calendar however many rows it had, then meet in one place and each counts into
every window that covers it; hours themselves are never copied to windows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.hours import day_number, hour_number_from, timestamp_of
from trafficlens.functions.numeric import (
    population_variance,
    sum_of_squares,
    times_deviation,
    wide,
)
from trafficlens.operators.stats import time_bounds
from trafficlens.schema import PAGE, with_hour_number

WEEK = 7 * 24
DAY = 24
MODEL_COLUMNS = (
    "project", "title", "k", "window_start", "window_mid", "window_end", "n",
    "avg_requests", "avg_bytes", "var_requests", "var_bytes",
)


def anchored(
    traffic: DataFrame,
    anchor="global",
    last: dt.datetime | None = None,
    size: int = WEEK,
    step: int = DAY,
    window_count: str = "days",
) -> DataFrame:
    """Add hour_no, origin (hour number of window 0's start) and windows (how many there are).

    anchor   "global": first hour of the input; "page": first hour of each page; or a datetime.
             Then the rows are sums of the page's hours: n, requests, bytes, requests_sq, bytes_sq,
             and high and low, the extremes of requests.
    last     last hour to consider, where known; otherwise found in the input.
    With both given as datetimes nothing has to be read in advance.
    window_count  "days": last hour div 24 - size div 24 + 1; "loop": windows whose end lies
             before the last hour.
    """
    rows = with_hour_number(traffic)
    if anchor == "page":
        # Hours of a page collapse first; then its first and last hour come from a window in the
        # partitioning that the slices need, over one row per hour of the calendar at most.
        extremes = [F.max("requests").alias("high"), F.min("requests").alias("low")]
        rows = rows.groupBy(*PAGE, "hour_no").agg(*_model_sums(rows), *extremes).repartition(*PAGE)
        page = Window.partitionBy(*PAGE)
        rows = rows.select("*", F.min("hour_no").over(page).alias("origin"), F.max("hour_no").over(page).alias("last_hour"))
    elif anchor == "global" or last is None:
        # One row found first, then a constant of the plan.
        bounds = time_bounds(rows).select(F.struct("first_hour", "last_hour")).scalar()
        rows = rows.withColumn("bounds", bounds).select(
            "*", F.col("bounds.first_hour").alias("origin"), F.col("bounds.last_hour").alias("last_hour")
        ).drop("bounds")
    if anchor not in ("page", "global"):
        rows = rows.withColumn("origin", F.lit(hour_number_from(anchor)))
    if last is not None:
        rows = rows.withColumn("last_hour", F.lit(hour_number_from(last)))
    windows = count_windows(F.col("last_hour") - F.col("origin"), size, step, window_count)
    return rows.withColumn("windows", windows).drop("last_hour")


def count_windows(last: Column, size: int, step: int, rule: str) -> Column:
    """Number of windows when the last row is ``last`` hours after the anchor."""
    if rule == "days":
        return F.greatest(F.floor(last / 24) - size // 24 + 1, F.lit(0))
    if rule == "loop":
        return F.greatest(F.ceil((last - size) / step), F.lit(0))
    raise ValueError(f"window_count must be 'days' or 'loop', not {rule!r}")


def slices(rows: DataFrame, size: int, step: int, sums: list[Column], keys=()) -> DataFrame:
    """Sum anchored rows into slice parts: columns origin, windows, slice, head and the sums.

    Rows combine before the first shuffle, which spreads a page over all tasks by slice; only the
    few parts left are then brought together by page, so spreading them over windows and summing
    those needs no further shuffle.
    """
    h = F.col("hour_no") - F.col("origin")
    offset = F.pmod(h, F.lit(step))
    cut = rows.select(
        "*",
        offset.alias("offset"),
        ((h - offset) / step).cast("bigint").alias("slice"),
        (offset <= size % step).alias("head"),
    )
    parts = cut.groupBy(*PAGE, "origin", "windows", "slice", "head", *keys).agg(*sums)
    return parts.repartition(*PAGE)


def first_window(size: int, step: int) -> Column:
    """Number of the first window that covers a slice part."""
    whole = size // step
    low = F.when(F.col("head"), F.col("slice") - whole).otherwise(F.col("slice") - whole + 1)
    return F.greatest(low, F.lit(0).cast("bigint"))


def last_window() -> Column:
    """Number of the last window that covers a slice part; below the first if none does."""
    return F.least(F.col("slice"), F.col("windows") - 1)


def covering(size: int, step: int) -> Column:
    """Numbers of the windows that cover a slice part, as an array, NULL if there is none."""
    low, high = first_window(size, step), last_window()
    return F.when(low <= high, F.sequence(low, high))


def window_models(
    traffic: DataFrame,
    size: int = WEEK,
    step: int = DAY,
    anchor="global",
    last: dt.datetime | None = None,
    window_count: str = "days",
    drop_zero_variance: bool = True,
) -> DataFrame:
    """Mean and population variance of requests and bytes per page and window, n > 1.

    ``drop_zero_variance`` leaves out models in which either variance is 0. Squares are summed
    exactly for any counts; a window's plain totals must fit a bigint. Input rows are taken as
    they are: two rows of one hour count as two.
    """
    rows = anchored(traffic, anchor, last, size, step, window_count)
    return models_of_slices(slices(rows, size, step, _model_sums(rows)), size, step, drop_zero_variance)


def models_of_slices(parts: DataFrame, size: int, step: int, drop_zero_variance: bool = True) -> DataFrame:
    """The models of windows from slice parts that lie together by page."""
    spread = parts.select(
        *PAGE, "origin", F.explode(covering(size, step)).alias("k"),
        "n", "requests", "bytes", "requests_sq", "bytes_sq",
    )
    grouped = spread.groupBy(*PAGE, "origin", "k").agg(
        *[F.sum(c).alias(c) for c in ("n", "requests", "bytes", "requests_sq", "bytes_sq")]
    )
    return _finish(grouped, size, step, drop_zero_variance)


def last_window_models(
    traffic: DataFrame,
    size: int = WEEK,
    step: int = DAY,
    anchor="global",
    last: dt.datetime | None = None,
    window_count: str = "days",
    drop_zero_variance: bool = True,
) -> DataFrame:
    """The models of the very last window alone, from its own hours; a page without one has none."""
    rows = anchored(traffic, anchor, last, size, step, window_count)
    k = F.col("windows") - 1
    since = F.col("hour_no") - F.col("origin") - k * step
    grouped = rows.where((k >= 0) & since.between(0, size)).groupBy(*PAGE, "origin", k.alias("k")).agg(*_model_sums(rows))
    return _finish(grouped, size, step, drop_zero_variance)


def window_models_builtin(
    traffic: DataFrame,
    first: dt.datetime,
    last: dt.datetime,
    size: int = WEEK,
    step: int = DAY,
    window_count: str = "days",
    drop_zero_variance: bool = True,
) -> DataFrame:
    """The same models by Spark's own sliding window, which copies each row to every window.

    Needs the bounds as literals and step <= size + 1. Kept to check :func:`window_models`.
    """
    rows = anchored(traffic, first, last, size, step, window_count)
    ts = timestamp_of("hour_no")
    offset = hour_number_from(first) % step
    frame = F.window("hour_ts", f"{size + 1} hours", f"{step} hours", f"{offset} hours")
    grouped = (
        rows.withColumn("hour_ts", ts)
        .groupBy(*PAGE, "origin", "windows", frame.alias("frame"))
        .agg(*_model_sums(rows))
    )
    start = F.timestamp_diff("HOUR", timestamp_of("origin"), F.col("frame.start"))
    numbered = grouped.withColumn("k", (start / step).cast("bigint")).where(
        (F.col("k") >= 0) & (start >= 0) & (F.col("k") < F.col("windows"))
    )
    return _finish(numbered, size, step, drop_zero_variance)


SUMS = ("n", "requests", "bytes", "requests_sq", "bytes_sq")


def _model_sums(rows: DataFrame) -> list[Column]:
    """Sums of traffic rows, or of rows that hold such sums of an hour already."""
    if "requests_sq" in rows.columns:
        return [F.sum(c).alias(c) for c in SUMS]
    return [
        F.count("*").alias("n"),
        F.sum("requests").alias("requests"),
        F.sum("bytes").alias("bytes"),
        sum_of_squares(F.col("requests")).alias("requests_sq"),
        sum_of_squares(F.col("bytes")).alias("bytes_sq"),
    ]


def _finish(grouped: DataFrame, size: int, step: int, drop_zero_variance: bool) -> DataFrame:
    n = F.col("n")
    start = F.col("origin") + F.col("k") * step
    models = grouped.where(n > 1).select(
        *PAGE,
        "k",
        timestamp_of(start).alias("window_start"),
        timestamp_of(start + size // 2).alias("window_mid"),
        timestamp_of(start + size).alias("window_end"),
        "n",
        (F.col("requests").cast("double") / n).alias("avg_requests"),
        (F.col("bytes").cast("double") / n).alias("avg_bytes"),
        population_variance(n, F.col("requests"), F.col("requests_sq")).alias("var_requests"),
        population_variance(n, F.col("bytes"), F.col("bytes_sq")).alias("var_bytes"),
    )
    if drop_zero_variance:
        models = models.where((F.col("var_requests") != 0) & (F.col("var_bytes") != 0))
    return models


def own_windows(day, size: int, step: int) -> tuple[Column, Column]:
    """Numbers of the first and last window whose middle lies on ``day`` (a day number); there is
    none if the first is larger. Uses the columns origin and windows of :func:`anchored`."""
    first_mid = F.col("origin") + size // 2
    begin = day.cast("bigint") * 24 - first_mid
    down = lambda hours: ((hours - F.pmod(hours, F.lit(step))) / step).cast("bigint")
    return F.greatest(down(begin + step - 1), F.lit(0).cast("bigint")), F.least(down(begin + 23), F.col("windows") - 1)


def daily_scores(
    traffic: DataFrame,
    size: int = WEEK,
    step: int = DAY,
    anchor="global",
    last: dt.datetime | None = None,
    window_count: str = "days",
) -> DataFrame:
    """Per page and day, the day's extremes against the last window centred on it that has a model.

    Columns visit_max, z_max (largest distance from the mean in deviations) and ratio_max
    (largest count over mean). The largest |mean - x| of a day belongs to its largest or smallest
    x, so day extremes suffice: hours are shuffled once as slice sums and extremes, and each
    slice part goes to the windows that cover it and, with its extremes, to the windows centred on
    its day. Equals scoring every hour and taking daily maxima.
    """
    rows = anchored(traffic, anchor, last, size, step, window_count)
    return scores_of_slices(_day_slices(rows, size, step), size, step)


def _day_slices(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Slice parts cut at midnight, too, with the extremes of requests."""
    most, least = ("high", "low") if "high" in rows.columns else ("requests", "requests")
    extremes = [F.max(most).alias("high"), F.min(least).alias("low")]
    rows = rows.withColumn("day_no", day_number("hour_no"))
    return slices(rows, size, step, [*_model_sums(rows), *extremes], keys=["day_no"])


SLICE_KEYS = (*PAGE, "slice", "head", "day_no")


def slice_sums(traffic: DataFrame, anchor: dt.datetime, size: int = WEEK, step: int = DAY) -> DataFrame:
    """Sums and extremes of traffic by page, slice part and day, to be kept and added up later.

    Slices depend on the anchor, the step and size mod step alone. Sums of several batches of rows
    add up by :func:`merged_slices`.
    """
    rows = anchored(traffic, anchor, anchor, size, step, "loop")
    return _day_slices(rows, size, step).drop("origin", "windows")


def merged_slices(sums: DataFrame, anchor: dt.datetime, windows: int) -> DataFrame:
    """Slice parts of all pages from stored slice sums, for the first so many windows."""
    # Pages come together first: both groupings then keep that partitioning.
    parts = sums.repartition(*PAGE).groupBy(*SLICE_KEYS).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("high").alias("high"), F.min("low").alias("low"))
    return parts.withColumns({"origin": F.lit(hour_number_from(anchor)).cast("bigint"), "windows": F.lit(windows).cast("bigint")})


def scores_of_slices(parts: DataFrame, size: int, step: int) -> DataFrame:
    """:func:`daily_scores` from slice parts of days that lie together by page."""
    low, high = F.col("first_k"), F.col("last_k")
    own_low, own_high = F.col("own_first"), F.col("own_last")
    own_first, own_last = own_windows(F.col("day_no"), size, step)
    parts = parts.select(
        "*", first_window(size, step).alias("first_k"), last_window().alias("last_k"),
        own_first.alias("own_first"), own_last.alias("own_last"),
    )
    numbers = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    # A day's own windows nearly always cover it; short windows may leave some of its slices out.
    targets = F.concat(
        numbers(low, high), F.filter(numbers(own_low, own_high), lambda k: ~k.between(low, high))
    )
    spread = parts.withColumn("k", F.explode(targets))
    counts, is_own = F.col("k").between(low, high), F.col("k").between(own_low, own_high)
    sums = [
        F.sum(F.when(counts, F.col(c))).alias(c)
        for c in ("n", "requests", "bytes", "requests_sq", "bytes_sq")
    ]
    grouped = spread.groupBy(*PAGE, "origin", "k").agg(
        *sums,
        F.max(F.when(is_own, F.col("high"))).alias("high"),
        F.min(F.when(is_own, F.col("low"))).alias("low"),
        F.max(F.when(is_own, F.col("day_no"))).alias("day_no"),
    )
    n = F.col("n")
    mean = F.col("requests").cast("double") / n
    variances = [
        population_variance(n, F.col(c), F.col(f"{c}_sq")).alias(f"var_{c}")
        for c in ("requests", "bytes")
    ]
    models = grouped.where((n > 1) & F.col("day_no").isNotNull()).select(
        *PAGE, "day_no", "k", "high", "low", mean.alias("mean"), *variances
    )
    models = models.where((F.col("var_requests") != 0) & (F.col("var_bytes") != 0))
    if step < 24:
        newest = F.max_by(F.struct("high", "low", "mean", "var_requests"), "k").alias("m")
        models = models.groupBy(*PAGE, "day_no").agg(newest).select(*PAGE, "day_no", "m.*")
    furthest = F.greatest(
        F.abs(F.col("mean") - F.col("high")), F.abs(F.col("mean") - F.col("low"))
    )
    return models.select(
        *PAGE,
        "day_no",
        F.col("high").alias("visit_max"),
        times_deviation(furthest, F.col("var_requests")).alias("z_max"),
        (F.col("high") / F.col("mean")).alias("ratio_max"),
    )


def kernel_means(
    traffic: DataFrame,
    size: int = WEEK,
    step: int = DAY,
    anchor="global",
    last: dt.datetime | None = None,
    window_count: str = "days",
) -> DataFrame:
    """Epanechnikov-weighted mean of requests per page and window.

    The weight is 3/4 (1 - u^2) with u = (hour - middle) / (size / 2). As it is a polynomial of the
    hour, slice sums of 1, o and o^2 (o = offset in the slice), plain and times requests, give
    every window's weighted sum; single hours are not spread.
    """
    half = size // 2
    reach = 2 * half  # hours beyond weigh 0 when size is odd
    rows = anchored(traffic, anchor, last, size, step, window_count)
    o, x = wide(F.col("offset")), wide(F.col("requests"))
    one = F.col("n") if "requests_sq" in rows.columns else F.lit(1).cast("bigint")
    names = ("n", "n1", "n2", "x", "x1", "x2")
    sums = [
        F.sum(one).cast("decimal(20,0)").alias("n"),
        F.sum(o * one).alias("n1"),
        F.sum((o * o).cast("decimal(12,0)") * one).alias("n2"),
        F.sum(x).alias("x"),
        F.sum(o * x).alias("x1"),
        F.sum((o * o).cast("decimal(12,0)") * x).alias("x2"),
    ]
    parts = slices(rows, reach, step, sums)
    spread = parts.select(*PAGE, "origin", "slice", F.explode(covering(reach, step)).alias("k"), *names)
    # Distance of the slice start from the window's middle; t = d + o, t^2 = d^2 + 2 d o + o^2.
    d = ((F.col("slice") - F.col("k")) * step - half).cast("decimal(12,0)")
    squared = {
        "n": d * d * F.col("n") + d * 2 * F.col("n1") + F.col("n2"),
        "x": d * d * F.col("x") + d * 2 * F.col("x1") + F.col("x2"),
    }
    grouped = spread.groupBy(*PAGE, "origin", "k").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"),
        F.sum(squared["n"]).alias("n_sq"), F.sum(squared["x"]).alias("x_sq"),
    )
    radius = (size / 2.0) ** 2
    weights = (F.col("n").cast("double") - F.col("n_sq").cast("double") / radius) * 0.75
    weighted = (F.col("x").cast("double") - F.col("x_sq").cast("double") / radius) * 0.75
    mid = F.col("origin") + F.col("k") * step + half
    return (
        grouped.select(
            *PAGE, "k", timestamp_of(mid).alias("window_mid"), F.col("n").cast("bigint").alias("n"),
            weights.alias("weight"), weighted.alias("weighted"),
        )
        .where(F.col("weight") > 0)
        .select(*PAGE, "k", "window_mid", "n", "weight",
                (F.col("weighted") / F.col("weight")).alias("kernel_mean"))
    )
