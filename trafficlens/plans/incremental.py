"""Window models kept up to date, in whatever order hours arrive.

A window is published once an hour after its end has been seen. From then on every new hour inside
it has it computed again and replaced, so late hours end up in the models as if they had come in time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.hours import EPOCH, hour_number_from
from trafficlens.operators.filters import since
from trafficlens.operators.regression import LAGS, daily_sums, lagged
from trafficlens.operators.stats import time_bounds
from trafficlens.operators.windows import DAY, WEEK, window_models
from trafficlens.schema import hourly, with_hour_number
from trafficlens.sinks import replace_daily_sums, replace_window_models
from trafficlens.sources import read_traffic_table


def window_begin(anchor: dt.datetime, k: int, step: int = DAY) -> dt.datetime:
    return anchor + dt.timedelta(hours=k * step)


def windows_complete(anchor: dt.datetime, newest: int | None, size: int, step: int) -> int:
    """How many windows end before the newest hour number."""
    if newest is None:
        return 0
    return max(0, -((hour_number_from(anchor) + size - newest) // step))


def new_window_models(
    traffic: DataFrame, anchor: dt.datetime, last: dt.datetime, from_window: int,
    size: int = WEEK, step: int = DAY, window_count: str = "loop", drop_zero_variance: bool = True,
) -> DataFrame:
    """Models of windows ``from_window`` onwards, from the rows since that window's start.

    The anchor is fixed for the life of the table, so windows keep their number and their hours.
    The "loop" rule counts a window once an hour after its end has been seen, so a model is never
    made from part of its hours.
    """
    recent = since(traffic, window_begin(anchor, from_window, step))
    models = window_models(recent, size, step, anchor, last, window_count, drop_zero_variance)
    return models.where(F.col("k") >= from_window)


def roll_forward(
    spark: SparkSession, traffic_path: str, models_path: str, anchor: dt.datetime,
    size: int = WEEK, step: int = DAY, done: int | None = None,
) -> int:
    """Add the models of newly complete windows to ``models_path``; returns how many windows.

    For hours that come in order. ``done`` is the number of windows already there; if not given it
    is read from the models. The traffic read is pruned to the dates needed.
    """
    if done is None:
        done = _windows_done(spark, models_path)
    begin = window_begin(anchor, done, step)
    traffic = read_traffic_table(spark, traffic_path, start=begin.date())
    newest = time_bounds(traffic).first()["last_hour"]
    complete = windows_complete(anchor, newest, size, step)
    if complete <= done:
        return 0
    _replace(spark, traffic_path, models_path, anchor, range(done, complete), newest, size, step)
    return complete - done


def roll_hours(
    spark: SparkSession, traffic_path: str, models_path: str, anchor: dt.datetime,
    hours: list[int], newest_before: int | None, newest: int, size: int = WEEK, step: int = DAY,
) -> int:
    """Bring the models up to date after the hour numbers ``hours`` joined the table, in any order.

    Windows that cover one of them, and those that ``newest`` completes compared to
    ``newest_before``, are computed from all their hours in the table. Doing it again changes
    nothing. Lists are bounded by the calendar. Returns how many windows were computed.
    """
    wanted = changed_windows(anchor, hours, newest_before, newest, size, step)
    if wanted:
        _replace(spark, traffic_path, models_path, anchor, wanted, newest, size, step)
    return len(wanted)


def changed_windows(
    anchor: dt.datetime, hours: list[int], newest_before: int | None, newest: int, size: int = WEEK, step: int = DAY,
) -> set[int]:
    """Complete windows that cover one of the hours, and those that ``newest`` completes."""
    first = hour_number_from(anchor)
    complete = windows_complete(anchor, newest, size, step)
    wanted = set(range(windows_complete(anchor, newest_before, size, step), complete))
    for hour in hours:
        at = hour - first
        wanted.update(range(max(0, -((size - at) // step)), min(at // step, complete - 1) + 1))
    return wanted


def middle(anchor: dt.datetime, k: int, size: int = WEEK, step: int = DAY) -> dt.date:
    """The date that a window is centred on."""
    return (window_begin(anchor, k, step) + dt.timedelta(hours=size // 2)).date()


def days_of_windows(anchor: dt.datetime, windows: set[int], size: int = WEEK, step: int = DAY) -> set[dt.date]:
    """The dates that windows reach into."""
    return {(window_begin(anchor, k, step) + dt.timedelta(hours=h)).date() for k in windows for h in {*range(0, size, DAY), size}}


def _replace(spark, traffic_path, models_path, anchor, wanted, newest, size, step) -> None:
    """Compute the wanted windows and all others centred on their dates, and replace those dates."""
    dates = {middle(anchor, k, size, step) for k in wanted}
    around = -(-DAY // step) + 1
    complete = windows_complete(anchor, newest, size, step)
    ks = {j for k in wanted for j in range(max(0, k - around), min(complete, k + around + 1)) if middle(anchor, j, size, step) in dates}
    days = days_of_windows(anchor, ks, size, step)
    traffic = read_traffic_table(spark, traffic_path, dates=sorted(days))
    models = window_models(traffic, size, step, anchor, EPOCH + dt.timedelta(hours=newest), "loop")
    replace_window_models(models.where(F.col("k").isin(sorted(ks))), models_path)


def hours_in(traffic: DataFrame) -> list[int]:
    """The hour numbers of a batch, in order; bounded by the calendar."""
    return sorted(r.hour_no for r in with_hour_number(traffic).select("hour_no").distinct().collect())


def _windows_done(spark: SparkSession, models_path: str) -> int:
    try:
        newest = spark.read.parquet(models_path).agg(F.max("k")).first()[0]
    except AnalysisException as error:
        # Nothing has been written yet.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
    return 0 if newest is None else newest + 1


LAG_DAYS = -(-max(LAGS) // DAY)


def roll_regression(spark: SparkSession, traffic_path: str, sums_path: str, changed: list[dt.date]) -> list[dt.date]:
    """Bring the daily regression sums up to date after hours of some dates joined the table.

    The dates, and those whose lags look back on them, are summed anew from their own hours and the
    two days before, and replaced; all other days stay. A fit of any range of days then reads sums
    only (:func:`trafficlens.operators.regression.range_sums`). Doing it again changes nothing.
    Returns the dates summed.
    """
    days = sorted({d + dt.timedelta(days=k) for d in changed for k in range(LAG_DAYS + 1)})
    if not days:
        return []
    read = sorted({d - dt.timedelta(days=k) for d in days for k in range(LAG_DAYS + 1)})
    traffic = read_traffic_table(spark, traffic_path, dates=read)
    numbers = [(d - EPOCH.date()).days for d in days]
    sums = daily_sums(lagged(hourly(traffic))).where(F.col("day_no").isin(numbers))
    replace_daily_sums(sums, sums_path)
    return days
