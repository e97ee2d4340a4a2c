"""Hours against the model of the window centred on their day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.numeric import times_deviation
from trafficlens.operators.windows import last_window_models
from trafficlens.schema import PAGE, with_timestamp

MODEL_VALUES = ("avg_requests", "avg_bytes", "var_requests", "var_bytes")
THRESHOLDS = (2, 3, 4, 5, 6)
PER_DAY = [*PAGE, "year", "month", "day"]


def attach(
    traffic: DataFrame, models: DataFrame, how: str = "inner", all_windows: bool = False,
    step: int | None = None,
) -> DataFrame:
    """Join each row to the model whose middle lies on its day.

    how  "inner": rows of days without a model drop out; "left": they stay, has_model false.
    With steps below 24 hours a day has several windows; the last one counts, unless
    ``all_windows`` asks for a row per window. Where the caller names a ``step`` of 24 or more, the
    search for the last one is left out.
    """
    mid = F.col("window_mid")
    dated = models.select(
        *PAGE,
        F.year(mid).alias("year"), F.month(mid).alias("month"), F.dayofmonth(mid).alias("day"),
        "k", *MODEL_VALUES,
    )
    if (step is None or step < 24) and not all_windows:
        newest = F.max_by(F.struct("k", *MODEL_VALUES), "k").alias("newest")
        dated = dated.groupBy(*PER_DAY).agg(newest).select(*PER_DAY, "newest.*")
    joined = with_timestamp(traffic).join(dated, PER_DAY, how)
    return joined.withColumn("has_model", F.col("k").isNotNull())


def attach_last_window(traffic: DataFrame, **window_options) -> DataFrame:
    """Left attach in which only the very last window keeps its model.

    What remains when every round of a loop rebuilds all rows and forgets the round before. The last
    window is the last of the calendar, whether a page has a model in it or not.
    """
    return attach(traffic, last_window_models(traffic, **window_options), how="left")


def score(attached: DataFrame) -> DataFrame:
    """Add distance from the mean and the same in deviations, for requests and bytes."""
    diffs = {x: F.abs(F.col(f"avg_{x}") - F.col(x)) for x in ("requests", "bytes")}
    return attached.select(
        "*",
        *[diff.alias(f"diff_{x}") for x, diff in diffs.items()],
        *[times_deviation(diff, F.col(f"var_{x}")).alias(f"z_{x}") for x, diff in diffs.items()],
    )


def beyond(scored: DataFrame, deviations: float, bytes_too: bool = False) -> DataFrame:
    """Rows more than so many deviations off in requests, or in bytes as well as an alternative."""
    hit = F.col("z_requests") > deviations
    if bytes_too:
        hit = hit | (F.col("z_bytes") > deviations)
    return scored.where(hit)


def with_severity(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Add ``severity``: the largest threshold that z_requests exceeds, 0 if none."""
    level: Column = F.lit(0)
    for threshold in sorted(thresholds):
        level = F.when(F.col("z_requests") > threshold, F.lit(threshold)).otherwise(level)
    return scored.withColumn("severity", level)


def severity_counts(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Rows beyond each threshold, per page; a row counts for every threshold it exceeds."""
    counts = scored.groupBy(*PAGE).agg(
        F.count("*").alias("rows_scored"),
        *[F.count_if(F.col("z_requests") > t).alias(f"beyond_{t}") for t in thresholds],
    )
    return counts
