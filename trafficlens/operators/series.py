"""Aligned series of one page, ready for a chart: one row per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.filters import require_page
from trafficlens.operators.regression import page_regression
from trafficlens.operators.scoring import attach, score
from trafficlens.operators.windows import DAY, WEEK, window_models

HOUR = ["year", "month", "day", "hour"]
MOVING_AVERAGE_SERIES = ("model", "original", "residual", "deviations_3", "upper", "lower")
REGRESSION_SERIES = ("model", "original", "residual", "threshold", "upper")


def traffic_series(traffic: DataFrame, project: str, title: str) -> DataFrame:
    """Requests of one page by hour; of several rows for an hour the largest is kept."""
    page = require_page(traffic, project, title)
    return page.groupBy(*HOUR).agg(F.max("requests").alias("original"))


def moving_average_series(
    traffic: DataFrame, project: str, title: str, size: int = WEEK, step: int = DAY
) -> DataFrame:
    """Window mean, original, residual, three deviations, and the band mean -/+ three deviations.

    Windows start at the page's first hour.
    """
    page = require_page(traffic, project, title)
    scored = score(attach(page, window_models(page, size, step), step=step))
    band = F.sqrt("var_requests") * 3
    series = {
        "model": F.col("avg_requests"),
        "original": F.col("requests").cast("double"),
        "residual": F.col("diff_requests"),
        "deviations_3": band,
        "upper": F.col("avg_requests") + band,
        "lower": F.col("avg_requests") - band,
    }
    return _one_per_hour(scored.select(*HOUR, *[c.alias(n) for n, c in series.items()]))


def regression_series(traffic: DataFrame, project: str, title: str, **fit_options) -> DataFrame:
    """Prediction, original, residual, the page's threshold and prediction + threshold."""
    page = require_page(traffic, project, title)
    found = page_regression(page, **fit_options)
    return found.select(
        *HOUR,
        F.col("predicted").alias("model"),
        "original",
        F.col("abs_diff").alias("residual"),
        "threshold",
        (F.col("predicted") + F.col("threshold")).alias("upper"),
    )


def long_form(wide: DataFrame) -> DataFrame:
    """One row per hour and series."""
    names = [c for c in wide.columns if c not in HOUR]
    return wide.unpivot(HOUR, names, "series", "value")


def _one_per_hour(series: DataFrame) -> DataFrame:
    """A chart holds one value per hour: of repeated hours keep the row with the largest original."""
    values = [c for c in series.columns if c not in HOUR]
    kept = F.max_by(F.struct(*values), "original").alias("kept")
    return series.groupBy(*HOUR).agg(kept).select(*HOUR, "kept.*")
