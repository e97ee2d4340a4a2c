"""The jobs: input paths in, output folders written."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators.anomalies import (
    daily_from_residuals,
    daily_from_scores,
    moving_average_anomalies,
    top_k,
    top_per_day,
)
from trafficlens.operators.filters import in_projects, on_whitelist, require_page
from trafficlens.operators.regression import lagged, page_regression, page_sums, skipped_pages
from trafficlens.operators.scoring import (
    attach,
    attach_last_window,
    score,
    with_severity,
)
from trafficlens.operators.series import moving_average_series, regression_series, traffic_series
from trafficlens.operators.stats import day_sums, page_stats
from trafficlens.operators.windows import DAY, WEEK, window_models
from trafficlens.schema import TRAFFIC_FIELDS, hourly
from trafficlens.sinks import write_by, write_text, write_traffic_table, write_window_models
from trafficlens.sources import (
    coverage_gaps,
    expected_hours,
    list_dumps,
    read_anomalies,
    read_dumps,
    read_folder,
    read_traffic,
    read_traffic_table,
    read_whitelist,
    table_bounds,
)
from trafficlens.sources.account import ingest_with_account
from trafficlens.streaming.rolling import roll_dumps

SCORED_FIELDS = (
    "project", "title", "requests", "bytes", "avg_requests", "avg_bytes", "var_requests",
    "var_bytes", "diff_requests", "diff_bytes", "z_requests", "z_bytes",
    "year", "month", "day", "hour",
)


def load_traffic(
    spark: SparkSession, path: str, table: bool = False, sep: str = " ", mode: str = "fail",
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Traffic from prepared text, or from a table that ``ingest`` wrote, of which dates outside
    [start, end] are not read."""
    if table:
        return read_traffic_table(spark, path, start, end)
    rows = read_traffic(spark, path, sep, mode)
    date = F.make_date("year", "month", "day")
    if start is not None:
        rows = rows.where(date >= F.lit(start))
    return rows if end is None else rows.where(date <= F.lit(end))


def _window_bounds(spark, path: str, anchor, source: dict) -> dict:
    """Anchor and last hour for window operators. A table tells them by its dates and two of its
    days, so that the rows are read once; text is left to the operator."""
    if anchor is not None:
        return {"anchor": anchor}
    if not source.get("table"):
        return {}
    found = table_bounds(spark, path, source.get("start"), source.get("end"))
    return {} if found is None else {"anchor": found[0], "last": found[1]}


def _raw(spark: SparkSession, dumps: str, table: bool, mode: str) -> DataFrame:
    return read_traffic_table(spark, dumps) if table else read_dumps(spark, dumps, mode)


def filter_job(
    spark: SparkSession, dumps: str, output: str, whitelist: str, titles_only: bool = False,
    dedupe: bool = True, table: bool = False, mode: str = "fail",
) -> None:
    """Raw dumps (or the table) to prepared text traffic of the whitelisted pages."""
    listed = read_whitelist(spark, whitelist, titles_only=titles_only)
    rows = on_whitelist(_raw(spark, dumps, table, mode), listed, dedupe)
    write_text(rows.select(*TRAFFIC_FIELDS), f"{output}/filtered")


def ingest_job(spark: SparkSession, dumps: str, output: str, mode: str = "fail", folder: bool = False, ledger: str | None = None) -> None:
    """Raw dumps to a date-partitioned table, so later jobs read columns and dates they need.

    Every hour comes from its lowest version alone; with ``folder`` files of other names are passed
    over. With a ``ledger`` damage does not stop the job: what of each file was kept is written there.
    """
    if ledger is not None:
        account, _ = ingest_with_account(spark, dumps, output)
        write_text(account, ledger, sep="\t")
        return
    read = read_folder if folder else read_dumps
    write_traffic_table(read(spark, dumps, mode), output)


def stats_job(
    spark: SparkSession, dumps: str, output: str, projects=("en", "de"), table: bool = False, mode: str = "fail",
) -> None:
    """Raw dumps (or the table) to day sums and page statistics; the second reads what the first wrote."""
    sums_path = f"{output}/day_sums"
    sums = day_sums(in_projects(_raw(spark, dumps, table, mode), projects))
    sums.write.mode("overwrite").parquet(sums_path)
    write_text(page_stats(spark.read.parquet(sums_path)), f"{output}/stats")


def coverage_job(spark: SparkSession, folder: str, output: str, start: dt.date, end: dt.date) -> None:
    """The hours from start up to, not including, end that no file of a folder serves, by day."""
    midnight = lambda d: dt.datetime(d.year, d.month, d.day)
    expected = expected_hours(spark, midnight(start), midnight(end))
    write_text(coverage_gaps(expected, list_dumps(spark, folder)).orderBy("date"), f"{output}/missing", sep="\t")


def roll_job(
    spark: SparkSession, folder: str, output: str, anchor: dt.datetime, size: int = WEEK, step: int = DAY,
    mode: str = "fail",
) -> None:
    """Take in the dump files of a folder that are new since the last run, and bring models up to date."""
    query = roll_dumps(spark, folder, f"{output}/traffic", f"{output}/models", f"{output}/checkpoint", anchor, size, step, mode=mode)
    query.awaitTermination()


def moving_average_job(
    spark: SparkSession, traffic: str, output: str, size: int = WEEK, step: int = DAY,
    as_written: bool = False, anchor: dt.datetime | None = None, window_count: str = "days", **source,
) -> None:
    """Prepared traffic to per-day anomalies of every page."""
    rows = load_traffic(spark, traffic, **source)
    options = dict(size=size, step=step, window_count=window_count, **_window_bounds(spark, traffic, anchor, source))
    if as_written:
        scored = score(attach(rows, window_models(rows, **options), step=step))
        days = daily_from_scores(scored, as_written=True)
    else:
        days = moving_average_anomalies(rows, **options)
    write_text(days, f"{output}/daily_anomalies")


def severity_job(
    spark: SparkSession, traffic: str, output: str, size: int = WEEK, step: int = DAY,
    last_window_only: bool = False, anchor: dt.datetime | None = None, window_count: str = "days", **source,
) -> None:
    """Prepared traffic to every scored hour, one folder per severity; unmodelled hours stay."""
    rows = load_traffic(spark, traffic, **source)
    options = dict(size=size, step=step, window_count=window_count, **_window_bounds(spark, traffic, anchor, source))
    if last_window_only:
        attached = attach_last_window(rows, **options)
    else:
        attached = attach(rows, window_models(rows, **options), how="left", step=step)
    scored = with_severity(score(attached))
    write_by(scored.select(*SCORED_FIELDS, "has_model", "severity"), f"{output}/scored_hours", "severity")


def page_windows_job(
    spark: SparkSession, traffic: str, output: str, project: str, title: str,
    size: int = WEEK, step: int = DAY, **source,
) -> None:
    """One page's window models and its scored hours; models of constant windows are kept."""
    rows = require_page(load_traffic(spark, traffic, **source), project, title)
    models = window_models(rows, size, step, window_count="loop", drop_zero_variance=False)
    models_path = f"{output}/window_models"
    write_window_models(models, models_path)
    stored = spark.read.parquet(models_path).drop("window_mid_date")
    scored = score(attach(rows, stored, all_windows=True))
    fields = [c for c in SCORED_FIELDS if not c.startswith(("avg_", "var_"))]
    write_text(scored.select(*fields), f"{output}/page_hours")


def regression_job(
    spark: SparkSession, traffic: str, project: str, output: str, min_rows: int = 7, log_target: bool = False,
    source: dict | None = None, **fit_options,
) -> None:
    """Prepared traffic to per-day regression anomalies of every page of a project, and the pages
    that got no model, with the reason."""
    rows = in_projects(load_traffic(spark, traffic, **(source or {})), (project,))
    found = page_regression(rows, min_rows, log_target=log_target, **fit_options)
    write_text(daily_from_residuals(found), f"{output}/anomalies")
    sums = page_sums(lagged(hourly(rows), log_target))
    skipped = skipped_pages(sums, min_rows, fit_options.get("solver", "gd"))
    write_text(skipped, f"{output}/skipped", sep="\t")


def anomalies_per_day_job(spark: SparkSession, anomalies: str, output: str, k: int = 5) -> None:
    """Largest anomalies of each day, each page once, all of them, ranked within the day."""
    found = top_per_day(read_anomalies(spark, anomalies), k, distinct_pages=True)
    write_text(found.orderBy("year", "month", "day", "rank"), f"{output}/per_day")


def top_anomalies_job(spark: SparkSession, anomalies: str, output: str, k: int | None = None) -> None:
    """Largest anomalies over all days, in order; without ``k`` every one."""
    write_text(top_k(read_anomalies(spark, anomalies), k), f"{output}/top")


def page_series_job(
    spark: SparkSession, traffic: str, output: str, project: str, title: str,
    model: str | None = None, size: int = WEEK, step: int = DAY, **source,
) -> None:
    """One page as chart series under "moving_average", "regression" or "traffic", or its rows
    without a model. Written with the separator it was read by.

    Rows without a model never overwrite an earlier extract.
    """
    rows = load_traffic(spark, traffic, **source)
    sep = source.get("sep", " ")
    if model is None:
        page = require_page(rows, project, title)
        write_text(page.select(*TRAFFIC_FIELDS), f"{output}/plot", sep, mode="errorifexists")
        return
    if model == "moving_average":
        series = moving_average_series(rows, project, title, size, step)
    elif model == "regression":
        series = regression_series(rows, project, title)
    elif model == "traffic":
        series = traffic_series(rows, project, title)
    else:
        raise ValueError(f"unknown model {model!r}")
    write_text(series, f"{output}/{model}_series", sep)
