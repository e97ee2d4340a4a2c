"""``python -m trafficlens <job> ...``, or the same through spark-submit."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from trafficlens import configure
from trafficlens.operators.windows import DAY, WEEK
from trafficlens.plans import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trafficlens")
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for argument in positional:
            p.add_argument(argument)
        return p

    def windows(p: argparse.ArgumentParser) -> None:
        p.add_argument("--size", type=int, default=WEEK)
        p.add_argument("--step", type=int, default=DAY)

    def source(p: argparse.ArgumentParser) -> None:
        p.add_argument("--table", action="store_true", help="read the table that ingest wrote")
        p.add_argument("--start", type=dt.date.fromisoformat)
        p.add_argument("--end", type=dt.date.fromisoformat)
        p.add_argument("--sep", default=" ")
        bad_lines(p)

    def bad_lines(p: argparse.ArgumentParser) -> None:
        p.add_argument("--mode", choices=["fail", "drop"], default="fail", help="what a bad line does")

    def counting(p: argparse.ArgumentParser) -> None:
        p.add_argument("--anchor", type=dt.datetime.fromisoformat)
        p.add_argument("--window-count", choices=["days", "loop"], default="days")

    filtering = job("filter", "dumps", "output", "whitelist")
    filtering.add_argument("--titles-only", action="store_true")
    filtering.add_argument("--table", action="store_true")
    bad_lines(filtering)
    ingest = job("ingest", "dumps", "output")
    ingest.add_argument("--folder", action="store_true", help="pass over files of other names")
    ingest.add_argument("--ledger", help="take in damaged files, and write here what of each was kept")
    bad_lines(ingest)
    stats = job("stats", "dumps", "output")
    stats.add_argument("--projects", nargs="+", default=["en", "de"])
    stats.add_argument("--table", action="store_true")
    bad_lines(stats)
    coverage = job("coverage", "folder", "output")
    coverage.add_argument("start", type=dt.date.fromisoformat)
    coverage.add_argument("end", type=dt.date.fromisoformat)
    roll = job("roll", "folder", "output")
    roll.add_argument("anchor", type=dt.datetime.fromisoformat)
    windows(roll)
    bad_lines(roll)
    moving = job("moving-average", "traffic", "output")
    moving.add_argument("--as-written", action="store_true")
    severity = job("severity", "traffic", "output")
    severity.add_argument("--last-window-only", action="store_true")
    for p in (moving, severity):
        windows(p)
        counting(p)
        source(p)
    page = job("page-windows", "traffic", "output", "project", "title")
    windows(page)
    source(page)
    regression = job("regression", "traffic", "project", "output")
    regression.add_argument("--grid-search", action="store_true")
    regression.add_argument("--log-target", action="store_true")
    regression.add_argument("--solver", choices=["gd", "ols"], default="gd")
    source(regression)
    job("anomalies-per-day", "anomalies", "output").add_argument("--k", type=int, default=5)
    job("top-anomalies", "anomalies", "output").add_argument("--k", type=int)
    series = job("page-series", "traffic", "output", "project", "title")
    series.add_argument("--model", choices=["moving_average", "regression", "traffic"])
    windows(series)
    source(series)
    return top


def regression_job(spark, **options) -> None:
    source = {k: options.pop(k) for k in ("table", "start", "end", "sep", "mode")}
    jobs.regression_job(spark, source=source, **options)


JOBS = {
    "filter": jobs.filter_job,
    "ingest": jobs.ingest_job,
    "stats": jobs.stats_job,
    "coverage": jobs.coverage_job,
    "roll": jobs.roll_job,
    "moving-average": jobs.moving_average_job,
    "severity": jobs.severity_job,
    "page-windows": jobs.page_windows_job,
    "regression": regression_job,
    "anomalies-per-day": jobs.anomalies_per_day_job,
    "top-anomalies": jobs.top_anomalies_job,
    "page-series": jobs.page_series_job,
}


def main(argv: list[str] | None = None) -> None:
    options = vars(parser().parse_args(argv))
    job = JOBS[options.pop("job")]
    spark = configure(SparkSession.builder.appName("trafficlens").getOrCreate())
    job(spark, **options)


if __name__ == "__main__":
    main()
