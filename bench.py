"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores.
With BENCH_PAGES set, traffic of so many pages over 720 hours is generated instead (one page also
holds every hour of a thousandth of the others, once more), and the main operators are timed on it.
Each query runs once to warm up, then its best of three counts. Results go to a no-op sink, so
every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries import QUERIES
from trafficlens import configure
from trafficlens.functions.hours import calendar_fields
from trafficlens.operators.anomalies import daily_from_residuals, moving_average_anomalies
from trafficlens.operators.regression import page_regression
from trafficlens.operators.scoring import attach, score
from trafficlens.operators.windows import window_models
from trafficlens.session import scratch_path
from trafficlens.sinks import write_traffic_table
from trafficlens.sources import read_traffic_table

HEADLINE = (
    "day_sums", "page_stats", "whitelist_semi", "dump_lines", "window_models_nonzero",
    "kernel_weighted_mean", "scored_rows", "severity_counts", "ma_daily_anomalies", "top5_per_day",
    "newsletter_distinct_pages", "lag_features", "regression_weights", "regression_weights_ols",
    "grid_search_best_step", "regression_residuals", "regression_daily_anomalies",
    "incremental_equals_full", "running_totals",
)
# Timed as well, but not part of the total, which stays comparable between rounds.
MANY_PAGES = ("users_window_models", "users_daily_anomalies", "users_severity_counts")


def generated(spark: SparkSession, pages: int, hours: int = 720) -> DataFrame:
    """Pages times hours rows of traffic with a daily rhythm, noise from a hash, and a hot page."""
    rows = spark.range(pages * hours).select((F.col("id") % pages).alias("page"), F.floor(F.col("id") / pages).alias("at"))
    rows = rows.unionByName(rows.where("page % 1000 = 1").withColumn("page", F.lit(0)))
    noise = F.pmod(F.xxhash64("page", "at"), F.lit(50))
    requests = 100 + noise + F.when(noise == 49, 900).otherwise(0) + F.pmod("at", F.lit(24)) * 3
    hour = F.col("at") + 24 * 16071  # from 2014-01-01
    return rows.select(
        F.lit("en").alias("project"), F.concat(F.lit("Page_"), F.col("page")).alias("title"), requests.alias("requests"),
        (requests * 1000 + noise).alias("bytes"), *calendar_fields(hour), hour.alias("hour_no"))


def scale(spark: SparkSession, pages: int) -> None:
    path = scratch_path(spark, "bench-traffic")
    write_traffic_table(generated(spark, pages), path)
    rows = read_traffic_table(spark, path)
    jobs = {
        "window_models": lambda: window_models(rows),
        "daily_anomalies": lambda: moving_average_anomalies(rows),
        "scored_hours": lambda: score(attach(rows, window_models(rows), step=24)),
        "regression_daily": lambda: daily_from_residuals(page_regression(rows)),
        "regression_grid": lambda: daily_from_residuals(page_regression(rows, grid_search=True)),
    }
    seconds = {}
    for name, job in jobs.items():
        for turn in range(2):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"metric": f"operators on {pages} pages, second run", "unit": "sec", "queries": seconds}))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("trafficlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_PAGES"):
        scale(configure(spark), int(os.environ["BENCH_PAGES"]))
        return

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in (*HEADLINE, *MANY_PAGES):
        run(name)
        seconds[name] = round(min(run(name) for _ in range(3)), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total of best times",
        "value": round(sum(seconds[name] for name in HEADLINE), 3),
        "unit": "sec",
        "many_pages": round(sum(seconds[name] for name in MANY_PAGES), 3),
        "queries": seconds,
        "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
