"""Every operator as a query over the driver's tables, events read as hourly traffic.

Doubles are rounded to six places and hours given as year, month, day and hour, so that results
compare by value with the SQL in checks/oracles.py.
"""

from __future__ import annotations

import datetime as dt
import gzip
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import configure
from trafficlens.functions.hours import calendar_fields, hour_number
from trafficlens.operators import anomalies, filters, regression, scoring, series, stats, windows
from trafficlens.plans import jobs
from trafficlens.plans.incremental import hours_in, new_window_models, roll_forward, roll_hours, roll_regression
from trafficlens.schema import PAGE, TRAFFIC_FIELDS
from trafficlens.session import scratch_path
from trafficlens.sinks import write_text, write_traffic_table
from trafficlens.sources import (
    coverage_gaps,
    events_as_traffic,
    first_version,
    parse_dump_lines,
    paths_for_hours,
    read_anomalies,
    read_dump_file,
    read_dumps,
    read_folder,
    read_traffic,
    read_whitelist,
)
from trafficlens.sources.account import ingest_with_account
from trafficlens.streaming.rolling import RollingPaths, roll_round, rolled_anomalies, rolled_traffic

# One page is listed twice.
LISTED = [("en", "click"), ("de", "error"), ("en", "click")]
SERIES_PAGE = ("all", "click")

Query = Callable[[SparkSession, str], DataFrame]


# ---- inputs ---------------------------------------------------------------------------------

def events(spark: SparkSession, sf: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/events.parquet")


def traffic_all(spark: SparkSession, sf: str) -> DataFrame:
    return events_as_traffic(events(spark, sf), F.lit("all"), F.col("event_type"))


def traffic_langs(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("user_id") % 3
    language = F.when(third == 0, "en").when(third == 1, "de").otherwise("fr")
    return events_as_traffic(events(spark, sf), language, F.col("event_type"))


def traffic_users(spark: SparkSession, sf: str) -> DataFrame:
    """A page per user, but for a third of the users, who share one hot page."""
    title = F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("user_id")))
    return events_as_traffic(events(spark, sf), F.lit("users"), title)


def bounds(traffic: DataFrame):
    """First and last hour as datetimes: one row read from the hour columns."""
    row = stats.time_bounds(traffic).select(
        F.expr("timestampadd(HOUR, first_hour, timestamp_ntz'1970-01-01 00:00:00')").alias("a"),
        F.expr("timestampadd(HOUR, last_hour, timestamp_ntz'1970-01-01 00:00:00')").alias("z"),
    ).first()
    return row["a"], row["z"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, scaled first as DuckDB does: for large values, whose sixth place a
    double hardly holds, rounding the decimal digits instead can differ in the last one."""
    kinds = dict(df.dtypes)
    return df.select(*[
        (F.round(F.col(c) * 1e6, 0) / 1e6).alias(c) if kinds[c] == "double" else F.col(c)
        for c in df.columns
    ])


def stamps_as_text(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[
        F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c] == "timestamp_ntz" else F.col(c)
        for c in df.columns
    ])


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "project string, title string")


# ---- sources and sinks ----------------------------------------------------------------------

def dump_lines(spark, sf):
    """Traffic printed as dump lines (with a surplus field, and lines too short), parsed back."""
    rows = traffic_langs(spark, sf)
    name = F.format_string(
        "/dumps/pagecounts-%04d%02d%02d-%02d0001.gz", "year", "month", "day", "hour"
    ).alias("file_name")
    fields = ["project", "title", F.col("requests").cast("string"), F.col("bytes").cast("string")]
    good = F.concat_ws(" ", *fields, F.lit("surplus"))
    short = F.concat(F.concat_ws(" ", *fields[:3]), F.lit(" "))
    lines = rows.select(F.explode(F.array(good, short)).alias("value"), name)
    return parse_dump_lines(lines).select(*TRAFFIC_FIELDS)


def traffic_text_roundtrip(spark, sf):
    path = scratch_path(spark, "traffic-text")
    write_text(traffic_langs(spark, sf).select(*TRAFFIC_FIELDS), path)
    return read_traffic(spark, path).select(*TRAFFIC_FIELDS)


def anomalies_text_roundtrip(spark, sf):
    path = scratch_path(spark, "anomalies-text")
    write_text(ma_anomalies(spark, sf), path)
    return rounded(read_anomalies(spark, path))


def listing(spark, sf):
    """Every event as a file version of its hour, in a listing of its own type."""
    ts = F.col("ts")
    return events(spark, sf).select(
        F.col("event_type").alias("title"),
        hour_number(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts)).alias("hour_no"),
        (F.col("user_id") % 12).alias("version"),
    )


def hour_versions(spark, sf):
    found = first_version(listing(spark, sf), ("title",))
    return found.select("title", *calendar_fields("hour_no"), F.col("version").cast("bigint").alias("version"))


def hour_coverage_gaps(spark, sf):
    span = stats.time_bounds(traffic_all(spark, sf))
    hours = span.select(F.explode(F.sequence("first_hour", "last_hour")).alias("hour_no"))
    listed = listing(spark, sf)
    expected = listed.select("title").distinct().join(hours, F.lit(True))
    gaps = coverage_gaps(expected, listed, ("title",))
    return gaps.select(
        "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "missing_hours",
        F.date_format("first_missing", "yyyy-MM-dd HH:mm:ss").alias("first_missing"),
    )


def dump_folder(spark, sf, damaged: bool = False) -> str:
    """A folder of gz dump files, one per hour, written from the events; once per session and input.

    Damaged ones end with a line of two fields and one of 70,000 characters, and of the last hour's
    archive the second half is missing.
    """
    key = (spark.sparkContext.applicationId, sf, damaged)
    if key not in DUMPS:
        folder = scratch_path(spark, "dumps")
        name = F.format_string("pagecounts-%04d%02d%02d-%02d0000.gz", "year", "month", "day", "hour")
        lines = traffic_langs(spark, sf).select(
            name.alias("name"), F.concat_ws(" ", "project", "title", F.col("requests").cast("string"), F.col("bytes").cast("string")).alias("line"))
        last = f"pagecounts-{bounds(traffic_all(spark, sf))[1]:%Y%m%d-%H}0000.gz" if damaged else None

        def write(table: pa.Table) -> pa.Table:
            system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
            system.create_dir(base, recursive=True)
            name = table.column("name")[0].as_py()
            text = "".join(f"{x}\n" for x in table.column("line").to_pylist())
            if damaged:
                text += "short line\n" + "en " + "x" * 70_000 + " 1 1\n"
            data = gzip.compress(text.encode())
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data[: len(data) // 2] if name == last else data)
            return pa.table({"rows": pa.array([table.num_rows])})

        lines.groupBy("name").applyInArrow(write, "rows bigint").agg(F.sum("rows")).collect()
        DUMPS[key] = folder
    return DUMPS[key]


DUMPS: dict = {}


def dump_files(spark, sf):
    """Gz dumps of a folder, read back."""
    return read_dumps(spark, dump_folder(spark, sf)).select(*TRAFFIC_FIELDS)


def dump_hour_globs(spark, sf):
    """The dumps of all hours from the first to the last, by one glob an hour."""
    first, last = bounds(traffic_all(spark, sf))
    hours = 1 + int((last - first).total_seconds()) // 3600
    return read_dumps(spark, paths_for_hours(dump_folder(spark, sf), first, hours)).select(*TRAFFIC_FIELDS)


def dump_single_file(spark, sf):
    """The dump of the first hour, with its nested time."""
    first, _ = bounds(traffic_all(spark, sf))
    rows = read_dump_file(spark, f"{dump_folder(spark, sf)}/pagecounts-{first:%Y%m%d-%H}0000.gz")
    return rows.select("project", "title", "requests", "bytes", "time.*")


def dump_folder_versions(spark, sf):
    """The folder's hours, each from its lowest version."""
    return read_folder(spark, dump_folder(spark, sf)).select(*TRAFFIC_FIELDS)


def dump_ledger(spark, sf):
    """What of each damaged dump was kept; of the cut archive only that it is cut."""
    ledger, _ = ingest_with_account(spark, dump_folder(spark, sf, damaged=True), scratch_path(spark, "damaged"))
    whole = lambda c: F.when(~F.col("cut_off"), F.col(c)).alias(c)
    return ledger.select(F.substring_index("path", "/", -1).alias("file"), *map(whole, ("lines", "kept", "short", "too_long", "bad_number")), "cut_off")


def whitelist_file(spark, sf):
    path = scratch_path(spark, "whitelist")
    write_text(whitelist(spark), path)
    return filters.on_whitelist(traffic_langs(spark, sf), read_whitelist(spark, path)).select(*TRAFFIC_FIELDS)


def filter_job(spark, sf):
    """Dumps and a whitelist file through the job, its text read back."""
    path = scratch_path(spark, "filter-job")
    write_text(whitelist(spark), f"{path}/whitelist")
    jobs.filter_job(spark, dump_folder(spark, sf), path, f"{path}/whitelist")
    return read_traffic(spark, f"{path}/filtered").select(*TRAFFIC_FIELDS)


def stats_job(spark, sf):
    path = scratch_path(spark, "stats-job")
    jobs.stats_job(spark, dump_folder(spark, sf), path)
    parts = F.split("value", " ")
    kinds = ("string", "string", "double", "double", "bigint", "bigint")
    names = ("project", "title", "avg_requests", "avg_bytes", "max_requests", "max_bytes")
    rows = spark.read.text(f"{path}/stats")
    return rounded(rows.select(*[parts[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]))


def stored_traffic(spark, sf) -> str:
    path = scratch_path(spark, "traffic-table")
    write_traffic_table(traffic_all(spark, sf), path)
    return path


def table_daily_anomalies(spark, sf):
    """The moving-average job on the table that ingest writes."""
    path = scratch_path(spark, "moving-average-job")
    jobs.moving_average_job(spark, stored_traffic(spark, sf), path, table=True)
    return rounded(read_anomalies(spark, f"{path}/daily_anomalies"))


def table_regression_daily(spark, sf):
    """The regression job on the table that ingest writes."""
    path = scratch_path(spark, "regression-job")
    jobs.regression_job(spark, stored_traffic(spark, sf), "all", path, source={"table": True})
    return rounded(read_anomalies(spark, f"{path}/anomalies"))


# ---- filters and summaries ------------------------------------------------------------------

def project_filter(spark, sf):
    return filters.in_projects(traffic_langs(spark, sf)).select(*TRAFFIC_FIELDS)


def page_filter(spark, sf):
    return filters.of_page(traffic_langs(spark, sf), "en", "click").select(*TRAFFIC_FIELDS)


def whitelist_semi(spark, sf):
    return filters.on_whitelist(traffic_langs(spark, sf), whitelist(spark)).select(*TRAFFIC_FIELDS)


def whitelist_titles(spark, sf):
    """Listed titles in every project."""
    titles = whitelist(spark).select("title")
    return filters.on_whitelist(traffic_langs(spark, sf), titles).select(*TRAFFIC_FIELDS)


def whitelist_join(spark, sf):
    rows = filters.on_whitelist(traffic_langs(spark, sf), whitelist(spark), dedupe=False)
    return rows.select(*TRAFFIC_FIELDS)


def day_sums(spark, sf):
    return stats.day_sums(filters.in_projects(traffic_langs(spark, sf)))


def page_stats(spark, sf):
    return rounded(stats.page_stats(day_sums(spark, sf)))


def time_bounds(spark, sf):
    return stats.time_bounds(traffic_all(spark, sf))


def edge_records(spark, sf):
    return stats.edge_records(traffic_all(spark, sf))


def running_totals(spark, sf):
    """Each hour of traffic as one fetched file."""
    log = traffic_all(spark, sf).groupBy("year", "month", "day", "hour").agg(
        F.sum("bytes").alias("bytes"), (F.sum("requests") * 0.25).alias("seconds")
    )
    log = log.select(hour_number("year", "month", "day", "hour").alias("hour_no"), "bytes", "seconds")
    return rounded(stats.running_totals(log).drop("date"))


def distinct_titles(spark, sf):
    return anomalies.distinct_titles(filters.in_projects(traffic_langs(spark, sf), ("en",)))


# ---- windows --------------------------------------------------------------------------------

def _models(df):
    return rounded(stamps_as_text(df))


def window_models(spark, sf):
    return _models(windows.window_models(traffic_all(spark, sf), window_count="loop",
                                         drop_zero_variance=False))


def window_models_nonzero(spark, sf):
    return _models(windows.window_models(traffic_langs(spark, sf)))


def users_window_models(spark, sf):
    return _models(windows.window_models(traffic_users(spark, sf)))


def users_daily_anomalies(spark, sf):
    return rounded(anomalies.moving_average_anomalies(traffic_users(spark, sf)))


def users_severity_counts(spark, sf):
    return scoring.severity_counts(_scored(traffic_users(spark, sf)))


def window_models_ragged(spark, sf):
    """Steps that do not divide the size: 50 hours every 7."""
    return _models(windows.window_models(traffic_langs(spark, sf), size=50, step=7))


def window_models_sparse(spark, sf):
    """Steps wider than the window: 12 hours every 31."""
    return _models(windows.window_models(traffic_langs(spark, sf), size=12, step=31))


def window_models_by_page(spark, sf):
    """Windows anchored at each page's own first hour."""
    return _models(windows.window_models(traffic_langs(spark, sf), anchor="page"))


def window_models_builtin(spark, sf):
    traffic = traffic_all(spark, sf)
    first, last = bounds(traffic)
    return _models(windows.window_models_builtin(traffic, first, last))


def incremental_equals_full(spark, sf):
    """Windows 0..9 of a first run, the rest by a later run that reads recent hours only."""
    traffic = traffic_all(spark, sf)
    first, last = bounds(traffic)
    seen = first + dt.timedelta(hours=windows.WEEK + 9 * windows.DAY + 1)
    early = windows.window_models(
        filters.until(traffic, seen), anchor=first, last=seen, window_count="loop"
    )
    late = new_window_models(traffic, first, last, from_window=10)
    return _models(early.unionByName(late))


def rolled_window_models(spark, sf):
    """The table of models after two rounds: traffic up to day 12, then all of it."""
    traffic = traffic_all(spark, sf)
    first, last = bounds(traffic)
    table, models = scratch_path(spark, "rolled-traffic"), scratch_path(spark, "rolled-models")
    for seen in (first + dt.timedelta(days=12), last):
        write_traffic_table(filters.until(traffic, seen), table)
        roll_forward(spark, table, models, anchor=first)
    return _models(spark.read.parquet(models).drop("window_mid_date"))


def rolled_out_of_order(spark, sf):
    """The table of models after four rounds that bring days in no order of time."""
    traffic = traffic_all(spark, sf)
    first, _ = bounds(traffic)
    table, models = scratch_path(spark, "unordered-traffic"), scratch_path(spark, "unordered-models")
    before = None
    for number in (2, 0, 3, 1):
        batch = traffic.where(F.pmod(F.dayofyear("ts") * 7, F.lit(4)) == number)
        write_traffic_table(batch, f"{table}/batch={number}")
        hours = hours_in(batch)
        newest = max(hours[-1:] + ([] if before is None else [before]), default=None)
        if hours:
            roll_hours(spark, table, models, first, hours, before, newest)
        before = newest
    return _models(spark.read.parquet(models).drop("window_mid_date"))


def _rolled(spark, batches, anchor) -> RollingPaths:
    """The tables of a rolling run whose rounds bring these rows."""
    base = scratch_path(spark, "rolled")
    paths = RollingPaths(f"{base}/traffic", f"{base}/models", f"{base}/checkpoint")
    for number, batch in enumerate(batches):
        roll_round(batch, number, paths, anchor)
    return paths


def rolled_daily_anomalies(spark, sf):
    """Anomalies of a rolling run of four rounds that bring days in no order of time."""
    traffic = traffic_langs(spark, sf).withColumn("version", F.lit(0).cast("bigint"))
    first, _ = bounds(traffic)
    part = F.pmod(F.dayofyear("ts") * 7, F.lit(4))
    return rounded(rolled_anomalies(spark, _rolled(spark, [traffic.where(part == k) for k in (2, 0, 3, 1)], first)))


def _versions(spark, sf) -> RollingPaths:
    """A rolling run in which every hour has two files, in rounds of their own: of even hours that of
    the higher version comes first, of odd ones that of the lower. Higher ones have other counts."""
    traffic = traffic_langs(spark, sf)
    first, _ = bounds(traffic)
    even = F.col("hour_no") % 2 == 0
    number = lambda a, b: F.when(even, a).otherwise(b).cast("bigint").alias("version")
    right = lambda: traffic.select("*", number(0, 1))
    wrong = lambda: traffic.withColumns({"requests": F.col("requests") * 3 + 5, "bytes": F.col("bytes") + 1}).select("*", number(7, 12))
    half = F.pmod(F.dayofyear("ts"), F.lit(2))
    batches = []
    for k in (1, 0):
        batches.append(wrong().where((half == k) & even).unionByName(right().where((half == k) & ~even)))
        batches.append(right().where((half == k) & even).unionByName(wrong().where((half == k) & ~even)))
    return _rolled(spark, batches, first)


def rolled_versions(spark, sf):
    """The rows that count after the rounds of :func:`_versions`."""
    return rolled_traffic(spark, _versions(spark, sf)).select(*TRAFFIC_FIELDS)


def rolled_versions_anomalies(spark, sf):
    """The anomalies after the same rounds."""
    return rounded(rolled_anomalies(spark, _versions(spark, sf)))


def kernel_weighted_mean(spark, sf):
    return _models(windows.kernel_means(traffic_langs(spark, sf)))


def _scored(traffic, how="inner", **kw):
    models = windows.window_models(traffic, **kw)
    return scoring.score(scoring.attach(traffic, models, how, step=kw.get("step", 24)))


SCORED = ["project", "title", "requests", "bytes", "avg_requests", "avg_bytes", "var_requests",
          "var_bytes", "diff_requests", "diff_bytes", "z_requests", "z_bytes",
          "year", "month", "day", "hour"]


def scored_rows(spark, sf):
    return rounded(_scored(traffic_all(spark, sf)).select(*SCORED))


def scored_rows_short_steps(spark, sf):
    """Several windows a day: the last one counts."""
    return rounded(_scored(traffic_langs(spark, sf), size=48, step=6).select("k", *SCORED))


def scored_rows_left(spark, sf):
    return rounded(_scored(traffic_all(spark, sf), "left").select(*SCORED, "has_model"))


def scored_rows_last_window(spark, sf):
    traffic = traffic_all(spark, sf)
    scored = scoring.score(scoring.attach_last_window(traffic))
    return rounded(scored.select(*SCORED, "has_model"))


def severity_counts(spark, sf):
    return scoring.severity_counts(_scored(traffic_langs(spark, sf)))


def severity_levels(spark, sf):
    scored = scoring.with_severity(_scored(traffic_langs(spark, sf)))
    return scored.groupBy("project", "severity").agg(F.count("*").alias("n"))


def anomalies_or_bytes(spark, sf):
    return rounded(scoring.beyond(_scored(traffic_langs(spark, sf)), 3, bytes_too=True).select(*SCORED))


# ---- anomalies ------------------------------------------------------------------------------

def ma_anomalies(spark, sf):
    return anomalies.moving_average_anomalies(traffic_langs(spark, sf))


def ma_daily_anomalies(spark, sf):
    return rounded(anomalies.moving_average_anomalies(traffic_all(spark, sf)))


def ma_daily_anomalies_short_steps(spark, sf):
    """Windows of 6 hours every 6: the last window of a day that has a model counts."""
    return rounded(anomalies.moving_average_anomalies(traffic_langs(spark, sf), 6, 6))


def ma_daily_anomalies_tiny_windows(spark, sf):
    """Windows of 12 hours every 6, more than one deviation off."""
    return rounded(anomalies.moving_average_anomalies(traffic_langs(spark, sf), 12, 6, deviations=1.0))


def ma_daily_anomalies_hours(spark, sf):
    """The same through scored hours."""
    return rounded(anomalies.daily_from_scores(_scored(traffic_all(spark, sf))))


def ma_daily_anomalies_as_written(spark, sf):
    return rounded(anomalies.daily_from_scores(_scored(traffic_all(spark, sf)), as_written=True))


def top5_per_day(spark, sf):
    return rounded(anomalies.top_per_day(ma_anomalies(spark, sf), 5))


def newsletter_distinct_pages(spark, sf):
    return rounded(anomalies.top_per_day(ma_anomalies(spark, sf), 5, distinct_pages=True))


def top_k_anomalies(spark, sf):
    return rounded(anomalies.top_k(ma_anomalies(spark, sf), 10))


def all_anomalies_numbered(spark, sf):
    return rounded(anomalies.numbered(ma_anomalies(spark, sf)))


def all_anomalies_ranked(spark, sf):
    return rounded(anomalies.top_k(ma_anomalies(spark, sf)))


# ---- regression -----------------------------------------------------------------------------

def _lagged(spark, sf):
    # The adapter already gives one row per page and hour.
    return regression.lagged(traffic_all(spark, sf))


def _sums(spark, sf):
    return regression.page_sums(_lagged(spark, sf))


def _residuals(spark, sf, **fit_options):
    return regression.page_regression(traffic_all(spark, sf), unique_hours=True, **fit_options)


def lag_features(spark, sf):
    rows = _lagged(spark, sf).where(regression.complete())
    return rows.select(*PAGE, "hour_id", *calendar_fields("hour_no"), "y", *regression.LAG_NAMES)


def page_moments(spark, sf):
    return rounded(regression.page_moments(_lagged(spark, sf)))


def regression_sums(spark, sf):
    sums = regression.enough(_sums(spark, sf))
    return rounded(sums.select(*PAGE, "hours", "n", *regression.SUM_COLUMNS))


def skipped_pages(spark, sf):
    return regression.skipped_pages(_sums(spark, sf), min_rows=480)


def skipped_pages_ols(spark, sf):
    return regression.skipped_pages(_sums(spark, sf), min_rows=480, solver="ols")


WEIGHTS = [*PAGE, *regression.WEIGHTS]


def regression_weights(spark, sf):
    return rounded(regression.fit(regression.enough(_sums(spark, sf))).select(*WEIGHTS))


def rolled_regression_weights(spark, sf):
    """Weights of three ranges of days from daily sums that came in three rounds, in no order."""
    traffic = traffic_langs(spark, sf)
    first, last = bounds(traffic)
    table, sums = scratch_path(spark, "regression-traffic"), scratch_path(spark, "regression-sums")
    for number, k in enumerate((1, 2, 0)):
        batch = traffic.where(F.pmod(F.dayofyear("ts") * 5, F.lit(3)) == k)
        write_traffic_table(batch, f"{table}/batch={number}")
        dates = [r.date for r in batch.select(F.col("ts").cast("date").alias("date")).distinct().collect()]
        roll_regression(spark, table, sums, dates)
    daily = spark.read.parquet(sums)
    begin, end = ((d.date() - dt.date(1970, 1, 1)).days for d in (first, last))
    found = []
    for k, (low, high) in enumerate(((begin, begin + 14), (begin + 5, begin + 20), (begin + 15, end))):
        weights = regression.fit(regression.enough(regression.range_sums(daily, low, high)))
        found.append(weights.select(F.concat(F.lit(f"{k} "), F.col("project")).alias("project"), "title", "hours", "n", *regression.WEIGHTS))
    return rounded(found[0].union(found[1]).union(found[2]))


def regression_weights_ols(spark, sf):
    return rounded(regression.fit(regression.enough(_sums(spark, sf)), "ols").select(*WEIGHTS))


def grid_search_best_step(spark, sf):
    best = regression.best_step(regression.enough(_sums(spark, sf)))
    return rounded(best.select(*PAGE, "step_size", "rss"))


def regression_residuals(spark, sf):
    return rounded(_residuals(spark, sf).drop("hour_no"))


def residual_threshold(spark, sf):
    found = _residuals(spark, sf).groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.max("threshold").alias("threshold")
    )
    return rounded(found)


def residual_quantile(spark, sf):
    return rounded(regression.residual_quantile(_residuals(spark, sf)))


def residual_quantile_approx(spark, sf):
    return rounded(regression.residual_quantile(_residuals(spark, sf), exact=False))


def rolled_residual_quantile(spark, sf):
    """The same from daily sketches that were stored, the days put together afterwards."""
    path = scratch_path(spark, "residual-sketches")
    sketches = regression.residual_sketches(_residuals(spark, sf))
    sketches.write.partitionBy("day_no").parquet(path)
    return rounded(regression.sketch_quantile(spark.read.schema(sketches.schema).parquet(path)))


def regression_daily_anomalies(spark, sf):
    return rounded(anomalies.daily_from_residuals(_residuals(spark, sf)))


def regression_daily_anomalies_grid(spark, sf):
    return rounded(anomalies.daily_from_residuals(_residuals(spark, sf, grid_search=True)))


# ---- series ---------------------------------------------------------------------------------

def traffic_series(spark, sf):
    return series.traffic_series(traffic_all(spark, sf), *SERIES_PAGE)


def ma_series(spark, sf):
    return rounded(series.moving_average_series(traffic_all(spark, sf), *SERIES_PAGE))


def regression_series(spark, sf):
    return rounded(series.regression_series(traffic_all(spark, sf), *SERIES_PAGE))


def regression_series_long(spark, sf):
    return rounded(series.long_form(series.regression_series(traffic_all(spark, sf), *SERIES_PAGE)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dump_lines, dump_files, dump_hour_globs, dump_single_file, dump_folder_versions, dump_ledger, whitelist_file,
        filter_job, stats_job, table_daily_anomalies, table_regression_daily, rolled_out_of_order,
        ma_daily_anomalies_short_steps, ma_daily_anomalies_tiny_windows, skipped_pages_ols, users_window_models, users_daily_anomalies, users_severity_counts,
        traffic_text_roundtrip, anomalies_text_roundtrip, hour_versions,
        hour_coverage_gaps, project_filter, page_filter, whitelist_semi, whitelist_titles,
        whitelist_join, day_sums,
        page_stats, time_bounds, edge_records, running_totals, distinct_titles, window_models,
        window_models_nonzero, window_models_ragged, window_models_sparse, window_models_by_page,
        window_models_builtin, incremental_equals_full, rolled_window_models,
        rolled_daily_anomalies, rolled_versions, rolled_versions_anomalies,
        kernel_weighted_mean, scored_rows,
        scored_rows_short_steps, scored_rows_left, scored_rows_last_window, severity_counts,
        severity_levels, anomalies_or_bytes, ma_daily_anomalies, ma_daily_anomalies_hours,
        ma_daily_anomalies_as_written, top5_per_day, newsletter_distinct_pages, top_k_anomalies,
        all_anomalies_ranked, all_anomalies_numbered, rolled_regression_weights, lag_features, page_moments, regression_sums, skipped_pages,
        regression_weights, regression_weights_ols, grid_search_best_step, regression_residuals,
        residual_threshold, residual_quantile, residual_quantile_approx, rolled_residual_quantile,
        regression_daily_anomalies, regression_daily_anomalies_grid, traffic_series, ma_series,
        regression_series, regression_series_long,
    )
}
