import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import row
from trafficlens.functions.hours import add_days, add_hours, diff_days, diff_hours, hour_number_of, timestamp_of
from trafficlens.functions.numeric import epanechnikov
from trafficlens.operators import anomalies, filters, series, stats
from trafficlens.schema import ANOMALIES_DDL


@pytest.fixture(scope="module")
def found(spark):
    rows = [("en", f"P{i}", 2014, 1, day, 10 * i, float(score), 1.0)
            for day in (1, 2) for i, score in enumerate([5, 9, 7, 7, 4, 8, 3 + day])]
    return spark.createDataFrame(rows, ANOMALIES_DDL).cache()


def test_top_of_each_day_with_ties(found):
    rows = anomalies.top_per_day(found, 3).orderBy("day", "rank").collect()
    assert [(r.day, r.title, r["rank"]) for r in rows] == [
        (1, "P1", 1), (1, "P5", 2), (1, "P2", 3), (2, "P1", 1), (2, "P5", 2), (2, "P2", 3)]


def test_each_page_once_at_its_best_day(found):
    rows = anomalies.top_per_day(found, 3, distinct_pages=True).collect()
    assert sorted((r.title, r.day) for r in rows) == [("P1", 1), ("P2", 1), ("P5", 1)]


def test_top_k(found):
    ranked = anomalies.top_k(found, 3).collect()
    assert [(r.title, r.day) for r in ranked] == [("P1", 1), ("P1", 2), ("P5", 1)]
    everything = [r.relative_to_quantile for r in anomalies.top_k(found).collect()]
    assert len(everything) == 14 and everything == sorted(everything, reverse=True)


def test_top_is_cut_before_the_shuffle(found):
    plan = anomalies.top_per_day(found)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_whitelist(make_traffic, spark):
    traffic = make_traffic([row((p, t), at, 1) for p in ("en", "de") for t in "ABC" for at in range(2)])
    listed = spark.createDataFrame([("en", "A"), ("en", "A"), ("de", "B")], "project string, title string")
    once = filters.on_whitelist(traffic, listed)
    assert sorted((r.project, r.title, r.hour) for r in once.collect()) == [
        ("de", "B", 5), ("de", "B", 6), ("en", "A", 5), ("en", "A", 6)]
    assert once.columns == traffic.columns
    assert filters.on_whitelist(traffic, listed, dedupe=False).count() == 2 * (2 + 1)
    titles = filters.on_whitelist(traffic, listed.select("title"))
    assert titles.count() == 2 * 2 * 2 and titles.columns == traffic.columns


def test_long_whitelist_is_not_broadcast(make_traffic, spark):
    listed = spark.range(20000).selectExpr("'en' as project", "cast(id as string) as title")
    traffic = make_traffic([row(("en", str(i)), 0, 1) for i in range(0, 40000, 1000)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        kept = filters.on_whitelist(traffic, listed)
        assert "SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_day_sums_and_page_stats(make_traffic):
    page = ("en", "P")
    traffic = make_traffic([row(page, 0, 10, 1), row(page, 1, 5, 2), row(page, 72, 6, 9), row(("fr", "P"), 0, 1)])
    sums = stats.day_sums(filters.in_projects(traffic))
    assert sorted((r.day, r.requests, r.bytes) for r in sums.collect()) == [(1, 15, 3), (4, 6, 9)]
    r = stats.page_stats(sums).first()
    assert (r.avg_requests, r.avg_bytes, r.max_requests, r.max_bytes) == (21 / 4, 3.0, 15, 9)


def test_running_totals(spark):
    log = spark.createDataFrame([(h, h % 5 * 10**6, 0.5) for h in range(100, 200)], "hour_no bigint, bytes bigint, seconds double")
    rows = stats.running_totals(log).orderBy("hour_no").collect()
    total = 0
    for i, r in enumerate(rows):
        total += r.hour_no % 5 * 10**6
        assert (r.files, r.total_bytes, r.total_seconds) == (i + 1, total, (i + 1) * 0.5)
        assert r.mean_speed == pytest.approx(total / 1e6 / ((i + 1) * 0.5))


def test_unknown_page(sample):
    with pytest.raises(ValueError, match="Page not found"):
        series.traffic_series(sample, "en", "Nowhere")


def test_series(sample):
    wide = series.moving_average_series(sample, "en", "Dense")
    assert wide.columns == series.HOUR + list(series.MOVING_AVERAGE_SERIES)
    for r in wide.collect():
        assert r.residual == pytest.approx(abs(r.model - r.original))
        assert (r.upper + r.lower) / 2 == pytest.approx(r.model)
        assert r.upper - r.model == pytest.approx(r.deviations_3)
    long = series.long_form(wide)
    assert long.count() == 6 * wide.count()
    fitted = series.regression_series(sample, "en", "Dense")
    assert fitted.columns == series.HOUR + list(series.REGRESSION_SERIES)
    for r in fitted.collect():
        assert r.upper == pytest.approx(r.model + r.threshold)


def test_one_point_per_hour(sample):
    points = series.traffic_series(sample, "de", "Gaps")
    assert points.count() == points.select(*series.HOUR).distinct().count()
    top = points.where("original >= 44").collect()
    assert [r.original for r in top] == [45]


def test_time_functions(spark):
    df = spark.sql("select timestamp_ntz'2014-03-09 01:30:00' a, timestamp_ntz'2014-03-10 01:00:00' b")
    r = df.select(
        diff_hours("a", "b"), diff_days("a", "b"), diff_hours("b", "a"), add_hours("a", 1), add_days("a", -9),
        timestamp_of(hour_number_of("a")),
    ).first()
    assert tuple(r) == (23, 0, -23, dt.datetime(2014, 3, 9, 2, 30), dt.datetime(2014, 2, 28, 1, 30), dt.datetime(2014, 3, 9, 1))


def test_kernel(spark):
    values = spark.createDataFrame([(u,) for u in (-1.5, -1.0, 0.0, 0.5, 1.0, 2.0)], "u double")
    assert [r[0] for r in values.select(epanechnikov(F.col("u"))).collect()] == [0, 0, 0.75, 0.5625, 0, 0]


def test_titles(sample):
    assert {r.title for r in anomalies.distinct_titles(sample).collect()} == {"Dense", "Gaps", "Short"}


def test_running_totals_compute_the_log_once(spark, tmp_path):
    log = spark.range(200).select(F.col("id").alias("hour_no"), (F.col("id") * 3).alias("bytes"), F.lit(0.5).alias("seconds"))
    log.write.parquet(str(tmp_path / "log"))
    found = stats.running_totals(spark.read.parquet(str(tmp_path / "log")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    rows = found.orderBy("hour_no").collect()
    assert [r.files for r in rows] == list(range(1, 201))
    assert [r.total_bytes for r in rows] == [sum(3 * i for i in range(n + 1)) for n in range(200)]
