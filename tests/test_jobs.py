import datetime as dt
import gzip
import os

import pytest

import brute
from conftest import START, row
from trafficlens.__main__ import main, parser
from trafficlens.operators import anomalies, regression, windows
from trafficlens.plans import jobs
from trafficlens.plans.incremental import hours_in, roll_forward, roll_hours
from trafficlens.schema import TRAFFIC_FIELDS
from trafficlens.sinks import write_text, write_traffic_table
from trafficlens.sources import list_dumps, read_anomalies, read_folder, read_traffic, read_traffic_table, table_bounds
from trafficlens.streaming.rolling import roll_dumps


@pytest.fixture(scope="module")
def dumps(tmp_path_factory, sample_rows):
    folder = tmp_path_factory.mktemp("dumps")
    write_dumps(folder, sample_rows)
    return str(folder)


def write_dumps(folder, rows):
    files = {}
    for r in rows:
        name = "pagecounts-%04d%02d%02d-%02d0000.gz" % r[4:8]
        files.setdefault(name, []).append(" ".join(map(str, r[:4])))
    for name in sorted(files):
        with gzip.open(folder / name, "wt") as out:
            out.write("\n".join(files[name]) + "\n")


@pytest.fixture(scope="module")
def prepared(spark, sample, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prepared") / "traffic")
    write_text(sample.select(*TRAFFIC_FIELDS), path)
    return path


def test_filter_then_anomalies_then_reports(spark, dumps, sample_rows, tmp_path):
    (tmp_path / "white").write_text("en Dense\nde Gaps\nde Gaps\n")
    out = str(tmp_path / "out")
    jobs.filter_job(spark, dumps, out, str(tmp_path / "white"))
    kept = read_traffic(spark, f"{out}/filtered")
    assert kept.count() == sum(r[1] != "Short" for r in sample_rows)
    jobs.moving_average_job(spark, f"{out}/filtered", out)
    days = {tuple(r[:5]): tuple(r[5:]) for r in read_anomalies(spark, f"{out}/daily_anomalies").collect()}
    expected = brute.daily([r for r in sample_rows if r[1] != "Short"])
    assert days.keys() == expected.keys() and days
    for key, values in expected.items():
        assert days[key] == pytest.approx(values, rel=1e-12)
    main(["top-anomalies", f"{out}/daily_anomalies", out, "--k", "1"])
    assert spark.read.text(f"{out}/top").count() == 1
    main(["anomalies-per-day", f"{out}/daily_anomalies", out])
    pages = [tuple(r.value.split()[:2]) for r in spark.read.text(f"{out}/per_day").collect()]
    assert pages and len(set(pages)) == len(pages)
    jobs.moving_average_job(spark, f"{out}/filtered", out, as_written=True)
    assert read_anomalies(spark, f"{out}/daily_anomalies").count() >= len(expected)


def test_stats_job(spark, dumps, sample_rows, tmp_path):
    jobs.stats_job(spark, dumps, str(tmp_path), projects=("de",))
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/stats").collect())
    totals = {}
    for r in sample_rows:
        if r[0] == "de":
            totals.setdefault(r[1], []).append(r)
    assert [line.split()[1] for line in lines] == ["Gaps", "Short"]
    for line in lines:
        rows = totals[line.split()[1]]
        dates = [dt.date(*r[4:7]) for r in rows]
        assert float(line.split()[2]) == pytest.approx(sum(r[2] for r in rows) / ((max(dates) - min(dates)).days + 1))


def test_severity_job(spark, prepared, sample, tmp_path):
    jobs.severity_job(spark, prepared, str(tmp_path))
    rows = spark.read.parquet(f"{tmp_path}/scored_hours")
    assert rows.count() == sample.count()
    assert rows.where("severity > 0 and z_requests <= severity").isEmpty()
    jobs.severity_job(spark, prepared, str(tmp_path), last_window_only=True)
    assert spark.read.parquet(f"{tmp_path}/scored_hours").where("has_model").select("day").distinct().count() == 1


def test_page_windows_job(spark, prepared, tmp_path):
    jobs.page_windows_job(spark, prepared, str(tmp_path), "en", "Dense")
    assert spark.read.parquet(f"{tmp_path}/window_models").count() == 8
    assert spark.read.text(f"{tmp_path}/page_hours").count() == 8 * 24


def test_regression_job(spark, prepared, sample, tmp_path):
    jobs.regression_job(spark, prepared, "en", str(tmp_path))
    written = read_anomalies(spark, f"{tmp_path}/anomalies")
    direct = anomalies.daily_from_residuals(regression.page_regression(sample.where("project = 'en'")))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, direct.collect()))
    assert written.count() > 0


def test_page_series_job(spark, prepared, tmp_path):
    for model in (None, "moving_average", "regression"):
        jobs.page_series_job(spark, prepared, str(tmp_path), "en", "Dense", model)
    assert spark.read.text(f"{tmp_path}/plot").count() == 15 * 24
    with pytest.raises(Exception, match="already exists"):
        jobs.page_series_job(spark, prepared, str(tmp_path), "en", "Dense")
    with pytest.raises(ValueError, match="Page not found"):
        jobs.page_series_job(spark, prepared, str(tmp_path), "en", "Nowhere")


def test_reports_are_whole(spark, tmp_path):
    """More rows than a screenful: all of them are written, in order."""
    rows = [("en", f"P{i}", 2014, 1, 1 + i % 28, i, 3.0 + i / 100, 1.0) for i in range(2500)]
    frame = spark.createDataFrame(rows, "project string, title string, year int, month int, day int, "
                                        "visit_max bigint, relative_to_quantile double, relative_to_norm double")
    write_text(frame, f"{tmp_path}/in")
    main(["top-anomalies", f"{tmp_path}/in", str(tmp_path)])
    assert [r.value.split()[1] for r in spark.read.text(f"{tmp_path}/top").collect()] == [f"P{i}" for i in range(2499, -1, -1)]
    main(["anomalies-per-day", f"{tmp_path}/in", str(tmp_path), "--k", "1500"])
    assert spark.read.text(f"{tmp_path}/per_day").count() == 2500


def test_jobs_on_the_table(spark, sample, prepared, tmp_path):
    table = str(tmp_path / "table")
    write_traffic_table(sample, table)
    jobs.moving_average_job(spark, prepared, f"{tmp_path}/text")
    jobs.moving_average_job(spark, table, f"{tmp_path}/table-out", table=True)
    read = lambda which: sorted(map(tuple, read_anomalies(spark, f"{tmp_path}/{which}/daily_anomalies").collect()))
    assert read("text") == read("table-out") != []
    jobs.stats_job(spark, table, str(tmp_path), table=True)
    assert spark.read.text(f"{tmp_path}/stats").count() == 3


def test_a_date_range_reads_its_partitions_only(spark, sample, tmp_path):
    table = str(tmp_path / "table")
    write_traffic_table(sample, table)
    day = (START + dt.timedelta(days=3)).date()
    rows = jobs.load_traffic(spark, table, table=True, start=day, end=day)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert {(r.year, r.month, r.day) for r in rows.select("year", "month", "day").distinct().collect()} == {(day.year, day.month, day.day)}
    first, last = table_bounds(spark, table)
    assert first == START and last == START + dt.timedelta(hours=15 * 24 - 1)


def test_skipped_pages_are_written(spark, make_traffic, tmp_path):
    rows = [row(("en", "Flat"), at, 5) for at in range(120)] + [row(("en", "Few"), at, at) for at in range(50)]
    rows += [row(("en", "Line"), at, at) for at in range(120)] + [row(("en", "Good"), at, at * 37 % 101) for at in range(240)]
    write_text(make_traffic(rows).select(*TRAFFIC_FIELDS), f"{tmp_path}/in")
    for solver, expected in (("gd", {"Flat": "constant", "Few": "too few hours"}),
                             ("ols", {"Flat": "constant", "Few": "too few hours", "Line": "collinear"})):
        jobs.regression_job(spark, f"{tmp_path}/in", "en", str(tmp_path), solver=solver)
        lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/skipped").collect()]
        assert {x[1]: x[-1] for x in lines} == expected


def test_coverage_of_a_folder(spark, sample_rows, tmp_path):
    """Two versions of an hour count once; a missing hour is listed."""
    folder = tmp_path / "in"
    folder.mkdir()
    write_dumps(folder, [r for r in sample_rows if brute.at_of(r) != 30])
    first = sorted(folder.iterdir())[0]
    (folder / first.name.replace("0000.gz", "0001.gz")).write_bytes(first.read_bytes())
    (folder / "notes.txt").write_text("x")
    assert read_folder(spark, str(folder)).count() == sum(brute.at_of(r) != 30 for r in sample_rows)
    assert list_dumps(spark, str(folder)).where("version = 1").count() == 1
    day = START.date() + dt.timedelta(days=1)
    main(["coverage", str(folder), str(tmp_path), str(day), str(day + dt.timedelta(days=2))])
    missing = START + dt.timedelta(hours=30)
    assert [r.value for r in spark.read.text(f"{tmp_path}/missing").collect()] == [f"{missing:%Y-%m-%d}\t1\t{missing:%Y-%m-%d %H:%M:%S}"]


def test_text_keeps_its_columns(spark, tmp_path):
    frame = spark.createDataFrame([("a", None, 1), ("b", "x", None)], "p string, q string, n int")
    write_text(frame, f"{tmp_path}/ok")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/ok").collect()) == ["a \\N 1", "b x \\N"]
    with pytest.raises(Exception, match="contains the separator"):
        write_text(spark.createDataFrame([("a b", 1)], "p string, n int"), f"{tmp_path}/bad")
    empty = spark.createDataFrame([("en", "A", 2014, 1, 1, 5, 2.0, None)], "project string, title string, year int, "
                                  "month int, day int, visit_max bigint, relative_to_quantile double, relative_to_norm double")
    write_text(empty, f"{tmp_path}/null")
    for mode in ("fail", "drop"):
        assert [tuple(r) for r in read_anomalies(spark, f"{tmp_path}/null", mode=mode).collect()] == [tuple(r) for r in empty.collect()]


def test_series_with_tabs(spark, make_traffic, tmp_path):
    rows = [row(("en", "Two words"), at, at) for at in range(30)]
    write_text(make_traffic(rows).select(*TRAFFIC_FIELDS), f"{tmp_path}/in", sep="\t")
    jobs.page_series_job(spark, f"{tmp_path}/in", str(tmp_path), "en", "Two words", sep="\t")
    assert read_traffic(spark, f"{tmp_path}/plot", sep="\t").where("title = 'Two words'").count() == 30
    jobs.page_series_job(spark, f"{tmp_path}/in", str(tmp_path), "en", "Two words", "traffic", sep="\t")
    assert spark.read.text(f"{tmp_path}/traffic_series").count() == 30


def test_command_line():
    options = parser().parse_args(["moving-average", "in", "out", "--size", "48"])
    assert (options.job, options.size, options.step, options.as_written) == ("moving-average", 48, 24, False)


def full_models(sample):
    rows = windows.window_models(sample, anchor=START, window_count="loop").collect()
    return sorted((r.project, r.title, r.k, r.n, r.avg_requests, r.var_bytes) for r in rows)


def stored_models(spark, path):
    rows = spark.read.parquet(path).collect()
    return sorted((r.project, r.title, r.k, r.n, r.avg_requests, r.var_bytes) for r in rows)


def test_rolling_forward_in_steps(spark, sample, tmp_path):
    traffic, models = str(tmp_path / "traffic"), str(tmp_path / "models")
    added = []
    for days in (5, 9, 9, 15):
        write_traffic_table(sample.where(sample.ts < START + dt.timedelta(days=days)), traffic)
        added.append(roll_forward(spark, traffic, models, START))
    assert added == [0, 2, 0, 6]
    assert stored_models(spark, models) == full_models(sample)


def test_dumps_as_they_arrive(spark, sample, sample_rows, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    paths = [str(tmp_path / name) for name in ("traffic", "models", "checkpoint")]
    half = [r for r in sample_rows if brute.at_of(r) < 200]
    for rows in (half, sample_rows[len(half):]):
        write_dumps(folder, rows)
        query = roll_dumps(spark, str(folder), *paths, anchor=START, files_per_batch=60)
        query.awaitTermination(120)
        assert query.exception() is None
        query.stop()
    assert read_traffic_table(spark, paths[0]).count() == len(sample_rows)
    assert stored_models(spark, paths[1]) == full_models(sample)


@pytest.mark.parametrize("order", ["newest first", "one late", "round repeated"])
def test_dumps_in_any_order(spark, make_traffic, sample_rows, tmp_path, order):
    """Modification times that do not follow the hours, a file that comes a round late, a round done twice."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [r for r in sample_rows if brute.at_of(r) < 10 * 24]
    paths = [str(tmp_path / name) for name in ("traffic", "models", "checkpoint")]

    def run(files_per_batch=48):
        query = roll_dumps(spark, str(folder), *paths, anchor=START, size=48, files_per_batch=files_per_batch)
        query.awaitTermination(300)
        assert query.exception() is None
        query.stop()

    late = 60
    if order == "newest first":
        write_dumps(folder, rows)
        for age, file in enumerate(sorted(folder.iterdir())):
            os.utime(file, (1_700_000_000 - age * 100,) * 2)
        run()
    elif order == "one late":
        write_dumps(folder, [r for r in rows if brute.at_of(r) != late])
        run(240)
        write_dumps(folder, [r for r in rows if brute.at_of(r) == late])
        run()
    else:
        write_dumps(folder, rows)
        run(120)
        batch = read_traffic_table(spark, f"{paths[0]}/batch=1")
        hours = hours_in(batch)
        roll_hours(spark, paths[0], paths[1], START, hours, hours[0] - 1, hours[-1], 48)
    full = windows.window_models(make_traffic(rows), 48, anchor=START, window_count="loop").collect()
    assert stored_models(spark, paths[1]) == sorted((r.project, r.title, r.k, r.n, r.avg_requests, r.var_bytes) for r in full)
