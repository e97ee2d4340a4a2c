"""Rolling runs: versions of an hour, slice sums, daily anomalies."""

import datetime as dt
import gzip
import itertools
import os

import brute
import pytest
from conftest import START, row
from pyspark.sql import functions as F

from trafficlens.functions.hours import day_number
from trafficlens.operators import anomalies, regression, windows
from trafficlens.plans.incremental import roll_regression
from trafficlens.schema import ANOMALIES_DDL, hourly
from trafficlens.sinks import write_traffic_table
from trafficlens.sources import other_files, read_dumps, read_folder
from trafficlens.streaming import ledger, rolling


def dump(folder, at, version, rows):
    t = START + dt.timedelta(hours=at)
    with gzip.open(folder / f"pagecounts-{t:%Y%m%d-%H}{version:04d}.gz", "wt") as out:
        out.write("".join(f"{p} {t} {r} {b}\n" for p, t, r, b, *_ in rows))


def tables(tmp_path):
    return rolling.RollingPaths(*(str(tmp_path / n) for n in ("traffic", "models", "checkpoint")))


def run(spark, folder, paths, **options):
    query = rolling.roll_dumps(spark, str(folder), paths.traffic, paths.models, paths.checkpoint, anchor=START, **options)
    query.awaitTermination(300)
    assert query.exception() is None
    query.stop()


def rows_of(df):
    return sorted(tuple(r) for r in df.select("project", "title", "requests", "bytes", "year", "month", "day", "hour").collect())


def days_of(df):
    return {tuple(r[:5]): tuple(r[5:]) for r in df.collect()}


def same_days(got, expected):
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values, rel=1e-12)


@pytest.mark.parametrize("order", list(itertools.permutations([0, 1, 12])))
def test_lowest_version_serves_an_hour(order):
    known = []
    for batch, version in enumerate(order):
        known = ledger.served(known, [(5, version), (5, version), (6, 3)], batch)
    live = {h.hour_no: (h.version, h.batch) for h in known if h.state == ledger.LIVE}
    assert live == {5: (0, order.index(0)), 6: (3, 0)}
    states = [h.state for h in known if h.hour_no == 5]
    assert len(states) == 3 and states.count(ledger.LIVE) == 1
    # Within one round the lowest counts and the others are never written.
    one = ledger.served([], [(5, v) for v in order], 0)
    assert [(h.version, h.state) for h in one] == [(0, ledger.LIVE), (1, ledger.ASIDE), (12, ledger.ASIDE)]


def test_readers_take_the_lowest_version_whatever_it_is(spark, tmp_path):
    for at, version, requests in ((0, 0, 5), (0, 1, 6), (1, 10, 7), (2, 0, 8), (3, 12, 9), (3, 11, 10)):
        dump(tmp_path, at, version, [row(("en", "A"), at, requests)])
    expected = [5, 7, 8, 10]
    (tmp_path / "projectcounts-20140301-050000").write_text("en - 5 5\n")
    assert sorted(r.requests for r in read_folder(spark, str(tmp_path)).collect()) == expected
    assert other_files(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="projectcounts"):
        read_dumps(spark, str(tmp_path))
    globs = f"{tmp_path}/pagecounts-*"
    assert sorted(r.requests for r in read_dumps(spark, globs).collect()) == expected
    assert read_dumps(spark, globs, all_versions=True).count() == 6
    assert read_dumps(spark, str(tmp_path), mode="drop").count() == 4
    with pytest.raises(ValueError, match="no dump files"):
        read_dumps(spark, f"{tmp_path}/projectcounts*", mode="drop")


@pytest.mark.parametrize("files", [1000, 60])
def test_versions_in_a_stream(spark, sample_rows, make_traffic, tmp_path, files):
    """Two files for some hours, in one round or in several, the lower one first or last."""
    folder, paths = tmp_path / "in", tables(tmp_path)
    folder.mkdir()
    rows = [r for r in sample_rows if brute.at_of(r) < 240]
    by_hour = {at: [r for r in rows if brute.at_of(r) == at] for at in range(240)}
    wrong = lambda at: [(*r[:2], r[2] + 1000, *r[3:]) for r in by_hour[at]] + [row(("xx", "Only_wrong"), at, 3)]
    twice = {30: (0, 4), 31: (12, 10), 100: (0, 1), 101: (3, 2)}
    stamp = 1_700_000_000
    for at in range(240):
        dump(folder, at, twice.get(at, (0,))[0], wrong(at) if at in (31, 101) else by_hour[at])
    for k, file in enumerate(sorted(folder.iterdir())):
        os.utime(file, (stamp + k,) * 2)
    run(spark, folder, paths, size=48, files_per_batch=files)
    for at, (_, later) in twice.items():
        dump(folder, at, later, by_hour[at] if at in (31, 101) else wrong(at))
    run(spark, folder, paths, size=48, files_per_batch=files)
    full = make_traffic(rows)
    assert rows_of(rolling.rolled_traffic(spark, paths)) == rows_of(full)
    expected = anomalies.moving_average_anomalies(full, 48, anchor=START, window_count="loop", deviations=2.0)
    same_days(days_of(rolling.rolled_anomalies(spark, paths, 2.0)), days_of(expected))
    states = [h.state for h in ledger.hours_known(spark, paths.hours)]
    assert states.count(ledger.LIVE) == 240 and states.count(ledger.REPLACED) + states.count(ledger.ASIDE) == 4


@pytest.mark.parametrize("size,step", [(48, 24), (20, 7), (12, 6), (30, 48)])
def test_rolling_anomalies_equal_the_full_run(spark, sample, tmp_path, size, step):
    """Rounds in no order, one done twice; every window length and step."""
    paths = tables(tmp_path)
    part = F.pmod(F.dayofyear("ts") * 5 + F.floor(F.hour("ts") / 20), F.lit(4))
    rows = sample.withColumn("version", F.lit(0).cast("bigint"))
    for number, k in enumerate((2, 0, 3, 1)):
        for _ in range(2 if k == 3 else 1):
            rolling.roll_round(rows.where(part == k), number, paths, START, size, step)
    expected = anomalies.moving_average_anomalies(sample, size, step, anchor=START, window_count="loop", deviations=1.0)
    assert expected.count() > 3
    same_days(days_of(rolling.rolled_anomalies(spark, paths, 1.0)), days_of(expected))
    stored = spark.read.parquet(paths.models).select("project", "title", "k", "n", "avg_requests", "var_bytes")
    full = windows.window_models(sample, size, step, anchor=START, window_count="loop").select(*stored.columns)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, full.collect()))


def test_a_round_reads_slice_sums_of_its_windows_only(spark, sample, tmp_path):
    paths = tables(tmp_path)
    rows = sample.withColumn("version", F.lit(0).cast("bigint"))
    for number, days in enumerate(((0, 5), (5, 10), (10, 15))):
        since, until = (START + dt.timedelta(days=d) for d in days)
        rolling.roll_round(rows.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until))), number, paths, START, 48)
    days = {(START + dt.timedelta(days=d)).date() for d in (6, 7, 8)}
    parts = rolling.stored_slices(spark, paths, days, START, 10)
    files = parts.inputFiles()
    assert files and all("/models_slices/" in f for f in files)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in plan and plan.count("Exchange hashpartitioning") == 1
    read = {f.split("/date=")[1].split("/")[0] for f in parts.select("project").distinct().inputFiles()}
    assert read == {str(d) for d in days} or len(read) > len(days)
    # Neither models nor scores add a shuffle to the one by page.
    for made in (windows.models_of_slices(parts, 48, 24), windows.scores_of_slices(parts, 48, 24)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "/traffic/" not in plan


def test_rounds_without_rows(spark, sample, tmp_path):
    paths = tables(tmp_path)
    rows = sample.withColumn("version", F.lit(0).cast("bigint"))
    rolling.roll_round(rows.limit(0), 0, paths, START, 48)
    assert ledger.hours_known(spark, paths.hours) == []
    rolling.roll_round(rows, 1, paths, START, 48)
    rolling.roll_round(rows.withColumn("version", F.lit(3).cast("bigint")), 2, paths, START, 48)
    assert rows_of(rolling.rolled_traffic(spark, paths)) == rows_of(sample)
    expected = anomalies.moving_average_anomalies(sample, 48, anchor=START, window_count="loop")
    same_days(days_of(rolling.rolled_anomalies(spark, paths)), days_of(expected))


@pytest.mark.parametrize("solver", ["gd", "ols"])
def test_regression_of_a_moving_range(spark, sample, tmp_path, solver):
    """Sums of days that came in no order, one of them twice; a page whose first days leave the range."""
    table, sums = str(tmp_path / "traffic"), str(tmp_path / "sums")
    part = F.pmod(F.dayofyear("ts") * 5, F.lit(3))
    for number, k in enumerate((1, 2, 0, 0)):
        batch = sample.where(part == k)
        write_traffic_table(batch, f"{table}/batch={min(number, 2)}")
        roll_regression(spark, table, sums, [r.d for r in batch.select(F.col("ts").cast("date").alias("d")).distinct().collect()])
    daily = spark.read.parquet(sums)
    first = (START.date() - dt.date(1970, 1, 1)).days
    rows = regression.lagged(hourly(sample)).withColumn("day_no", day_number("hour_no"))
    for low, high in ((first, first + 6), (first + 4, first + 12), (None, None)):
        inside = rows if low is None else rows.where(F.col("day_no").between(low, high))
        expected = {(r.project, r.title): r for r in regression.page_sums(inside.drop("day_no")).collect()}
        got = {(r.project, r.title): r for r in regression.range_sums(daily, low, high).collect()}
        assert got.keys() == expected.keys()
        for page, r in expected.items():
            assert (got[page].hours, got[page].n) == (r.hours, r.n)
            assert got[page].mean == pytest.approx(r["mean"], rel=1e-12) and got[page].sigma == pytest.approx(r.sigma, rel=1e-9)
        fitted = lambda s: {(r.project, r.title): [r[w] for w in regression.WEIGHTS] for r in regression.fit(regression.enough(s), solver).collect()}
        mine, theirs = fitted(regression.range_sums(daily, low, high)), fitted(regression.page_sums(inside.drop("day_no")))
        assert mine.keys() == theirs.keys() and mine
        for page, weights in theirs.items():
            assert mine[page] == pytest.approx(weights, rel=1e-6, abs=1e-9)
    plan = regression.range_sums(daily, first, first + 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_of_all_anomalies(spark):
    rows = [("en", f"p{k % 7}", 2014, 3, 1 + k % 28, 5, float(k % 5), 1.0) for k in range(400)]
    frame = spark.createDataFrame(rows, ANOMALIES_DDL).repartition(6)
    found = anomalies.numbered(frame).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 401))
    key = lambda r: (-r.relative_to_quantile, r.project, r.title, r.year, r.month, r.day)
    assert [key(r) for r in sorted(found, key=lambda r: r["rank"])] == sorted(map(key, found))
    assert anomalies.numbered(frame.limit(0)).count() == 0
    assert "SinglePartition" not in anomalies.numbered(frame)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_from_daily_sketches(spark):
    """Exact on a page below the sketch size, within its error on a larger one; ranges of days; no value lost."""
    values = [("en", "big", k, float((k * 7919) % 20_011)) for k in range(20_000)] + [("en", "small", k, float((k * 37) % 101)) for k in range(100)]
    frame = spark.createDataFrame(values, "project string, title string, hour_no bigint, abs_diff double").repartition(5)
    sketches = regression.residual_sketches(frame, k=200)
    assert sketches.count() == -(-20_000 // 24) + -(-100 // 24)
    for low, high in ((None, None), (1, 500)):
        inside = [v for v in values if low is None or low <= v[2] // 24 <= high]
        for q in (0.5, 0.9, 0.999):
            for r in regression.sketch_quantile(sketches, q, low, high).collect():
                own = sorted(v[3] for v in inside if v[1] == r.title)
                assert r.n == len(own) and r.quantile in own
                rank = sum(v <= r.quantile for v in own) / len(own)
                error = 0 if r.title == "small" else 2.3 / 200**0.9
                assert q - error <= rank <= q + error + 1 / len(own) + 1e-9
