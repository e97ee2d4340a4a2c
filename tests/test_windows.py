import datetime as dt

import pytest

import brute
from conftest import START, row
from trafficlens.operators import anomalies, filters, scoring, windows
from trafficlens.operators.stats import time_bounds
from trafficlens.plans.incremental import new_window_models

LAST = START + dt.timedelta(hours=15 * 24 - 1)


def as_dict(models):
    return {
        (r.project, r.title, r.k): (r.n, r.avg_requests, r.avg_bytes, r.var_requests, r.var_bytes)
        for r in models.collect()
    }


def assert_same(ours, expected):
    assert ours.keys() == expected.keys()
    for key, values in expected.items():
        assert ours[key] == pytest.approx(values, rel=1e-12), key


@pytest.mark.parametrize("size,step,rule", [
    (168, 24, "days"), (168, 24, "loop"), (50, 7, "days"), (48, 6, "loop"), (12, 31, "days"), (25, 24, "loop"),
    (7, 7, "days"), (6, 7, "loop"),
])
def test_models_equal_the_literal_loop(sample, sample_rows, size, step, rule):
    ours = as_dict(windows.window_models(sample, size, step, window_count=rule))
    expected = brute.window_models(sample_rows, size, step, rule)
    assert expected
    assert_same(ours, expected)


@pytest.mark.parametrize("size,step", [(168, 24), (50, 7), (6, 7)])
def test_builtin_window_gives_the_same(sample, size, step):
    slices = as_dict(windows.window_models(sample, size, step, drop_zero_variance=False))
    builtin = as_dict(windows.window_models_builtin(
        sample, START, LAST, size, step, drop_zero_variance=False))
    assert_same(slices, builtin)


def test_anchors(sample, sample_rows):
    by_global = as_dict(windows.window_models(sample, 48, 24))
    by_time = as_dict(windows.window_models(sample, 48, 24, anchor=START, last=LAST))
    assert by_global == by_time
    by_page = as_dict(windows.window_models(sample, 24, 24, anchor="page"))
    expected = {}
    for page in {r[:2] for r in sample_rows}:
        expected.update(brute.window_models([r for r in sample_rows if r[:2] == page], 24, 24))
    assert_same(by_page, expected)


def test_known_bounds_need_no_scan_ahead(sample):
    plan = windows.window_models(sample, anchor=START, last=LAST)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def test_window_ends_are_included(make_traffic):
    page = ("en", "P")
    ends = [row(page, at, 1 + at) for at in (0, 10, 11, 30)]
    models = as_dict(windows.window_models(make_traffic(ends), size=10, step=10, drop_zero_variance=False))
    assert [(k[2], v[0]) for k, v in sorted(models.items())] == [(0, 2), (1, 2)]


def test_huge_counts_do_not_wrap(make_traffic):
    page = ("en", "P")
    rows = [row(page, at, 4 * 10**9 + at % 2 * 10, 9 * 10**15 + at) for at in range(60)]
    ours = as_dict(windows.window_models(make_traffic(rows), 24, 24))
    assert_same(ours, brute.window_models(rows, 24, 24))
    assert max(v[3] for v in ours.values()) < 26


def test_constant_page_is_dropped_or_scores_null(make_traffic):
    rows = [row(("en", "Flat"), at, 7, 7) for at in range(240)]
    traffic = make_traffic(rows)
    assert windows.window_models(traffic).isEmpty()
    kept = windows.window_models(traffic, drop_zero_variance=False)
    scored = scoring.score(scoring.attach(traffic, kept))
    assert not scored.isEmpty() and scored.where("z_requests is not null").isEmpty()
    assert anomalies.moving_average_anomalies(traffic).isEmpty()


def test_single_hour_has_no_window(make_traffic):
    traffic = make_traffic([row(("en", "P"), 0, 5)])
    assert windows.window_models(traffic).isEmpty()
    assert anomalies.moving_average_anomalies(traffic).isEmpty()


@pytest.mark.parametrize("size,step", [(168, 24), (48, 6), (24, 48)])
def test_scores(sample, sample_rows, size, step):
    models = windows.window_models(sample, size, step)
    scored = scoring.score(scoring.attach(sample, models, step=step))
    ours = sorted(
        (r.project, r.title, r.ts, r.requests, r.k, r.z_requests, r.z_bytes) for r in scored.collect()
    )
    expected = sorted(
        (*r[:2], dt.datetime(*r[4:8]), r[2], k, z, zb)
        for r, k, z, zb, _ in brute.scored(sample_rows, size, step)
    )
    assert [o[:5] for o in ours] == [e[:5] for e in expected]
    for o, e in zip(ours, expected):
        assert o[5:] == pytest.approx(e[5:], rel=1e-12)


def test_every_window_of_a_day_on_request(sample):
    models = windows.window_models(sample, 48, 6)
    one = scoring.attach(sample, models, step=6).count()
    every = scoring.attach(sample, models, step=6, all_windows=True).count()
    assert every > 3 * one


def test_left_attach_keeps_all_rows(sample):
    models = windows.window_models(sample)
    left = scoring.score(scoring.attach(sample, models, how="left"))
    assert left.count() == sample.count()
    assert left.where("not has_model and z_requests is not null").isEmpty()
    last = scoring.attach_last_window(sample)
    assert last.count() == sample.count()
    assert last.where("has_model").select("day").distinct().count() == 1


def test_last_window_without_a_model_leaves_no_model(make_traffic):
    """The page is constant in the calendar's last window: no earlier window stands in for it."""
    rows = [row(("en", "Flat"), at, 10 + at % 7 if at < 100 else 50, 9) for at in range(12 * 24)]
    rows = [(*r[:3], r[2] * 2, *r[4:]) for r in rows]
    attached = scoring.attach_last_window(make_traffic(rows), size=48)
    assert attached.count() == len(rows)
    assert attached.where("has_model").isEmpty()


def test_page_anchor_reads_once_and_joins_nothing(sample, tmp_path, spark):
    path = str(tmp_path / "traffic")
    sample.write.parquet(path)
    plan = windows.window_models(spark.read.parquet(path), anchor="page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


@pytest.mark.parametrize("size,step", [(168, 24), (48, 6), (24, 48), (50, 7), (6, 6), (12, 6)])
def test_daily_anomalies_equal_scored_hours(sample, sample_rows, size, step):
    fast = anomalies.moving_average_anomalies(sample, size, step)
    slow = anomalies.daily_from_scores(
        scoring.score(scoring.attach(sample, windows.window_models(sample, size, step), step=step))
    )
    ours = {tuple(r[:5]): tuple(r[5:]) for r in fast.collect()}
    assert ours == {tuple(r[:5]): tuple(r[5:]) for r in slow.collect()}
    expected = brute.daily(sample_rows, size=size, step=step)
    assert ours.keys() == expected.keys()
    for key, values in expected.items():
        assert ours[key] == pytest.approx(values, rel=1e-12)
    if step <= 24 and size != 12:  # no day beyond 3 deviations there
        assert ours


def test_as_written_groups_by_ratio(sample):
    scored = scoring.score(scoring.attach(sample, windows.window_models(sample)))
    rows = anomalies.daily_from_scores(scored, as_written=True).collect()
    plain = scored.where("z_requests > 3").selectExpr("requests/avg_requests as r", "title").distinct()
    assert len(rows) == plain.count()


def test_severity(make_traffic, sample):
    scored = scoring.score(scoring.attach(sample, windows.window_models(sample)))
    levels = scoring.with_severity(scored)
    wrong = levels.where(
        "severity != case when z_requests > 6 then 6 when z_requests > 5 then 5 when z_requests > 4 then 4 "
        "when z_requests > 3 then 3 when z_requests > 2 then 2 else 0 end"
    )
    assert wrong.isEmpty()
    counts = scoring.severity_counts(scored).where("title = 'Dense'").first()
    assert counts.beyond_3 == scored.where("title = 'Dense' and z_requests > 3").count() > 0
    either = scoring.beyond(scored, 2, bytes_too=True).count()
    assert either >= scoring.beyond(scored, 2).count()


@pytest.mark.parametrize("size,step", [(168, 24), (9, 4), (10, 5)])
def test_kernel_means(sample, sample_rows, size, step):
    ours = {(r.project, r.title, r.k): r.kernel_mean for r in windows.kernel_means(sample, size, step).collect()}
    first = min(brute.at_of(r) for r in sample_rows)
    sums = {}
    count = brute.window_count(max(brute.at_of(r) for r in sample_rows) - first, size, step, "days")
    for r in sample_rows:
        for k in range(count):
            at = brute.at_of(r) - first - k * step
            if 0 <= at <= size:
                u = (at - size // 2) / (size / 2)
                w = 0.0 if abs(u) > 1 else 0.75 * (1 - u * u)
                s = sums.setdefault((*r[:2], k), [0.0, 0.0])
                s[0] += w
                s[1] += w * r[2]
    expected = {key: x / w for key, (w, x) in sums.items() if w > 1e-12}
    assert ours.keys() == expected.keys()
    for key, value in expected.items():
        assert ours[key] == pytest.approx(value, rel=1e-9)


def test_incremental_equals_full(sample):
    full = as_dict(windows.window_models(sample, anchor=START, last=LAST, window_count="loop"))
    cut = START + dt.timedelta(hours=168 + 3 * 24 + 5)
    early = as_dict(windows.window_models(
        filters.until(sample, cut), anchor=START, last=cut, window_count="loop"))
    done = max(k[2] for k in early) + 1
    late = as_dict(new_window_models(sample, START, LAST, done))
    assert not early.keys() & late.keys()
    assert early | late == full


def test_input_order_and_other_pages_do_not_matter(make_traffic, sample_rows):
    backwards = make_traffic(list(reversed(sample_rows))).repartition(7, "hour")
    alone = make_traffic([r for r in sample_rows if r[1] == "Dense"])
    args = dict(anchor=START, last=LAST)
    whole = as_dict(windows.window_models(backwards, **args))
    part = as_dict(windows.window_models(alone, **args))
    assert part == {k: v for k, v in whole.items() if k[1] == "Dense"}
    assert whole == as_dict(windows.window_models(make_traffic(sample_rows), **args))


def test_hot_hour_of_many_rows(make_traffic):
    """A third and more of all rows are repeats of one page and hour."""
    rows = [row(("en", "Hot"), 100, 50)] * 500
    rows += [row(("en", f"P{i}"), at, 10 + at % 5) for i in range(3) for at in range(240)]
    assert_same(as_dict(windows.window_models(make_traffic(rows), drop_zero_variance=False)),
                brute.window_models(rows, drop_zero=False))


def test_bounds(sample):
    first, last = time_bounds(sample).first()
    assert last - first == 15 * 24 - 1
