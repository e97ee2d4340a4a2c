import math

import pytest
from pyspark.sql import functions as F

import brute
from conftest import noise, row
from trafficlens.functions.hours import hour_number_from
from conftest import START
from trafficlens.operators import anomalies, regression
from trafficlens.schema import hourly

ORIGIN = hour_number_from(START)


@pytest.fixture(scope="module")
def series():
    """Two pages: one that follows its own past, one with gaps and a level far above its spread."""
    numbers = noise(3)
    follows, level = {}, 500.0
    for at in range(400):
        level = 0.7 * level + 150 + next(numbers) % 60 + (30 if at % 24 < 6 else 0)
        follows[at] = int(level) + (4000 if at in (200, 201, 333) else 0)
    high = {at: 10**7 + next(numbers) % 100 for at in range(400) if next(numbers) % 9}
    return {("en", "Follows"): follows, ("en", "High"): high}


@pytest.fixture(scope="module")
def traffic(make_traffic, series):
    rows = [row(page, at, v) for page, values in series.items() for at, v in values.items()]
    return make_traffic(rows).cache()


@pytest.fixture(scope="module")
def sums(traffic):
    return regression.page_sums(regression.lagged(traffic)).cache()


def test_lags_equal_self_joins(traffic, series):
    rows = regression.lagged(traffic).where(regression.complete()).collect()
    ours = {(r.project, r.title, r.hour_no - ORIGIN): (r.hour_id, r.y, *[r[f"lag{k}"] for k in brute.LAGS]) for r in rows}
    expected = {
        (*page, at): (at - min(values), y, *xs)
        for page, values in series.items() for at, y, xs in brute.lag_rows(values)
    }
    assert ours == expected


def test_moments(traffic, series):
    for r in regression.page_moments(regression.lagged(traffic)).collect():
        mean, sigma, rows = brute.standardised(series[(r.project, r.title)])
        assert (r.n, r.mean, r.sigma) == (len(rows), pytest.approx(mean), pytest.approx(sigma, rel=1e-9))


@pytest.mark.parametrize("size", [1.0, 0.3])
def test_descent_on_sums_equals_descent_on_rows(sums, series, size):
    for r in regression.fit(sums, step_size=size).collect():
        _, _, rows = brute.standardised(series[(r.project, r.title)])
        expected = brute.descend(rows, size)
        assert [r[w] for w in regression.WEIGHTS] == pytest.approx(expected, rel=1e-6, abs=1e-8)


def test_least_squares(sums, series):
    import numpy as np

    for r in regression.fit(sums, "ols").collect():
        _, _, rows = brute.standardised(series[(r.project, r.title)])
        x, y = np.array([x for _, _, x in rows]), np.array([y for _, y, _ in rows])
        expected = np.linalg.lstsq(x, y, rcond=None)[0]
        assert [r[w] for w in regression.WEIGHTS] == pytest.approx(list(expected), rel=1e-6, abs=1e-8)


def test_grid_search(sums, series):
    for r in regression.best_step(sums).collect():
        _, _, rows = brute.standardised(series[(r.project, r.title)])
        tried = [(brute.residual_sum(rows, brute.descend(rows, s)), i, s) for i, s in enumerate(regression.STEP_SIZES)]
        best = min(t for t in tried if math.isfinite(t[0]))
        assert (r.step_size, r.rss) == (best[2], pytest.approx(best[0], rel=1e-8))
    fitted = regression.fit(sums, grid_search=True)
    assert {r.step_size for r in fitted.collect()} <= set(regression.STEP_SIZES)


def test_overflowing_steps_rank_last(sums):
    huge = sums.select(*[
        (F.col(c) * 1e9).alias(c) if c.startswith(("a", "b")) and c != "bytes" else F.col(c) for c in sums.columns
    ])
    for r in regression.best_step(huge).collect():
        assert math.isfinite(r.rss) and r.step_size == 0.001


def test_extra_intercept_moves_the_constant_twice(sums, series):
    for r in regression.fit(sums, extra_intercept=True).collect():
        _, _, rows = brute.standardised(series[(r.project, r.title)])
        # A second constant feature, weights added up.
        w = [0.0] * 7
        for i in range(1, 21):
            g = [0.0] * 7
            for _, y, x in rows:
                x = [*x, 1.0]
                e = sum(a * b for a, b in zip(w, x)) - y
                g = [a + e * b for a, b in zip(g, x)]
            w = [a - 1 / math.sqrt(i) * b / len(rows) for a, b in zip(w, g)]
        expected = [*w[:5], w[5] + w[6]]
        assert [r[c] for c in regression.WEIGHTS] == pytest.approx(expected, rel=1e-6, abs=1e-8)


def test_residuals_threshold_and_days(traffic, series):
    found = regression.page_regression(traffic).cache()
    ours = {(r.project, r.title, r.hour_no - ORIGIN): r for r in found.collect()}
    expected_days = {}
    for page, values in series.items():
        mean, sigma, rows = brute.standardised(values)
        w = brute.descend(rows)
        off = {at: (values[at], sum(a * b for a, b in zip(w, x)) * sigma + mean) for at, _, x in rows}
        diffs = {at: abs(y - p) for at, (y, p) in off.items()}
        m = sum(diffs.values()) / len(diffs)
        threshold = m + 3 * math.sqrt(sum(d * d for d in diffs.values()) / len(diffs) - m * m)
        for at, (y, p) in off.items():
            r = ours[(*page, at)]
            assert (r.original, r.predicted) == pytest.approx((y, p), rel=1e-9)
            assert r.threshold == pytest.approx(threshold, rel=1e-6)
            if diffs[at] > threshold:
                expected_days.setdefault((*page, r.year, r.month, r.day), []).append((y, diffs[at] / threshold, p))
    assert len(ours) == sum(len(brute.lag_rows(v)) for v in series.values())
    days = {tuple(r[:5]): tuple(r[5:]) for r in anomalies.daily_from_residuals(found).collect()}
    assert days.keys() == expected_days.keys() and days
    for key, hits in expected_days.items():
        visit, ratio = max(h[0] for h in hits), max(h[1] for h in hits)
        norm = visit / max(h[2] for h in hits)
        assert days[key] == pytest.approx((visit, ratio, norm), rel=1e-5)


def test_pages_without_a_model(make_traffic):
    rows = [row(("en", "Flat"), at, 5) for at in range(100)]
    rows += [row(("en", "Short"), at, at) for at in range(50)]
    rows += [row(("en", "One"), 0, 9)]
    traffic = make_traffic(rows)
    assert regression.page_regression(traffic).isEmpty()
    sums = regression.page_sums(regression.lagged(traffic))
    skipped = {(r.title, r.reason) for r in regression.skipped_pages(sums).collect()}
    assert skipped == {("Flat", "constant"), ("Short", "too few hours"), ("One", "constant")}


def test_dependent_features_have_no_least_squares_model(make_traffic):
    traffic = make_traffic([row(("en", "Line"), at, at % 2) for at in range(200)])
    sums = regression.page_sums(regression.lagged(traffic))
    assert regression.fit(sums, "ols").isEmpty()
    assert regression.fit(sums).count() == 1


def test_repeated_hours_are_added_up(make_traffic):
    once = [row(("en", "P"), at, 10 + at * at % 17) for at in range(120)]
    halves = [row(("en", "P"), at, v) for at in range(120)
              for v in ((10 + at * at % 17) // 2, 10 + at * at % 17 - (10 + at * at % 17) // 2)]
    a = regression.page_regression(make_traffic(once)).orderBy("hour_no").collect()
    b = regression.page_regression(make_traffic(halves)).orderBy("hour_no").collect()
    assert a and [r.predicted for r in a] == pytest.approx([r.predicted for r in b])
    assert hourly(make_traffic(halves)).count() == 120


def test_log_target(make_traffic, series):
    page = ("en", "Follows")
    traffic = make_traffic([row(page, at, v) for at, v in series[page].items()])
    r = regression.page_moments(regression.lagged(traffic, log_target=True)).first()
    logs = [math.log(v) for v in series[page].values()]
    assert r.mean == pytest.approx(sum(logs) / len(logs))


def test_quantile(traffic):
    found = regression.page_regression(traffic).cache()
    exact = {r.title: r.quantile for r in regression.residual_quantile(found, exact=True).collect()}
    close = {r.title: r.quantile for r in regression.residual_quantile(found, exact=False).collect()}
    for title, value in exact.items():
        off = sorted(r.abs_diff for r in found.where(F.col("title") == title).collect())
        at = 0.999 * (len(off) - 1)
        low = off[int(at)]
        assert value == pytest.approx(low + (off[int(at) + 1] - low) * (at - int(at)))
        assert off[-2] <= close[title] <= off[-1]


def test_one_shuffle_by_page(traffic):
    plan = regression.page_regression(traffic, unique_hours=True)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    exchanges = {line.split("plan_id")[0].split("Exchange")[1] for line in text.splitlines()
                 if "Exchange hashpartitioning" in line}
    assert len(exchanges) <= 2 and "BroadcastNestedLoopJoin" not in text
