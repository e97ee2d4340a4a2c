"""The definitions as plain loops, for small inputs."""

import datetime as dt
import math
from collections import defaultdict

from conftest import START


def at_of(row):
    y, m, d, h = row[4:8]
    return int((dt.datetime(y, m, d, h) - START).total_seconds() // 3600)


def window_count(last, size, step, rule):
    if rule == "days":
        return max(last // 24 - size // 24 + 1, 0)
    count = 0
    while count * step + size < last:
        count += 1
    return count


def window_models(rows, size=168, step=24, rule="days", drop_zero=True, origin=None):
    """{(project, title, k): (n, mean requests, mean bytes, var requests, var bytes)}"""
    hours = [at_of(r) for r in rows]
    first = min(hours) if origin is None else origin
    models = {}
    for k in range(window_count(max(hours) - first, size, step, rule)):
        low, high = first + k * step, first + k * step + size
        groups = defaultdict(list)
        for r, at in zip(rows, hours):
            if low <= at <= high:
                groups[r[:2]].append(r)
        for page, members in groups.items():
            n = len(members)
            if n < 2:
                continue
            values = [n]
            for i in (2, 3):
                values.append(sum(r[i] for r in members) / n)
            for i in (2, 3):
                s, q = sum(r[i] for r in members), sum(r[i] ** 2 for r in members)
                values.append((n * q - s * s) / n**2)
            if drop_zero and (values[3] == 0 or values[4] == 0):
                continue
            models[(*page, k)] = tuple(values)
    return models


def middle_day(first, k, size, step):
    return (START + dt.timedelta(hours=first + k * step + size // 2)).date()


def scored(rows, size=168, step=24, **options):
    """[(row, k, z requests, z bytes)] against the last window centred on the row's day."""
    first = min(at_of(r) for r in rows)
    by_day = {}
    for (p, t, k), model in sorted(window_models(rows, size, step, **options).items(), key=lambda i: i[0][2]):
        by_day[(p, t, middle_day(first, k, size, step))] = (k, model)
    out = []
    for r in rows:
        hit = by_day.get((r[0], r[1], dt.date(*r[4:7])))
        if hit:
            k, (n, mr, mb, vr, vb) = hit
            out.append((r, k, abs(mr - r[2]) / math.sqrt(vr), abs(mb - r[3]) / math.sqrt(vb), mr))
    return out


def daily(rows, **options):
    """{(project, title, y, m, d): (visit_max, z_max, ratio_max)} of days beyond three deviations."""
    days = defaultdict(list)
    for r, _, z, _, mean in scored(rows, **options):
        days[(*r[:2], *r[4:7])].append((r[2], z, r[2] / mean))
    tops = {k: tuple(max(v[i] for v in vs) for i in range(3)) for k, vs in days.items()}
    return {k: v for k, v in tops.items() if v[1] > 3}


LAGS = (1, 2, 3, 24, 48)


def lag_rows(series):
    """[(hour, y, five lags)] for hours that have all of them; series is {hour: value}."""
    return [
        (at, y, [series[at - k] for k in LAGS])
        for at, y in sorted(series.items()) if all(at - k in series for k in LAGS)
    ]


def standardised(series):
    values = list(series.values())
    mean = sum(values) / len(values)
    sigma = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    rows = [
        (at, (y - mean) / sigma, [(x - mean) / sigma for x in xs] + [1.0])
        for at, y, xs in lag_rows(series)
    ]
    return mean, sigma, rows


def descend(rows, size=1.0, steps=20):
    """Gradient descent over the rows themselves."""
    w = [0.0] * 6
    for i in range(1, steps + 1):
        g = [0.0] * 6
        for _, y, x in rows:
            e = sum(a * b for a, b in zip(w, x)) - y
            for j in range(6):
                g[j] += e * x[j]
        w = [a - size / math.sqrt(i) * b / len(rows) for a, b in zip(w, g)]
    return w


def residual_sum(rows, w):
    return sum((sum(a * b for a, b in zip(w, x)) - y) ** 2 for _, y, x in rows)
