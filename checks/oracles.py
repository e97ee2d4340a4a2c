"""DuckDB SQL for checks/queries.py, written from the definitions: windows by range join, lags by
self-join, descent by recursion, totals over plain ordered rows."""

from __future__ import annotations

LISTED = "(VALUES ('en','click'), ('de','error'), ('en','click')) AS l(project, title)"
TRAFFIC = "project, title, requests, bytes, year, month, day, hour"
# The step sizes of the grid search, with their place for ties.
STEP_SIZES = (
    "(VALUES (0,500.0),(1,300.0),(2,100.0),(3,50.0),(4,30.0),(5,10.0),(6,5.0),(7,3.0),(8,1.0),"
    "(9,0.5),(10,0.3),(11,0.1),(12,0.05),(13,0.03),(14,0.01),(15,0.005),(16,0.003),(17,0.001)) "
    "AS s(idx, step_size)"
)


def traffic(kind: str) -> str:
    """CTE ``traffic``: events counted per project, title and hour."""
    project = {
        "all": "'all'",
        "langs": "CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END",
        "users": "'users'",
    }[kind]
    title = "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END" if kind == "users" else "event_type"
    return f"""
traffic AS (
  SELECT {project} AS project, {title} AS title, date_trunc('hour', ts) AS ts,
         count(*) AS requests, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes,
         CAST(year(date_trunc('hour', ts)) AS INTEGER) AS year,
         CAST(month(date_trunc('hour', ts)) AS INTEGER) AS month,
         CAST(day(date_trunc('hour', ts)) AS INTEGER) AS day,
         CAST(hour(date_trunc('hour', ts)) AS INTEGER) AS hour,
         date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS hour_no
  FROM events GROUP BY ALL)"""


def models(size: int = 168, step: int = 24, rule: str = "days", nonzero: bool = True,
           by_page: bool = False) -> str:
    """CTE ``models``: every window joined to the rows it covers."""
    count = {
        "days": f"greatest((z - a) // 24 - {size // 24} + 1, 0)",
        "loop": f"greatest(CAST(ceil((z - a - {size}) / {step}) AS BIGINT), 0)",
    }[rule]
    page = "project, title," if by_page else ""
    same = "w.project = t.project AND w.title = t.title AND" if by_page else ""
    group = "GROUP BY project, title" if by_page else ""
    where = "WHERE var_requests <> 0 AND var_bytes <> 0" if nonzero else ""
    return f"""
bounds AS (SELECT {page} min(hour_no) AS a, max(hour_no) AS z FROM traffic {group}),
win AS (SELECT {page} a, unnest(range({count})) AS k FROM bounds),
sums AS (
  SELECT t.project, t.title, w.k, w.a, count(*) AS n, sum(requests) AS sx, sum(bytes) AS sy,
         sum(CAST(requests AS HUGEINT) * requests) AS sxx, sum(CAST(bytes AS HUGEINT) * bytes) AS syy
  FROM traffic t JOIN win w
    ON {same} t.hour_no BETWEEN w.a + w.k * {step} AND w.a + w.k * {step} + {size}
  GROUP BY t.project, t.title, w.k, w.a HAVING count(*) > 1),
models AS (
  SELECT * FROM (
    SELECT project, title, k, n,
           TIMESTAMP '1970-01-01' + to_hours(CAST(a + k * {step} AS INTEGER)) AS window_start,
           TIMESTAMP '1970-01-01' + to_hours(CAST(a + k * {step} + {size // 2} AS INTEGER)) AS window_mid,
           TIMESTAMP '1970-01-01' + to_hours(CAST(a + k * {step} + {size} AS INTEGER)) AS window_end,
           CAST(sx AS DOUBLE) / n AS avg_requests, CAST(sy AS DOUBLE) / n AS avg_bytes,
           CAST(n * sxx - sx * sx AS DOUBLE) / (CAST(n AS DOUBLE) * n) AS var_requests,
           CAST(n * syy - sy * sy AS DOUBLE) / (CAST(n AS DOUBLE) * n) AS var_bytes
    FROM sums) {where})"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


MODEL_OUT = f"""
SELECT project, title, k, {stamp('window_start')}, {stamp('window_mid')}, {stamp('window_end')}, n,
       round(avg_requests, 6) AS avg_requests, round(avg_bytes, 6) AS avg_bytes,
       round(var_requests, 6) AS var_requests, round(var_bytes, 6) AS var_bytes
FROM models"""


def window_query(kind: str, **options) -> str:
    return f"WITH {traffic(kind)}, {models(**options)} {MODEL_OUT}"


def scored(how: str = "", last_of_day: bool = False, last_only: bool = False) -> str:
    """CTE ``scored``: rows against the model whose middle is on their day."""
    pick = ""
    if last_of_day:
        pick = "QUALIFY row_number() OVER (PARTITION BY project, title, CAST(window_mid AS DATE) ORDER BY k DESC) = 1"
    if last_only:
        pick = "WHERE k = (SELECT max(k) FROM win)"
    return f"""
chosen AS (SELECT * FROM models {pick}),
scored AS (
  SELECT t.*, m.k, avg_requests, avg_bytes, var_requests, var_bytes,
         abs(avg_requests - requests) AS diff_requests, abs(avg_bytes - bytes) AS diff_bytes,
         abs(avg_requests - requests) / sqrt(var_requests) AS z_requests,
         abs(avg_bytes - bytes) / sqrt(var_bytes) AS z_bytes, m.k IS NOT NULL AS has_model
  FROM traffic t {how} JOIN chosen m
    ON t.project = m.project AND t.title = m.title AND CAST(t.ts AS DATE) = CAST(m.window_mid AS DATE))"""


SCORED_OUT = """project, title, requests, bytes,
  round(avg_requests, 6) AS avg_requests, round(avg_bytes, 6) AS avg_bytes,
  round(var_requests, 6) AS var_requests, round(var_bytes, 6) AS var_bytes,
  round(diff_requests, 6) AS diff_requests, round(diff_bytes, 6) AS diff_bytes,
  round(z_requests, 6) AS z_requests, round(z_bytes, 6) AS z_bytes, year, month, day, hour"""

ANOMALIES = """
anomalies AS (
  SELECT project, title, year, month, day, max(requests) AS visit_max,
         max(z_requests) AS relative_to_quantile, max(requests / avg_requests) AS relative_to_norm
  FROM scored GROUP BY project, title, year, month, day HAVING max(z_requests) > 3)"""
ANOMALIES_OUT = """project, title, year, month, day, visit_max,
  round(relative_to_quantile, 6) AS relative_to_quantile, round(relative_to_norm, 6) AS relative_to_norm"""


def anomaly_query(kind: str, tail: str) -> str:
    return f"WITH {traffic(kind)}, {models()}, {scored()}, {ANOMALIES} {tail}"


ROLLED = f"WITH {traffic('langs')}, {models(rule='loop')}, {scored()}, {ANOMALIES} SELECT {ANOMALIES_OUT} FROM anomalies"

TOP5 = """SELECT *, CAST(row_number() OVER (PARTITION BY year, month, day
  ORDER BY relative_to_quantile DESC, project, title) AS INTEGER) AS rank
FROM anomalies QUALIFY rank <= 5"""

# ---- regression -----------------------------------------------------------------------------

LAGGED = """
lagged AS (
  SELECT t.project, t.title, t.ts, t.year, t.month, t.day, t.hour,
         t.hour_no - (SELECT min(hour_no) FROM traffic f WHERE f.project = t.project AND f.title = t.title) AS hour_id,
         CAST(t.requests AS HUGEINT) AS x0, CAST(t1.requests AS HUGEINT) AS x1,
         CAST(t2.requests AS HUGEINT) AS x2, CAST(t3.requests AS HUGEINT) AS x3,
         CAST(t24.requests AS HUGEINT) AS x4, CAST(t48.requests AS HUGEINT) AS x5
  FROM traffic t
  """ + "\n  ".join(
    f"JOIN traffic t{k} ON t{k}.project = t.project AND t{k}.title = t.title AND t{k}.hour_no = t.hour_no - {k}"
    for k in (1, 2, 3, 24, 48)
) + ")"


def regression_sums(min_rows: int = 7) -> str:
    """CTEs ``moments`` (all hours), ``raw`` (hours with all lags) and ``stdsums``."""
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    raw = ", ".join(f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in pairs)
    totals = ", ".join(f"sum(x{i}) AS t{i}" for i in range(6))

    def product(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        exact = f"cnt * cnt * p{i}{j} - cnt * s * (t{i} + t{j}) + n * s * s"
        return f"CAST({exact} AS DOUBLE) / CAST(v AS DOUBLE)"

    def total(i: int) -> str:
        return f"CAST(cnt * t{i} - n * s AS DOUBLE) / sqrt(CAST(v AS DOUBLE))"

    cells = []
    for i, j in pairs:
        value = product(i + 1, j + 1) if j < 5 else total(i + 1) if i < 5 else "CAST(n AS DOUBLE)"
        cells.append(f"{value} AS a{i}{j}")
    cells += [f"{product(0, i + 1)} AS b{i}" for i in range(5)] + [f"{total(0)} AS b5"]
    cells.append(f"{product(0, 0)} AS yy")
    return f"""
moments AS (
  SELECT project, title, CAST(count(*) AS HUGEINT) AS cnt, sum(CAST(requests AS HUGEINT)) AS s,
         sum(CAST(requests AS HUGEINT) * requests) AS q
  FROM traffic GROUP BY project, title),
raw AS (SELECT project, title, CAST(count(*) AS HUGEINT) AS n, {raw}, {totals} FROM lagged GROUP BY project, title),
stdsums AS (
  SELECT project, title, CAST(cnt AS BIGINT) AS hours, CAST(n AS BIGINT) AS n,
         CAST(s AS DOUBLE) / CAST(cnt AS DOUBLE) AS mean,
         sqrt(CAST(v AS DOUBLE)) / CAST(cnt AS DOUBLE) AS sigma, {', '.join(cells)}
  FROM (SELECT *, cnt * q - s * s AS v FROM moments JOIN raw USING (project, title))
  WHERE n >= {min_rows} AND v > 0)"""


def _gradient(i: int) -> str:
    row = " + ".join(f"a{min(i, j)}{max(i, j)} * w{j}" for j in range(6))
    return f"({row} - b{i}) / n"


RSS = (
    "yy - 2.0 * (" + " + ".join(f"w{i} * b{i}" for i in range(6)) + ") + "
    + " + ".join(f"w{i} * w{j} * a{min(i, j)}{max(i, j)}" for i in range(6) for j in range(6))
)


def descent(steps: str = "(VALUES (0, 1.0)) AS s(idx, step_size)") -> str:
    """CTE ``gd`` by recursion over 20 steps and ``weights`` with its end."""
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in range(6))
    moved = ", ".join(f"w{i} - step_size / sqrt(i + 1) * ({_gradient(i)})" for i in range(6))
    return f"""
gd AS (
  SELECT project, title, idx, CAST(step_size AS DOUBLE) AS step_size, 0 AS i, {zeros}
  FROM stdsums CROSS JOIN {steps}
  UNION ALL
  SELECT g.project, g.title, idx, step_size, i + 1, {moved}
  FROM gd g JOIN stdsums d ON g.project = d.project AND g.title = d.title WHERE i < 20),
weights AS (SELECT * FROM gd WHERE i = 20)"""


def elimination() -> str:
    """CTEs e0..e6: the normal equations reduced pivot by pivot."""
    start = [f"a{min(i, j)}{max(i, j)} AS m{i}_{j}" for i in range(6) for j in range(6)]
    start += [f"b{i} AS m{i}_6" for i in range(6)]
    ctes = [f"e0 AS (SELECT project, title, {', '.join(start)} FROM stdsums)"]
    for p in range(6):
        cells = []
        for i in range(6):
            for j in range(7):
                if i == p:
                    cells.append(f"m{i}_{j} / m{p}_{p} AS m{i}_{j}")
                else:
                    cells.append(f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p} AS m{i}_{j}")
        ctes.append(f"e{p + 1} AS (SELECT project, title, {', '.join(cells)} FROM e{p})")
    return ",\n".join(ctes)


RESIDUALS = """
predicted AS (
  SELECT l.project, l.title, l.ts, l.year, l.month, l.day, l.hour, CAST(x0 AS DOUBLE) AS original,
         (""" + " + ".join(f"w{i} * (x{i + 1} - mean) / sigma" for i in range(5)) + """ + w5) * sigma + mean AS predicted
  FROM lagged l
  JOIN weights w ON w.project = l.project AND w.title = l.title
  JOIN stdsums d ON d.project = l.project AND d.title = l.title),
off AS (SELECT *, abs(original - predicted) AS abs_diff FROM predicted),
limits AS (
  SELECT project, title, count(*) AS n, avg(abs_diff) + 3 * stddev_pop(abs_diff) AS threshold
  FROM off GROUP BY project, title),
residuals AS (SELECT off.*, threshold FROM off JOIN limits USING (project, title))"""

REGRESSION_DAYS = """
SELECT project, title, year, month, day, CAST(max(original) AS BIGINT) AS visit_max,
       round(max(abs_diff / threshold), 6) AS relative_to_quantile,
       round(max(original) / max(predicted), 6) AS relative_to_norm
FROM residuals WHERE abs_diff > threshold
GROUP BY project, title, year, month, day HAVING max(abs_diff / threshold) > 1"""


def regression(tail: str, grid: bool = False) -> str:
    best = ""
    steps = descent()
    if grid:
        steps = descent(STEP_SIZES).replace("weights AS (SELECT * FROM gd WHERE i = 20)", f"""
tried AS (SELECT g.*, {RSS} AS rss FROM gd g JOIN stdsums d USING (project, title) WHERE i = 20),
weights AS (
  SELECT * FROM tried
  QUALIFY row_number() OVER (PARTITION BY project, title
    ORDER BY isnan(rss) OR isinf(rss), rss, idx) = 1)""")
    return (f"WITH RECURSIVE {traffic('all')}, {LAGGED}, {regression_sums()}, {steps}, "
            f"{RESIDUALS}{best} {tail}")


def before_fit(tail: str) -> str:
    return f"WITH {traffic('all')}, {LAGGED}, {regression_sums()} {tail}"


WEIGHTS_OUT = ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(6))
SUMS_OUT = ", ".join(
    f"round({c}, 6) AS {c}"
    for c in [f"a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"b{i}" for i in range(6)] + ["yy"]
)
REGRESSION_SERIES = """
series AS (
  SELECT year, month, day, hour, predicted AS model, original, abs_diff AS residual, threshold,
         predicted + threshold AS upper
  FROM residuals WHERE project = 'all' AND title = 'click')"""
SERIES_OUT = ("year, month, day, hour, round(model, 6) AS model, round(original, 6) AS original, "
              "round(residual, 6) AS residual, round(threshold, 6) AS threshold, round(upper, 6) AS upper")

LISTING = """
listing AS (
  SELECT event_type AS title, date_trunc('hour', ts) AS ts, user_id % 12 AS version FROM events),
served AS (SELECT title, ts, min(version) AS version FROM listing WHERE version BETWEEN 0 AND 9 GROUP BY ALL)"""


def kernel() -> str:
    return f"""WITH {traffic('langs')}, {models()},
w AS (
  SELECT t.project, t.title, win.k, win.a, requests,
         CASE WHEN abs(u) > 1 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE * (1 - u * u) END AS weight
  FROM (SELECT *, 1 AS one FROM traffic) t
  JOIN win ON t.hour_no BETWEEN win.a + win.k * 24 AND win.a + win.k * 24 + 168,
  LATERAL (SELECT CAST(t.hour_no - win.a - win.k * 24 - 84 AS DOUBLE) / 84.0::DOUBLE AS u) x)
SELECT project, title, k,
       strftime(TIMESTAMP '1970-01-01' + to_hours(CAST(a + k * 24 + 84 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_mid,
       count(*) AS n, round(sum(weight), 6) AS weight,
       round(sum(weight * requests) / sum(weight), 6) AS kernel_mean
FROM w GROUP BY project, title, k, a HAVING sum(weight) > 0"""


ORACLES: dict[str, str] = {
    "dump_lines": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "dump_files": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "dump_folder_versions": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "dump_ledger": f"""WITH {traffic('langs')}, f AS (
          SELECT strftime(ts, 'pagecounts-%Y%m%d-%H0000.gz') AS file, count(*) AS n, ts = (SELECT max(ts) FROM traffic) AS cut_off
          FROM traffic GROUP BY ts)
        SELECT file, CASE WHEN NOT cut_off THEN n + 2 END AS lines, CASE WHEN NOT cut_off THEN n END AS kept,
               CASE WHEN NOT cut_off THEN 1::BIGINT END AS short, CASE WHEN NOT cut_off THEN 1::BIGINT END AS too_long,
               CASE WHEN NOT cut_off THEN 0::BIGINT END AS bad_number, cut_off FROM f""",
    "dump_hour_globs": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "dump_single_file": f"""WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic
        WHERE hour_no = (SELECT min(hour_no) FROM traffic)""",
    "table_daily_anomalies": anomaly_query("all", f"SELECT {ANOMALIES_OUT} FROM anomalies"),
    "table_regression_daily": regression(REGRESSION_DAYS),
    "rolled_out_of_order": window_query("all", rule="loop"),
    "ma_daily_anomalies_short_steps": f"""WITH {traffic('langs')}, {models(size=6, step=6)},
        {scored(last_of_day=True)}, {ANOMALIES} SELECT {ANOMALIES_OUT} FROM anomalies""",
    "ma_daily_anomalies_tiny_windows": f"""WITH {traffic('langs')}, {models(size=12, step=6)},
        {scored(last_of_day=True)}, {ANOMALIES.replace('> 3', '> 1')} SELECT {ANOMALIES_OUT} FROM anomalies""",
    "traffic_text_roundtrip": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "anomalies_text_roundtrip": anomaly_query("langs", f"SELECT {ANOMALIES_OUT} FROM anomalies"),
    "hour_versions": f"""WITH {LISTING}
        SELECT title, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
               CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, version FROM served""",
    "hour_coverage_gaps": f"""WITH {traffic('all')}, {LISTING},
        calendar AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM traffic)
        SELECT title, strftime(ts, '%Y-%m-%d') AS date, count(*) AS missing_hours,
               strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_missing
        FROM (SELECT DISTINCT title FROM listing), calendar
        WHERE (title, ts) NOT IN (SELECT (title, ts) FROM served) GROUP BY 1, 2""",
    "project_filter": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic WHERE project IN ('en','de')",
    "page_filter": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic WHERE project = 'en' AND title = 'click'",
    "whitelist_semi": f"""WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic t
        WHERE EXISTS (SELECT 1 FROM {LISTED} WHERE l.project = t.project AND l.title = t.title)""",
    "whitelist_titles": f"""WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic
        WHERE title IN (SELECT title FROM {LISTED})""",
    "whitelist_join": f"""WITH {traffic('langs')}
        SELECT {TRAFFIC} FROM traffic JOIN {LISTED} USING (project, title)""",
    "day_sums": f"""WITH {traffic('langs')}
        SELECT project, title, year, month, day, CAST(sum(requests) AS BIGINT) AS requests,
               CAST(sum(bytes) AS BIGINT) AS bytes
        FROM traffic WHERE project IN ('en','de') GROUP BY ALL""",
    "page_stats": f"""WITH {traffic('langs')},
        d AS (SELECT project, title, CAST(ts AS DATE) AS date, sum(requests) AS r, sum(bytes) AS b
              FROM traffic WHERE project IN ('en','de') GROUP BY ALL)
        SELECT project, title,
               round(sum(r) / CAST(date_diff('day', min(date), max(date)) + 1 AS DOUBLE), 6) AS avg_requests,
               round(sum(b) / CAST(date_diff('day', min(date), max(date)) + 1 AS DOUBLE), 6) AS avg_bytes,
               CAST(max(r) AS BIGINT) AS max_requests, CAST(max(b) AS BIGINT) AS max_bytes
        FROM d GROUP BY project, title""",
    "time_bounds": f"""WITH {traffic('all')}
        SELECT min(hour_no) AS first_hour, max(hour_no) AS last_hour FROM traffic""",
    "edge_records": f"""WITH {traffic('all')},
        ranked AS (SELECT *, row_number() OVER (ORDER BY hour_no, project, title) AS up,
                   row_number() OVER (ORDER BY hour_no DESC, project DESC, title DESC) AS down FROM traffic)
        SELECT CASE WHEN up = 1 THEN 'first' ELSE 'last' END AS edge, hour_no, project, title, requests, bytes
        FROM ranked WHERE up = 1 OR down = 1""",
    "running_totals": f"""WITH {traffic('all')},
        log AS (SELECT hour_no, sum(bytes) AS b, sum(requests) * 0.25::DOUBLE AS s FROM traffic GROUP BY hour_no),
        total AS (
          SELECT hour_no, count(*) OVER w AS files, sum(b) OVER w AS tb, sum(s) OVER w AS ts FROM log
          WINDOW w AS (ORDER BY hour_no ROWS UNBOUNDED PRECEDING))
        SELECT hour_no, files, CAST(tb AS BIGINT) AS total_bytes, round(ts, 6) AS total_seconds,
               round(tb / 1000000.0::DOUBLE / ts, 6) AS mean_speed FROM total""",
    "distinct_titles": f"WITH {traffic('langs')} SELECT DISTINCT title FROM traffic WHERE project = 'en'",
    "window_models": window_query("all", rule="loop", nonzero=False),
    "window_models_nonzero": window_query("langs"),
    "users_window_models": window_query("users"),
    "users_daily_anomalies": anomaly_query("users", f"SELECT {ANOMALIES_OUT} FROM anomalies"),
    "window_models_ragged": window_query("langs", size=50, step=7),
    "window_models_sparse": window_query("langs", size=12, step=31),
    "window_models_by_page": window_query("langs", by_page=True),
    "window_models_builtin": window_query("all"),
    "incremental_equals_full": window_query("all", rule="loop"),
    "rolled_daily_anomalies": ROLLED,
    "rolled_versions": f"WITH {traffic('langs')} SELECT {TRAFFIC} FROM traffic",
    "rolled_versions_anomalies": ROLLED,
    "rolled_window_models": window_query("all", rule="loop"),
    "kernel_weighted_mean": kernel(),
    "scored_rows": f"WITH {traffic('all')}, {models()}, {scored()} SELECT {SCORED_OUT} FROM scored",
    "scored_rows_short_steps": f"""WITH {traffic('langs')}, {models(size=48, step=6)},
        {scored(last_of_day=True)} SELECT k, {SCORED_OUT} FROM scored""",
    "scored_rows_left": f"""WITH {traffic('all')}, {models()}, {scored('LEFT')}
        SELECT {SCORED_OUT}, has_model FROM scored""",
    "scored_rows_last_window": f"""WITH {traffic('all')}, {models()}, {scored('LEFT', last_only=True)}
        SELECT {SCORED_OUT}, has_model FROM scored""",
    "severity_counts": f"""WITH {traffic('langs')}, {models()}, {scored()}
        SELECT project, title, count(*) AS rows_scored,
               {', '.join(f'count(*) FILTER (z_requests > {t}) AS beyond_{t}' for t in (2, 3, 4, 5, 6))}
        FROM scored GROUP BY project, title""",
    "severity_levels": f"""WITH {traffic('langs')}, {models()}, {scored()}
        SELECT project, CAST(CASE WHEN z_requests > 6 THEN 6 WHEN z_requests > 5 THEN 5
               WHEN z_requests > 4 THEN 4 WHEN z_requests > 3 THEN 3 WHEN z_requests > 2 THEN 2
               ELSE 0 END AS INTEGER) AS severity, count(*) AS n
        FROM scored GROUP BY ALL""",
    "anomalies_or_bytes": f"""WITH {traffic('langs')}, {models()}, {scored()}
        SELECT {SCORED_OUT} FROM scored WHERE z_requests > 3 OR z_bytes > 3""",
    "ma_daily_anomalies": anomaly_query("all", f"SELECT {ANOMALIES_OUT} FROM anomalies"),
    "ma_daily_anomalies_hours": anomaly_query("all", f"SELECT {ANOMALIES_OUT} FROM anomalies"),
    "ma_daily_anomalies_as_written": f"""WITH {traffic('all')}, {models()}, {scored()}
        SELECT project, title, year, month, min(day) AS day, max(requests) AS visit_max,
               round(max(z_requests), 6) AS relative_to_quantile,
               round(requests / avg_requests, 6) AS relative_to_norm
        FROM scored GROUP BY project, title, requests / avg_requests, year, month
        HAVING max(z_requests) > 3""",
    "top5_per_day": anomaly_query("langs", f", top AS ({TOP5}) SELECT {ANOMALIES_OUT}, rank FROM top"),
    "newsletter_distinct_pages": anomaly_query("langs", f""", top AS ({TOP5})
        SELECT {ANOMALIES_OUT}, rank FROM top
        QUALIFY row_number() OVER (PARTITION BY project, title
          ORDER BY top.relative_to_quantile DESC, year, month, day) = 1"""),
    "top_k_anomalies": anomaly_query("langs", f""", top AS (SELECT * FROM anomalies
        ORDER BY relative_to_quantile DESC, project, title, year, month, day LIMIT 10)
        SELECT {ANOMALIES_OUT} FROM top"""),
    "all_anomalies_ranked": anomaly_query("langs", f"""SELECT {ANOMALIES_OUT} FROM anomalies
        ORDER BY anomalies.relative_to_quantile DESC, project, title, year, month, day"""),
    "all_anomalies_numbered": anomaly_query("langs", f""", numbered AS (SELECT *, row_number() OVER (
        ORDER BY relative_to_quantile DESC, project, title, year, month, day) AS rank FROM anomalies)
        SELECT {ANOMALIES_OUT}, rank FROM numbered"""),
    "rolled_regression_weights": f"""WITH RECURSIVE {traffic('langs').replace('traffic AS', 'source AS', 1)},
        {LAGGED.replace('lagged AS', 'every AS', 1).replace(' traffic', ' source')},
        ranges AS (
          SELECT nr, first + to_days(a) AS low, CASE WHEN b < 0 THEN last ELSE first + to_days(b) END AS high
          FROM (VALUES ('0 ', 0, 14), ('1 ', 5, 20), ('2 ', 15, -1)) r(nr, a, b),
               (SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM source)),
        traffic AS (SELECT nr || project AS project, title, requests FROM source JOIN ranges ON CAST(ts AS DATE) BETWEEN low AND high),
        lagged AS (SELECT nr || project AS project, title, x0, x1, x2, x3, x4, x5 FROM every JOIN ranges ON CAST(ts AS DATE) BETWEEN low AND high),
        {regression_sums()}, {descent()}
        SELECT project, title, hours, n, {WEIGHTS_OUT} FROM weights JOIN stdsums USING (project, title)""",
    "lag_features": f"""WITH {traffic('all')}, {LAGGED}
        SELECT project, title, hour_id, year, month, day, hour, CAST(x0 AS DOUBLE) AS y,
               CAST(x1 AS DOUBLE) AS lag1, CAST(x2 AS DOUBLE) AS lag2, CAST(x3 AS DOUBLE) AS lag3,
               CAST(x4 AS DOUBLE) AS lag24, CAST(x5 AS DOUBLE) AS lag48 FROM lagged""",
    "page_moments": f"""WITH {traffic('all')}, {LAGGED},
        c AS (SELECT project, title, count(*) AS n FROM lagged GROUP BY project, title)
        SELECT project, title, count(*) AS hours, coalesce(any_value(c.n), 0) AS n,
               round(avg(requests), 6) AS mean, round(stddev_pop(requests), 6) AS sigma
        FROM traffic LEFT JOIN c USING (project, title) GROUP BY project, title""",
    "regression_sums": before_fit(f"SELECT project, title, hours, n, {SUMS_OUT} FROM stdsums"),
    "skipped_pages": f"""WITH {traffic('all')}, {LAGGED},
        c AS (SELECT project, title, count(*) AS n FROM lagged GROUP BY project, title)
        SELECT project, title, count(*) AS hours, coalesce(any_value(c.n), 0) AS n,
               CASE WHEN min(requests) = max(requests) THEN 'constant' ELSE 'too few hours' END AS reason
        FROM traffic LEFT JOIN c USING (project, title) GROUP BY project, title
        HAVING coalesce(any_value(c.n), 0) < 480 OR min(requests) = max(requests)""",
    "regression_weights": regression(f"SELECT project, title, {WEIGHTS_OUT} FROM weights"),
    "regression_weights_ols": before_fit(f""", {elimination()}
        SELECT project, title, {', '.join(f'round(m{i}_6, 6) AS w{i}' for i in range(6))} FROM e6"""),
    "grid_search_best_step": regression(
        "SELECT project, title, step_size, round(rss, 6) AS rss FROM weights", grid=True),
    "regression_residuals": regression("""SELECT project, title, year, month, day, hour,
        round(original, 6) AS original, round(predicted, 6) AS predicted,
        round(abs_diff, 6) AS abs_diff, round(threshold, 6) AS threshold FROM residuals"""),
    "residual_threshold": regression(
        "SELECT project, title, n, round(threshold, 6) AS threshold FROM limits"),
    "residual_quantile": regression("""SELECT project, title, count(*) AS n,
        round(quantile_cont(abs_diff, 0.999), 6) AS quantile FROM residuals GROUP BY project, title"""),
    "residual_quantile_approx": regression("""SELECT project, title, count(*) AS n,
        round(quantile_disc(abs_diff, 0.999), 6) AS quantile FROM residuals GROUP BY project, title"""),
    "rolled_residual_quantile": regression("""SELECT project, title, count(*) AS n,
        round(quantile_disc(abs_diff, 0.999), 6) AS quantile FROM residuals GROUP BY project, title"""),
    "regression_daily_anomalies": regression(REGRESSION_DAYS),
    "regression_daily_anomalies_grid": regression(REGRESSION_DAYS, grid=True),
    "traffic_series": f"""WITH {traffic('all')}
        SELECT year, month, day, hour, requests AS original FROM traffic WHERE title = 'click'""",
    "ma_series": f"""WITH {traffic('all').replace('traffic AS', 'every AS')},
        traffic AS (SELECT * FROM every WHERE title = 'click'), {models()}, {scored()}
        SELECT year, month, day, hour, round(avg_requests, 6) AS model,
               CAST(requests AS DOUBLE) AS original, round(diff_requests, 6) AS residual,
               round(3 * sqrt(var_requests), 6) AS deviations_3,
               round(avg_requests + 3 * sqrt(var_requests), 6) AS upper,
               round(avg_requests - 3 * sqrt(var_requests), 6) AS lower FROM scored""",
    "regression_series": regression(f", {REGRESSION_SERIES} SELECT {SERIES_OUT} FROM series"),
    "regression_series_long": regression(f""", {REGRESSION_SERIES}
        SELECT year, month, day, hour, series, round(value, 6) AS value FROM series
        UNPIVOT (value FOR series IN (model, original, residual, threshold, upper))"""),
}

# The jobs and files give what the operators give.
ORACLES["whitelist_file"] = ORACLES["filter_job"] = ORACLES["whitelist_semi"]
ORACLES["stats_job"] = ORACLES["page_stats"]
ORACLES["skipped_pages_ols"] = ORACLES["skipped_pages"]
ORACLES["users_severity_counts"] = ORACLES["severity_counts"].replace(traffic("langs"), traffic("users"))
