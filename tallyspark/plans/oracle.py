"""DuckDB SQL for plans.queries: the same results from the same tables.

Each text is one SELECT over the common tables of BASE.
"""

from tallyspark.plans.bindings import PRIORITIES, SERVICES

_SEEN = ", ".join(f"CAST(count(*) FILTER (WHERE service = '{s}') AS INTEGER) AS trips_{s}" for s in SERVICES)
_FILLED = ", ".join(f"ifnull(trips_{s}, 0) AS trips_{s}" for s in SERVICES)
_ORDER = ", ".join(f"CAST(count(*) FILTER (WHERE p = '{s}') AS INTEGER) AS trips_{s}" for s in PRIORITIES)
_SUMS = ", ".join(f"CAST(sum(trips_{s}) AS BIGINT) AS trips_{s}" for s in SERVICES)
_DAILY = ", ".join(f"CAST(coalesce(sum(trips_{s}), 0) AS BIGINT) AS trips_{s}" for s in PRIORITIES)
_COLS = ["n_rows", "trips_total", *(f"trips_{s}" for s in SERVICES)]
_CLASSES = ("outside_month", "zone_null", "zone_unknown", "zone_out_of_range", "in_mart")
_CLASS = """CASE WHEN NOT in_month THEN 'outside_month' WHEN zone_id IS NULL THEN 'zone_null' WHEN zone_id < 1 OR zone_id > 28 THEN 'zone_out_of_range'
         WHEN zone_id > 25 THEN 'zone_unknown' ELSE 'in_mart' END AS class"""
_ACCOUNT = "CAST(sum(trips) AS BIGINT) AS rows_read, " + ", ".join(f"CAST(sum(CASE class WHEN '{c}' THEN trips ELSE 0 END) AS BIGINT) AS rows_{c}" for c in _CLASSES)
_W = "PARTITION BY zone_id ORDER BY hour"
_DOW = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
_SERVICE_LIST = "[" + ", ".join(f"'{s}'" for s in SERVICES) + "]"
_FIXED = "date_add(make_date(y, {m}, {d}), INTERVAL (CASE isodow(make_date(y, {m}, {d})) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END) DAY)"
_NTH = "make_date(y, {m}, 1) + INTERVAL (({w} - isodow(make_date(y, {m}, 1)) + 7) % 7 + 7 * ({n} - 1)) DAY"
_HOLIDAYS = ", ".join(
    [_FIXED.format(m=m, d=d) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    + [_NTH.format(m=m, w=w, n=n) for m, w, n in ((1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4))]
    + ["make_date(y, 5, 31) - INTERVAL (isodow(make_date(y, 5, 31)) - 1) DAY"]
)
_UNUSUAL = ", ".join(f"median(CAST(n.trips_{s} AS DOUBLE)) AS m_{s}" for s in ("total", *PRIORITIES))

BASE = f"""
WITH RECURSIVE zones AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS zone_id, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey),
trips AS (SELECT event_type AS service, 'W' || ((day(ts) - 1) // 7 + 1) AS month, ts AS pickup, CASE WHEN user_id % 30 <> 27 THEN CAST(user_id % 30 AS DOUBLE) END AS zone FROM events),
svc AS (SELECT CAST(unnest(range(1, 6)) AS TINYINT) AS service_id, unnest({_SERVICE_LIST}) AS service),
raw0 AS (SELECT service, month, coalesce(pickup >= TIMESTAMP '2024-01-03' AND pickup < TIMESTAMP '2024-01-25', FALSE) AS in_month,
         date_trunc('hour', pickup) AS hour, TRY_CAST(zone AS INTEGER) AS zone_id, count(*) AS trips FROM trips GROUP BY ALL),
raw AS (SELECT service, in_month, hour, zone_id, CAST(sum(trips) AS BIGINT) AS trips FROM raw0 GROUP BY ALL),
entries AS (SELECT service, month, {_ACCOUNT} FROM (SELECT *, {_CLASS} FROM raw0) GROUP BY service, month),
fact AS (SELECT hour, zone_id, service_id, CAST(sum(trips) AS INTEGER) AS trips FROM raw JOIN svc USING (service) WHERE in_month AND zone_id BETWEEN 1 AND 28 GROUP BY ALL),
hours AS (SELECT unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-25', INTERVAL 1 HOUR)) AS hour),
seen AS (SELECT date_trunc('hour', pickup) AS hour, TRY_CAST(zone AS INTEGER) AS zone_id, CAST(count(*) AS INTEGER) AS trips_total, {_SEEN} FROM trips
         WHERE pickup BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-24 23:59:59.999999' GROUP BY ALL),
mart AS (SELECT h.hour, z.zone_id, z.borough, ifnull(trips_total, 0) AS trips_total, {_FILLED} FROM hours h, zones z LEFT JOIN seen ON seen.hour = h.hour AND seen.zone_id = z.zone_id),
om0 AS (SELECT o_orderdate AS hour, CAST(c_nationkey + 1 AS INTEGER) AS zone_id, lower(regexp_extract(o_orderpriority, '^\\d-(\\w+)', 1)) AS p FROM orders JOIN customer ON o_custkey = c_custkey),
om AS (SELECT hour, zone_id, borough, CAST(count(*) AS INTEGER) AS trips_total, {_ORDER} FROM om0 LEFT JOIN zones USING (zone_id) GROUP BY hour, zone_id, borough),
days AS (SELECT CAST(unnest(range(min(hour), max(hour) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM om),
daily AS (SELECT date, CAST(coalesce(sum(trips_total), 0) AS BIGINT) AS trips_total, {_DAILY} FROM days LEFT JOIN om ON CAST(hour AS DATE) = date GROUP BY date),
years AS (SELECT unnest(range(2022, 2028)) AS y),
hol AS (SELECT DISTINCT CAST(unnest([{_HOLIDAYS}]) AS DATE) AS date FROM years),
feat AS (SELECT hour, zone_id, borough, trips_total, {", ".join(f"lag(trips_total, {k}) OVER ({_W}) AS lag_{k}" for k in (1, 2, 3, 24, 168))},
         CASE WHEN row_number() OVER ({_W}) > 24 THEN avg(trips_total) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS roll_mean_24,
         CAST(hour(hour) AS TINYINT) AS hour_of_day, CAST(isodow(hour) - 1 AS TINYINT) AS day_of_week,
         CAST(CAST(hour AS DATE) IN (SELECT date FROM hol) AS TINYINT) AS is_holiday FROM mart),
sc AS (SELECT hour, CAST(zone_id AS SMALLINT) AS zone_id, borough, CAST(CAST(trips_total AS FLOAT) AS DOUBLE) AS actual, CAST(CAST(lag_168 AS FLOAT) AS DOUBLE) AS baseline,
       CAST(CAST(roll_mean_24 AS FLOAT) AS DOUBLE) AS forecast, CASE WHEN hour < TIMESTAMP '2024-01-20' THEN 'P1' ELSE 'P2' END AS period
       FROM feat WHERE hour >= TIMESTAMP '2024-01-15'),
split AS (SELECT *, CASE WHEN hour < TIMESTAMP '2024-01-18' THEN 'train' WHEN hour < TIMESTAMP '2024-01-21' THEN 'validation' ELSE 'test' END AS split FROM feat WHERE hour >= TIMESTAMP '2024-01-10'),
acc AS (SELECT CASE WHEN grouping(service) = 1 THEN 'all' ELSE service END AS service, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("rows_read", "rows_outside_month", "rows_zone_null", "rows_zone_unknown", "rows_zone_out_of_range", "rows_in_mart"))},
        100.0 * sum(rows_in_mart) / sum(rows_read) AS pct_in_mart FROM entries GROUP BY ROLLUP (service)),
nz AS (SELECT month, 100.0 * rows_zone_null / rows_read AS p FROM entries WHERE service = 'view'),
mdays AS (SELECT strftime(hour, '%Y-%m') AS month, count(DISTINCT CAST(hour AS DATE)) AS n FROM om GROUP BY 1),
trend AS (SELECT month, borough, t / n AS trips_per_day FROM (SELECT strftime(hour, '%Y-%m') AS month, borough, sum(trips_total) AS t FROM om GROUP BY 1, 2) JOIN mdays USING (month)),
totals AS (SELECT zone_id, CAST(sum(trips_total) AS BIGINT) AS trips_total, sum(trips_total) / (SELECT count(DISTINCT hour) FROM mart) AS avg_trips_per_hour FROM mart GROUP BY zone_id),
obs AS (SELECT event_type AS station, date_trunc('hour', ts) AS time, round(sum(value), 2) AS temperature_2m, count(*) / 10 AS precipitation FROM events GROUP BY ALL),
side AS (SELECT event_id AS id, event_type, ts AS pickup, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS dropoff, user_id, user_id % 30 AS pu, CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS do_zone,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 5 <> 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS VARCHAR) END AS grp FROM events),
hit AS (SELECT DISTINCT l.id FROM side l JOIN side r ON l.event_type = 'click' AND r.event_type = 'view' AND l.user_id = r.user_id
        AND abs(epoch_us(l.pickup) - epoch_us(r.pickup)) <= 3600000000 AND abs(epoch_us(l.dropoff) - epoch_us(r.dropoff)) <= 3600000000),
unusual AS (SELECT d.date, {_DOW}[isodow(d.date)] AS weekday, d.trips_total, {", ".join(f"100 * d.trips_{s} / nullif(m_{s}, 0) AS pct_{s}" for s in ("total", *PRIORITIES))}
            FROM daily d JOIN (SELECT x.date, count(*) AS k, {_UNUSUAL} FROM daily x JOIN daily n ON n.date <> x.date AND abs(n.date - x.date) <= 28 AND abs(n.date - x.date) % 7 = 0 GROUP BY x.date) USING (date)
            WHERE k >= 4 AND (d.trips_total / nullif(m_total, 0) < 0.6 OR d.trips_total / nullif(m_total, 0) > 1.4)),
bdays AS (SELECT period, CAST(hour AS DATE) AS day, sum(abs(forecast - actual) - abs(baseline - actual)) AS diff, count(*) AS n FROM sc GROUP BY 1, 2),
bnum AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY period) AS d FROM bdays),
picks AS (SELECT period, b, CAST('0x' || substr(md5('42:' || b || ':' || i), 1, 8) AS BIGINT) % d AS k
          FROM (SELECT DISTINCT period, d FROM bnum), (SELECT unnest(range(0, 200)) AS b), (SELECT unnest(range(0, 40)) AS i) WHERE i < d),
boots AS (SELECT period, b, sum(diff) / sum(n) AS v FROM picks JOIN bnum USING (period, k) GROUP BY 1, 2),
boot AS (SELECT period, any_value(m) AS mae_diff, quantile_cont(v, 0.025) AS ci95_low, quantile_cont(v, 0.975) AS ci95_high, any_value(nd) AS n_days
         FROM boots JOIN (SELECT period, sum(diff) / sum(n) AS m, count(*) AS nd FROM bdays GROUP BY 1) USING (period) GROUP BY period),
per AS (SELECT period, count(*) AS n_rows, count(DISTINCT zone_id) AS n_zones, avg(actual) AS mean_actual,
        avg(abs(baseline - actual)) AS mae_baseline, sqrt(avg((baseline - actual) ** 2)) AS rmse_baseline, sum(abs(baseline - actual)) / sum(actual) AS wape_baseline,
        avg(abs(forecast - actual)) AS mae_forecast, sqrt(avg((forecast - actual) ** 2)) AS rmse_forecast, sum(abs(forecast - actual)) / sum(actual) AS wape_forecast
        FROM sc GROUP BY period)
"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _audit(trips: str) -> str:
    """Windows over the mart against joins by time over the mart with some trips."""
    lags = {1: "lag_1", 24: "lag_24", 168: "lag_168"}
    joins = " ".join(f"LEFT JOIN v AS v{k} ON v{k}.zone_id = v.zone_id AND v{k}.hour = v.hour - INTERVAL {k} HOUR" for k in lags)
    other = f"""SELECT v.zone_id, v.hour, {", ".join(f"v{k}.y AS {c}" for k, c in lags.items())},
        (SELECT CASE WHEN count(*) = 24 THEN avg(p.y) END FROM v p WHERE p.zone_id = v.zone_id AND p.hour < v.hour AND p.hour >= v.hour - INTERVAL 24 HOUR) AS roll_mean_24
        FROM (SELECT zone_id, hour, {trips} AS y FROM mart) v {joins}""".replace("FROM v p", f"FROM (SELECT zone_id, hour, {trips} AS y FROM mart) p").replace("JOIN v AS", f"JOIN (SELECT zone_id, hour, {trips} AS y FROM mart) AS")
    columns = [*lags.values(), "roll_mean_24"]
    odd = " OR ".join(["a.zone_id IS NULL", "b.zone_id IS NULL", *(f"(a.{c} IS NULL) <> (b.{c} IS NULL)" for c in columns)])
    return f"""SELECT count(*) FILTER (WHERE {odd}) AS unmatched, {", ".join(f"round(CAST(coalesce(max(abs(a.{c} - b.{c})), 0) AS DOUBLE), 6) AS max_diff_{c}" for c in columns)}
        FROM feat a FULL JOIN ({other}) b ON a.zone_id = b.zone_id AND a.hour = b.hour"""


_SC = f"hour, zone_id, borough, {_r('actual', 'baseline', 'forecast')}"
_MAES = "round(avg(abs(baseline - actual)), 6) AS mae_baseline, round(avg(abs(forecast - actual)), 6) AS mae_forecast"

SQL = {
    "trip_scan": "SELECT service, pickup, zone FROM trips",
    "dim_zone": "SELECT * FROM zones",
    "dim_service": "SELECT service_id, service FROM svc SEMI JOIN trips USING (service)",
    "dim_hour": """SELECT hour, CAST(hour AS DATE) AS date, CAST(hour(hour) AS TINYINT) AS hour_of_day, CAST(isodow(hour) - 1 AS TINYINT) AS day_of_week,
        CAST(hour AS DATE) IN (SELECT date FROM hol) AS is_holiday,
        hour IN (SELECT unnest([make_date(y, 3, 1) + INTERVAL ((7 - isodow(make_date(y, 3, 1))) % 7 + 7) DAY + INTERVAL 2 HOUR, make_date(y, 11, 1) + INTERVAL ((7 - isodow(make_date(y, 11, 1))) % 7) DAY + INTERVAL 1 HOUR]) FROM years) AS is_dst_transition
        FROM (SELECT unnest(range(CAST(make_date(year(min(ts)), 1, 1) AS TIMESTAMP), CAST(make_date(year(max(ts)) + 1, 1, 1) AS TIMESTAMP), INTERVAL 1 HOUR)) AS hour FROM events)""",
    "read_mart": "SELECT hour, zone_id, borough, trips_total FROM mart",
    "read_mart_wide": "SELECT * FROM mart",
    "fact_pickups_hourly": "SELECT * FROM fact",
    "months_to_build": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE strftime(o_orderdate, '%Y-%m') >= '2001-01'",
    "quality_upsert": "SELECT * REPLACE (CASE WHEN month < 'W2' THEN rows_read * 10 ELSE rows_read END AS rows_read) FROM entries WHERE month <= 'W3'",
    "weather_explode": f"SELECT station, time, {_r('temperature_2m', 'precipitation')} FROM obs",
    "weather_gaps": "SELECT count(*) AS hours, CAST(count(*) FILTER (WHERE temperature_2m IS NULL) AS BIGINT) AS missing FROM (SELECT * FROM hours, (SELECT DISTINCT station FROM obs)) g LEFT JOIN obs o ON o.station = g.station AND o.time = g.hour",
    "weather_local_hourly": """SELECT g.station, g.hour, round(last_value(temperature_2m IGNORE NULLS) OVER w, 6) AS temperature_2m, round(last_value(precipitation IGNORE NULLS) OVER w, 6) AS precipitation
        FROM (SELECT * FROM hours, (SELECT DISTINCT station FROM obs)) g LEFT JOIN obs o ON o.station = g.station AND o.time = g.hour + INTERVAL 5 HOUR
        WINDOW w AS (PARTITION BY g.station ORDER BY g.hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "read_backtest": f"SELECT hour, CAST(zone_id AS INTEGER) AS zone_id, borough, {_r('actual', 'baseline', 'forecast')} FROM sc",
    "mart_unpivot": "SELECT CAST(hour AS DATE) AS date, hour, zone_id, borough, service, trips FROM (" + " UNION ALL ".join(f"SELECT hour, zone_id, borough, '{s}' AS service, trips_{s} AS trips FROM mart" for s in SERVICES) + ")",
    "dim_date": f"SELECT date, strftime(date, '%Y-%m') AS year_month, {_DOW}[isodow(date)] AS weekday, isodow(date) >= 6 AS is_weekend FROM days",
    "daily_by_service": " UNION ALL ".join(f"SELECT date, '{s}' AS service, trips_{s} AS trips FROM daily" for s in PRIORITIES),
    "month_raw": "SELECT * FROM raw",
    "quality_month": f"SELECT service, {_ACCOUNT} FROM (SELECT *, {_CLASS} FROM raw) GROUP BY service",
    "mart_demand_hourly": "SELECT * FROM mart",
    "month_bounds": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, date_trunc('month', o_orderdate) AS start, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS \"end\" FROM orders",
    "month_weeks": """SELECT month, s AS start, least(s + INTERVAL 7 DAY, e) AS "end" FROM (SELECT month, e, unnest(range(m, e, INTERVAL 7 DAY)) AS s FROM
        (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) AS e FROM orders))""",
    "partition_compare": "SELECT " + ", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2, b.{c} - a.{c} AS {c}_diff" for c in _COLS) + ", " + " AND ".join(f"a.{c} = b.{c}" for c in _COLS) + " AS identical FROM "
        + ", ".join(f"(SELECT count(*) AS n_rows, CAST(sum(trips_total) AS BIGINT) AS trips_total, {_SUMS} FROM mart WHERE {w}) {n}" for n, w in (("a", "TRUE"), ("b", "zone_id <> 7"))),
    "dim_consistency": """SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, CASE WHEN b.zone_id IS NULL THEN 'missing' WHEN a.zone_id IS NULL THEN 'extra' ELSE 'name' END AS problem
        FROM zones a FULL JOIN (SELECT zone_id, if(zone_id = 5, 'ELSEWHERE', zone) AS zone FROM zones WHERE zone_id <> 3 UNION ALL SELECT 99, zone FROM zones WHERE zone_id = 1) b ON a.zone_id = b.zone_id
        WHERE a.zone_id IS NULL OR b.zone_id IS NULL OR a.zone IS DISTINCT FROM b.zone""",
    "build_features": f"SELECT * REPLACE (round(roll_mean_24, 6) AS roll_mean_24) FROM feat",
    "build_features_month": f"""SELECT * REPLACE (round(roll_mean_24, 6) AS roll_mean_24) FROM (
        SELECT *, {", ".join(f"lag(trips_total, {k}) OVER ({_W}) AS lag_{k}" for k in (1, 2, 3, 24, 168))}, avg(trips_total) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS roll_mean_24,
        CAST(hour(hour) AS TINYINT) AS hour_of_day, CAST(isodow(hour) - 1 AS TINYINT) AS day_of_week, CAST(CAST(hour AS DATE) IN (SELECT date FROM hol) AS TINYINT) AS is_holiday
        FROM (SELECT h.hour, z.zone_id, z.borough, ifnull(trips_total, 0) AS trips_total FROM (SELECT unnest(range(TIMESTAMP '2023-12-20', TIMESTAMP '2024-01-25', INTERVAL 1 HOUR)) AS hour) h, zones z LEFT JOIN mart ON mart.hour = h.hour AND mart.zone_id = z.zone_id))
        WHERE hour >= TIMESTAMP '2024-01-01'""",
    "trip_files": "SELECT service, month, pickup, zone FROM trips",
    "join_many_to_one": "SELECT * FROM fact LEFT JOIN zones USING (zone_id)",
    "feature_audit": _audit("trips_total"),
    "feature_audit_changed": _audit("trips_total + CASE WHEN zone_id = 3 AND hour = TIMESTAMP '2024-01-10 05:00:00' THEN 5 ELSE 0 END"),
    "grid_violations": f"SELECT CAST(count(*) FILTER (WHERE step <> INTERVAL 1 HOUR) AS BIGINT) AS violations FROM (SELECT hour - lag(hour) OVER ({_W}) AS step FROM mart WHERE NOT (zone_id = 2 AND hour(hour) = 5))",
    "chrono_split": "SELECT hour, zone_id, split FROM split",
    "split_counts": "SELECT split, count(*) AS n_rows FROM split GROUP BY split",
    "overview_kpis": "SELECT CAST(sum(trips_total) AS BIGINT) AS total_trips, min(hour) AS first_hour, max(hour) AS last_hour, count(DISTINCT zone_id) AS n_zones FROM mart",
    "daily_totals": "SELECT * FROM daily",
    "service_share": "SELECT service, trips, round(100.0 * trips / sum(trips) OVER (), 6) AS share_pct FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS service, CAST(sum(trips_{s}) AS BIGINT) AS trips FROM mart" for s in SERVICES) + ")",
    "hourly_profile": "SELECT CASE WHEN isodow(hour) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CAST(hour(hour) AS INTEGER) AS hour_of_day, round(avg(t), 6) AS trips_per_hour FROM (SELECT hour, sum(trips_total) AS t FROM mart GROUP BY hour) GROUP BY 1, 2",
    "zone_totals": "SELECT zone_id, trips_total, round(avg_trips_per_hour, 6) AS avg_trips_per_hour, zone, borough FROM totals JOIN zones USING (zone_id)",
    "zone_log_volume": "SELECT zone_id, round(log10(greatest(sum(trips_total) / (SELECT count(DISTINCT hour) FROM om), 1.0)), 6) AS log10_trips FROM om GROUP BY zone_id",
    "top_zones": "SELECT zone_id, trips_total, round(avg_trips_per_hour, 6) AS avg_trips_per_hour, zone, borough FROM totals JOIN zones USING (zone_id) ORDER BY trips_total DESC, zone_id LIMIT 15",
    "zone_labels": "SELECT zone_id, zone || ', ' || borough || ' [' || zone_id || ']' AS label FROM zones",
    "source_vs_mart": "SELECT * REPLACE (round(pct_in_mart, 6) AS pct_in_mart) FROM acc",
    "largest_gap": f"SELECT service, reason, rows FROM (UNPIVOT (SELECT service, rows_outside_month, rows_zone_null, rows_zone_unknown, rows_zone_out_of_range FROM acc WHERE service <> 'all') ON rows_outside_month, rows_zone_null, rows_zone_unknown, rows_zone_out_of_range INTO NAME reason VALUE rows) ORDER BY rows DESC, list_position({_SERVICE_LIST}, service), list_position(['rows_outside_month', 'rows_zone_null', 'rows_zone_unknown', 'rows_zone_out_of_range'], reason) LIMIT 1",
    "null_zone_share": "SELECT month, round(p, 6) AS pct_zone_null FROM nz",
    "null_zone_summary": """SELECT round(min(p), 6) AS lowest, round(max(p), 6) AS highest, max(month) FILTER (WHERE k = 1) AS worst_month, max(month) FILTER (WHERE k = 2) AS second_month,
        round(median(p) FILTER (WHERE k > 2), 6) AS median_rest FROM (SELECT month, CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p DESC, month) AS k FROM nz)""",
    "borough_hourly": f"SELECT borough, hour, CAST(sum(trips_total) AS BIGINT) AS trips_total, {_SUMS} FROM mart GROUP BY borough, hour",
    "weekday_heatmap": f"SELECT {_DOW}[w] AS weekday, " + ", ".join(f"round(avg(t) FILTER (WHERE h = {h}), 6) AS h{h:02d}" for h in range(24)) + " FROM (SELECT unnest(range(1, 8)) AS w) LEFT JOIN (SELECT isodow(hour) AS w, hour(hour) AS h, t FROM (SELECT hour, sum(trips_total) AS t FROM mart GROUP BY hour)) USING (w) GROUP BY w",
    "monthly_trend": f"SELECT month, borough, {_r('trips_per_day')} FROM trend",
    "monthly_trend_city": "SELECT month, round(sum(trips_total) / any_value(n), 6) AS trips_per_day FROM om JOIN mdays ON month = strftime(hour, '%Y-%m') GROUP BY month",
    "trend_wide": "SELECT month, " + ", ".join(f"round(max(trips_per_day) FILTER (WHERE borough = '{x}'), 6) AS \"{x}\"" for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM trend GROUP BY month",
    "month_over_month": """SELECT month, borough, round(100 * (trips_per_day / lag(trips_per_day) OVER (PARTITION BY borough ORDER BY month) - 1), 6) AS change_pct
        FROM (SELECT * FROM (SELECT DISTINCT month FROM trend), (SELECT DISTINCT borough FROM trend)) LEFT JOIN trend USING (month, borough)""",
    "bi_mom": """SELECT a.month, a.trips, b.trips AS previous, round(100.0 * (a.trips - b.trips) / b.trips, 6) AS change_pct FROM m a LEFT JOIN m b ON a.month = strftime(strptime(b.month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m')""",
    "service_mix": "SELECT borough, service, trips, round(100.0 * trips / nullif(sum(trips) OVER (PARTITION BY borough), 0), 6) AS share_pct FROM (" + " UNION ALL ".join(f"SELECT borough, '{s}' AS service, CAST(sum(trips_{s}) AS BIGINT) AS trips FROM mart GROUP BY borough" for s in SERVICES) + ")",
    "zone_kpis": """SELECT zone_id, CAST(sum(t) AS BIGINT) AS total_trips, round(sum(t) / sum(n), 6) AS avg_trips_per_hour, CAST(arg_max(h, (a, -h)) AS INTEGER) AS peak_hour_of_day, round(max(a), 6) AS peak_hour_avg_trips
        FROM (SELECT zone_id, hour(hour) AS h, avg(trips_total) AS a, sum(trips_total) AS t, count(*) AS n FROM mart GROUP BY 1, 2) GROUP BY zone_id""",
    "unusual_days": f"SELECT date, weekday, trips_total, round(pct_total, 6) AS pct_of_normal, {_r(*(f'pct_{s}' for s in PRIORITIES))} FROM unusual",
    "unusual_days_report": "SELECT strftime(date, '%Y-%m-%d') AS date, weekday, trips_total, round_even(pct_total, 1) AS pct_of_normal FROM unusual",
    "volume_rank": "SELECT borough, CAST(sum(trips_total) AS BIGINT) AS trips_total FROM om GROUP BY borough",
    "bi_measures": "SELECT service, trips, round(100.0 * trips / sum(trips) OVER (), 6) AS share_pct, round(trips / (z * h), 6) AS avg_per_zone_hour FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS service, CAST(sum(trips_{s}) AS BIGINT) AS trips FROM mart" for s in SERVICES) + "), (SELECT count(DISTINCT zone_id) AS z, count(DISTINCT hour) AS h FROM mart)",
    "borough_month_matrix": "SELECT borough, " + ", ".join(f"CAST(sum(trips_total) FILTER (WHERE strftime(hour, '%Y-%m') = '1998-0{m}') AS BIGINT) AS \"1998-0{m}\"" for m in range(1, 7)) + " FROM om GROUP BY borough",
    "zone_slice": "SELECT * EXCLUDE (borough) FROM mart WHERE zone_id = 4",
    "heatmap_slice": "SELECT hour, CAST(sum(trips_click) AS BIGINT) AS trips FROM mart WHERE borough = 'ASIA' GROUP BY hour",
    "interval_match": "SELECT id FROM hit",
    "interval_match_zones": """SELECT DISTINCT l.id FROM side l JOIN side r ON l.event_type = 'click' AND r.event_type = 'view' AND l.pu = r.pu AND l.do_zone = r.do_zone
        AND abs(epoch_us(l.pickup) - epoch_us(r.pickup)) <= 3600000000 AND abs(epoch_us(l.dropoff) - epoch_us(r.dropoff)) <= 3600000000""",
    "interval_match_window": """SELECT DISTINCT l.id FROM side l JOIN side r ON l.event_type = 'click' AND r.event_type = 'view' AND l.user_id = r.user_id
        AND abs(epoch_us(l.pickup) - epoch_us(r.pickup)) <= 3600000000 AND abs(epoch_us(l.dropoff) - epoch_us(r.dropoff)) <= 3600000000
        WHERE l.pickup >= TIMESTAMP '2024-01-08' AND l.pickup < TIMESTAMP '2024-01-15' AND r.pickup >= TIMESTAMP '2024-01-07 23:00:00' AND r.pickup < TIMESTAMP '2024-01-15 01:00:00'""",
    "match_rate": "SELECT coalesce(grp, 'null') AS \"group\", count(*) AS trips, count(hit.id) AS matched, round(count(hit.id) / count(*), 6) AS rate FROM side LEFT JOIN hit USING (id) WHERE event_type = 'click' GROUP BY 1",
    "match_rate_ci": """SELECT g AS "group", round(m / n, 6) AS rate, round(l, 6) AS low, round(h, 6) AS high FROM rt JOIN (SELECT g, quantile_cont(r, 0.025) AS l, quantile_cont(r, 0.975) AS h FROM drawn GROUP BY g) USING (g)
        UNION ALL SELECT '1 - 2', round((SELECT m / n FROM rt WHERE g = '1') - (SELECT m / n FROM rt WHERE g = '2'), 6), round(quantile_cont(r, 0.025), 6), round(quantile_cont(r, 0.975), 6) FROM gap""",
    "score_clip": "SELECT hour, zone_id, round(greatest(CAST(2 * lag_1 - lag_2 AS DOUBLE), 0.0), 6) AS forecast FROM feat WHERE lag_2 IS NOT NULL",
    "scored": f"SELECT {_SC} FROM sc",
    "hour_snapshot": f"SELECT zone_id, {_r('actual', 'baseline', 'forecast')}, round(forecast - actual, 6) AS error FROM sc WHERE hour = TIMESTAMP '2024-01-16 09:00:00'",
    "snapshot_kpis": f"SELECT round(sum(forecast), 6) AS total_forecast, round(sum(actual), 6) AS total_actual, {_MAES}, round(max(forecast), 6) AS max_forecast FROM sc WHERE hour = TIMESTAMP '2024-01-16 09:00:00'",
    "backtest_series": "SELECT hour, " + ", ".join(f"round(sum({c}), 6) AS {c}" for c in ("actual", "baseline", "forecast")) + " FROM sc WHERE hour >= TIMESTAMP '2024-01-16' AND hour < TIMESTAMP '2024-01-18' GROUP BY hour",
    "month_slice": f"SELECT {_SC} FROM sc WHERE hour < TIMESTAMP '2024-02-01' AND borough = 'ASIA'",
    "mae_by_hour": f"SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, {_MAES} FROM sc GROUP BY 1",
    "zone_errors": f"SELECT zone_id, round(avg(actual), 6) AS mean_actual, {_MAES}, avg(actual) >= 0.15 AS stable, CASE WHEN avg(actual) >= 0.15 THEN round(100 * sum(abs(forecast - actual)) / sum(actual), 6) END AS wape_forecast FROM sc GROUP BY zone_id",
    "largest_misses": f"SELECT hour, zone_id, {_r('actual', 'baseline', 'forecast')}, round(forecast - actual, 6) AS error FROM sc ORDER BY abs(forecast - actual) DESC, strftime(hour, '%Y-%m'), zone_id, hour LIMIT 10",
    "error_metrics": "SELECT round(avg(abs(forecast - actual)), 6) AS mae, round(sqrt(avg((forecast - actual) ** 2)), 6) AS rmse, round(sum(abs(forecast - actual)) / sum(actual), 6) AS wape FROM sc",
    "naive_metrics": " UNION ALL ".join(f"SELECT round(avg(abs({c} - trips_total)), 6) AS mae, round(sqrt(avg(({c} - trips_total) ** 2)), 6) AS rmse, round(sum(abs({c} - trips_total)) / sum(trips_total), 6) AS wape, '{c}' AS reference FROM feat WHERE lag_168 IS NOT NULL" for c in ("lag_1", "lag_168")),
    "evaluate_periods": f"SELECT period, n_rows, n_zones, {_r('mean_actual', *(f'{m}_{c}' for c in ('baseline', 'forecast') for m in ('mae', 'rmse', 'wape')))}, round(100 * (1 - mae_forecast / mae_baseline), 6) AS improvement_pct, wape_forecast < 0.1 OR 100 * (1 - mae_forecast / mae_baseline) > 60 AS leakage_check_required FROM per",
    "borough_metrics": "SELECT period, borough, count(DISTINCT zone_id) AS n_zones, count(*) AS n_rows, round_even(avg(actual), 3) AS mean_actual, " + ", ".join(f"round_even({e}, 4) AS {n}_{c}" for n in ("mae", "wape") for c in ("baseline", "forecast") for e in ([f"avg(abs({c} - actual))"] if n == "mae" else [f"sum(abs({c} - actual)) / nullif(sum(actual), 0)"])) + " FROM sc GROUP BY 1, 2",
    "day_bootstrap": f"SELECT period, {_r('mae_diff', 'ci95_low', 'ci95_high')}, CAST(200 AS INTEGER) AS n_bootstrap, CAST(n_days AS INTEGER) AS n_days FROM boot",
    "accuracy_report": f"""SELECT period, {_r('mae_baseline', 'mae_forecast')}, round(100 * wape_baseline, 6) AS wape_baseline_pct, round(100 * wape_forecast, 6) AS wape_forecast_pct,
        printf('%.2f [%.2f, %.2f]', round_even(mae_diff, 2) + 0.0, round_even(ci95_low, 2) + 0.0, round_even(ci95_high, 2) + 0.0) AS difference FROM per JOIN boot USING (period)""",
}
SQL |= {"build_features_sliced": SQL["build_features"], "quality_newest": SQL["quality_upsert"]}
SQL |= {f"kept_{k}": SQL[k] for k in ("overview_kpis", "zone_totals", "zone_kpis", "daily_totals", "service_mix", "weekday_heatmap", "monthly_trend")}
_CHANCE = "CASE WHEN m IN (0, n) THEN CASE WHEN k = m THEN 1.0 ELSE 0.0 END ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(m / n) + (n - k) * ln(1 - m / n)) END"
_EXTRA = {"match_rate_ci": f""",
rt AS (SELECT coalesce(grp, 'null') AS g, count(*) AS n, count(hit.id) AS m FROM side LEFT JOIN hit USING (id) WHERE event_type = 'click' GROUP BY 1),
dist AS (SELECT g, k, n, sum({_CHANCE}) OVER (PARTITION BY g ORDER BY k) AS c FROM (SELECT g, n, m, unnest(range(0, n + 1)) AS k FROM rt)),
lev AS (SELECT g, b, (CAST('0x' || substr(md5('42:' || g || ':' || b), 1, 12) AS BIGINT) + 0.5) / 2.0 ** 48 AS u FROM rt, (SELECT unnest(range(0, 1000)) AS b)),
drawn AS (SELECT g, b, min(k) / any_value(n) AS r FROM lev JOIN dist USING (g) WHERE c > u GROUP BY g, b),
gap AS (SELECT x.r - y.r AS r FROM drawn x JOIN drawn y USING (b) WHERE x.g = '1' AND y.g = '2')""", "bi_mom": ", m AS (SELECT strftime(hour, '%Y-%m') AS month, CAST(sum(trips_total) AS BIGINT) AS trips FROM om WHERE hour NOT BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31' GROUP BY 1)"}

ORACLE_SQL = {k: f"{BASE}{_EXTRA.get(k, '')}\n{v}" for k, v in SQL.items()}
