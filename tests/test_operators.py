"""Features, reports, matching, evaluation and the model on hand-made frames."""

import json
import math
import random
from datetime import datetime as D
from datetime import timedelta as T

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.time import ntz
from tallyspark.operators import evaluate, features, matching, model, reports
from tallyspark.sources import io

SERVICES = ["fhvhv", "fhv", "green", "yellow"]
HOUR = T(hours=1)


def grid(hours=400, zones=(1, 2), start=D(2026, 1, 1), seed=0):
    r = random.Random(seed)
    rows = [(start + i * HOUR, z, "B", r.randrange(50)) for z in zones for i in range(hours)]
    r.shuffle(rows)
    return rows


def demand(spark, rows):
    return spark.createDataFrame(rows, "hour timestamp_ntz, zone_id int, borough string, trips_total int")


def by_key(df):
    return {(r.zone_id, r.hour): r for r in df.collect()}


def test_lags_and_rolling(spark):
    rows = grid()
    value = {(z, h): v for h, z, _, v in rows}
    got = by_key(features.build_features(demand(spark, rows)))
    at = D(2026, 1, 1) + 300 * HOUR
    x = got[1, at]
    assert [x[f"lag_{k}"] for k in features.LAGS] == [value[1, at - k * HOUR] for k in features.LAGS]
    assert x.roll_mean_24 == pytest.approx(sum(value[1, at - k * HOUR] for k in range(1, 25)) / 24)
    for (_, h), r in got.items():
        i = (h - D(2026, 1, 1)) // HOUR
        assert (r.lag_168 is None) == (i < 168) and (r.roll_mean_24 is None) == (i < 24)


def test_no_look_ahead_and_no_leak_between_zones(spark):
    rows, at = grid(), D(2026, 1, 1) + 250 * HOUR
    one = by_key(features.build_features(demand(spark, rows)))
    two = by_key(features.build_features(demand(spark, [(h, z, b, 999 if h >= at and z == 1 else v) for h, z, b, v in rows])))
    names = [*model.HISTORY]
    for k, r in one.items():
        if k[0] == 2 or k[1] <= at:
            assert [r[c] for c in names] == [two[k][c] for c in names]
    assert two[1, at + HOUR].lag_1 == 999


def test_broken_grid_is_refused(spark):
    rows = [r for r in grid() if not (r[1] == 1 and r[0] == D(2026, 1, 3))]
    with pytest.raises(ValueError):
        features.check_grid(demand(spark, rows))
    features.check_grid(demand(spark, grid()))
    for broken in (rows, [*grid(), grid()[7]]):
        with pytest.raises(Exception, match="without a gap"):
            features.build_features(demand(spark, broken)).select("zone_id").collect()
    with pytest.raises(ValueError):
        features.join_many_to_one(demand(spark, rows), demand(spark, rows).select("zone_id"), ["zone_id"])


def flat(spark, change=lambda h, z: {}, days=70, start=D(2026, 1, 5)):
    rows = []
    for z, borough in ((1, "Manhattan"), (2, "Queens")):
        for i in range(days * 24):
            v = {"fhvhv": 12, "fhv": 2, "green": 2, "yellow": 4} | change(start + i * HOUR, z)
            total = v.pop("total", None)
            rows.append((start + i * HOUR, z, borough, total if total is not None else sum(v.values()), *(v[s] for s in SERVICES)))
    return spark.createDataFrame(rows, "hour timestamp_ntz, zone_id int, borough string, trips_total int, " + ", ".join(f"trips_{s} int" for s in SERVICES))


def test_kpis_totals_shares(spark):
    mart = flat(spark)
    k = reports.overview_kpis(mart).first()
    assert k.total_trips == 2 * 70 * 24 * 20 and k.n_zones == 2
    daily = reports.daily_totals(mart, SERVICES)
    assert daily.count() == 70 and {r.trips_total for r in daily.collect()} == {960}
    gap = reports.daily_totals(mart.where("hour < timestamp_ntz'2026-01-07' OR hour >= timestamp_ntz'2026-01-09'"), SERVICES)
    assert gap.count() == 70 and gap.where("trips_total = 0").count() == 2
    assert [r.share_pct for r in reports.service_share(mart, SERVICES).collect()] == [60, 10, 10, 20]
    none = reports.service_share(mart.withColumns({f"trips_{s}": F.lit(0) for s in SERVICES}), SERVICES)
    assert {r.share_pct for r in none.collect()} == {0}


def test_profile_heatmap_zones(spark):
    mart = flat(spark, lambda h, z: {"total": 50} if h.weekday() >= 5 and h.hour == 12 else {})
    got = {(r.day_type, r.hour_of_day): r.trips_per_hour for r in reports.hourly_profile(mart).collect()}
    assert got["Weekday", 12] == 40 and got["Weekend", 12] == 100
    table = {r.weekday: r for r in reports.weekday_heatmap(flat(spark, lambda h, z: {"total": 100} if h.weekday() == 4 and h.hour == 18 else {})).collect()}
    assert len(table) == 7 and table["Fri"].h18 == 200 and table["Fri"].h17 == 40
    zones = spark.createDataFrame([(1, "A", "Manhattan"), (2, "B", "Queens")], "zone_id int, zone string, borough string")
    totals = reports.zone_totals(flat(spark, lambda h, z: {"total": 30} if z == 2 else {}), zones)
    assert reports.top_zones(totals, 1).first()["zone_id"] == 2 and totals.where("zone_id = 2").first()["avg_trips_per_hour"] == 30
    peak = reports.zone_kpis(flat(spark, lambda h, z: {"total": 44} if h.hour in (8, 9) else {})).first()
    assert (peak.peak_hour_of_day, peak.peak_hour_avg_trips) == (8, 44)


def test_months_and_mix(spark):
    mart = flat(spark, lambda h, z: {"total": 30} if z == 1 and h.month == 2 else {}, days=90, start=D(2026, 1, 1))
    trend = reports.monthly_trend(mart, "borough")
    got = {(r.month, r.borough): r.trips_per_day for r in trend.collect()}
    assert got["2026-01", "Manhattan"] == 480 and got["2026-02", "Manhattan"] == 720
    change = [r.change_pct for r in reports.month_over_month(trend, "borough").where("borough = 'Manhattan'").orderBy("month").collect()]
    assert change[0] is None and change[1:] == pytest.approx([50, -100 / 3])
    mix = reports.service_mix(flat(spark, lambda h, z: {"yellow": 0} if z == 2 else {}), SERVICES).collect()
    assert next(r.share_pct for r in mix if (r.borough, r.service) == ("Queens", "fhvhv")) == 75
    assert sum(r.share_pct for r in mix) == pytest.approx(200)


def unusual(spark, change, days=70, **more):
    return reports.unusual_days(reports.daily_totals(flat(spark, change, days), SERVICES), SERVICES, **more).collect()


def test_unusual_days(spark):
    day = D(2026, 2, 11)
    (one,) = unusual(spark, lambda h, z: {"fhvhv": 6, "fhv": 1, "green": 1, "yellow": 0} if h.date() == day.date() else {})
    assert (one.date, one.weekday, one.trips_total) == (day.date(), "Wed", 384)
    assert (one.pct_of_normal, one.pct_fhvhv, one.pct_yellow) == pytest.approx((40, 50, 0))
    for factor, flagged in ((1.5, True), (0.59, True), (0.61, False)):
        found = unusual(spark, lambda h, z: {"total": round(2000 * factor)} if h.date() == day.date() else {"total": 2000})  # noqa: B023
        assert bool(found) == flagged


def test_unusual_days_need_history(spark):
    odd = lambda h, z: {"total": 2} if h.date() == D(2026, 1, 15).date() else {}
    assert unusual(spark, odd, 21) == []
    found = {r.date: r.pct_of_normal for r in unusual(spark, odd, 21, least=2)}
    assert found[D(2026, 1, 15).date()] == pytest.approx(10) and len(found) == 3  # its two neighbours stand out against it


def test_quality_reports(spark):
    rows = [("yellow", "2026-01", 100, 2, 0, 8, 0, 90), ("fhv", "2026-01", 200, 0, 160, 0, 0, 40), ("fhv", "2026-02", 100, 0, 90, 0, 0, 10)]
    entries = spark.createDataFrame(rows, "service string, month string, " + ", ".join(f"{c} long" for c in io.ENTRY_COUNTS))
    account = reports.source_vs_mart(entries, ["yellow", "green", "fhv", "fhvhv"])
    got = account.collect()
    assert [r.service for r in got] == ["yellow", "fhv", "all"] and (got[2].rows_read, got[2].rows_in_mart, got[2].pct_in_mart) == (400, 140, 35)
    assert tuple(reports.largest_gap(account, ["yellow", "green", "fhv", "fhvhv"]).first()) == ("fhv", "rows_zone_null", 250)
    assert [r.pct_zone_null for r in reports.null_zone_share(entries, "fhv").orderBy("month").collect()] == [80, 90]


def backtest(spark):
    rows = [(D(2026, 5, 1) + i * HOUR, z, "B", a, b, f) for i in range(48) for z, a, b, f in ((1, 100.0, 90.0, 104.0), (2, 2.0, 4.0, 3.0))]
    return spark.createDataFrame(rows, "hour timestamp_ntz, zone_id int, borough string, actual double, baseline double, forecast double")


def test_forecast_reports(spark):
    rows = backtest(spark)
    assert {tuple(r)[1:] for r in evaluate.mae_by_hour(rows).collect()} == {(6, 2.5)}
    errors = {r.zone_id: r.wape_forecast for r in evaluate.zone_errors(rows).collect()}
    assert errors == {1: 4, 2: None} and evaluate.zone_errors(rows, 2).where("zone_id = 2").first()["wape_forecast"] == 50
    k = evaluate.snapshot_kpis(evaluate.snapshot(rows, ntz("2026-05-01 03:00:00"))).first()
    assert (k.total_forecast, k.total_actual, k.mae_forecast, k.mae_baseline) == (107, 102, 2.5, 6)
    odd = rows.withColumn("forecast", F.when((F.col("zone_id") == 2) & (F.col("hour") == ntz("2026-05-01 05:00:00")), 302.0).when((F.col("zone_id") == 1) & (F.col("hour") == ntz("2026-05-02 05:00:00")), 0.0).otherwise(F.col("forecast")))
    assert [r.error for r in evaluate.largest_misses(odd, 3).collect()] == [300, -100, 4]


def test_metrics_and_bootstrap(spark):
    rows = spark.createDataFrame([(10.0, 8.0), (0.0, 1.0), (5.0, 5.0)], "actual double, forecast double")
    e = evaluate.error_metrics(rows, "forecast").first()
    assert (e.mae, e.rmse, e.wape) == pytest.approx((1, (5 / 3) ** 0.5, 0.2))
    days = spark.createDataFrame([("p", D(2026, 1, 1) + T(days=i), 10.0, 14.0, 11.0 + i % 2 * 0.5) for i in range(20)], "period string, hour timestamp_ntz, actual double, baseline double, forecast double")
    one, two = (evaluate.day_bootstrap(days, n_boot=100).first() for _ in range(2))
    assert one == two and one.n_days == 20 and one.ci95_low <= one.mae_diff <= one.ci95_high < 0


def test_interval_match(spark):
    t = D(2026, 6, 10, 12)
    s = lambda x: T(seconds=x)
    left = [(1, t, t + s(600), 1, "a"), (2, t, t + s(600), 2, "a"), (3, t, t + s(600), 3, None), (4, t, t + s(600), 4, "b"), (5, t, t + s(600), None, "b"), (6, t, t + s(600), 6, "b"), (7, D(2026, 6, 10), D(2026, 6, 10, 0, 10), 7, "b")]
    right = [(1, t + s(120), t + s(720)), (2, t + s(120.5), t + s(600)), (3, t, t + s(900)), (5, t, t + s(600)), (None, t, t + s(600)), (6, t + s(1), t + s(601)), (6, t - s(5), t + s(595)), (7, D(2026, 6, 9, 23, 59), D(2026, 6, 10, 0, 9))]
    a = spark.createDataFrame(left, "id long, pickup timestamp_ntz, dropoff timestamp_ntz, zone int, grp string")
    b = spark.createDataFrame(right, "zone int, pickup timestamp_ntz, dropoff timestamp_ntz")
    b = matching.within(b, ntz("2026-06-10"), ntz("2026-06-11"), seconds=120)
    for f in (matching.matched_plain, matching.matched):
        assert sorted(r.id for r in f(a, b, ["zone"], 120).collect()) == [1, 6, 7]
    rates = matching.match_rate(a, matching.matched(a, b, ["zone"], 120), "grp")
    assert {(r.group, r.trips, r.matched) for r in rates.collect()} == {("a", 2, 1), ("b", 4, 2), ("null", 1, 0)}
    ci = {r.group: r for r in matching.match_rate_ci(rates, ("a", "b"), n=200).collect()}
    assert ci["a - b"].rate == 0 and ci["a"].low <= 0.5 <= ci["a"].high


def test_match_rate_draws_are_binomial(spark):
    """Against the binomial distribution itself: its chances, and the ends of many draws; groups without a choice stay where they are."""
    rates = spark.createDataFrame([("a", 10, 3), ("b", 40_000_000, 9_000_000), ("none", 7, 0), ("all", 7, 7), ("one", 1, 1)], "group string, trips long, matched long")
    rates = rates.withColumn("rate", F.col("matched") / F.col("trips"))
    chance = {r.k: r.v for r in matching._outcomes(rates).where("group = 'a'").collect()}
    exact = [math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(11)]
    assert sorted(chance) == list(range(11)) and all(abs(chance[k] - sum(exact[: k + 1])) < 1e-12 for k in range(11))
    ci = {r.group: r for r in matching.match_rate_ci(rates, ("a", "b"), n=2000).collect()}
    spread = 1.96 * math.sqrt(0.225 * 0.775 / 40_000_000)
    assert abs(ci["b"].low - (0.225 - spread)) < spread / 5 and abs(ci["b"].high - (0.225 + spread)) < spread / 5
    assert [(ci[g].low, ci[g].high) for g in ("none", "all", "one")] == [(0, 0), (1, 1), (1, 1)]
    assert (ci["a"].low, ci["a"].high) == (0.0, 0.6) and matching.match_rate_ci(rates.limit(0), ("a", "b")).where("rate IS NOT NULL").count() == 0


def payload(start, n):
    time = [(start + i * HOUR).strftime("%Y-%m-%dT%H:%M") for i in range(n)]
    return json.dumps({"hourly": {"time": time, "temperature_2m": [float(i) for i in range(n)], "precipitation": [0.1] * n}})


@pytest.mark.parametrize("day,hours,want", [(D(2026, 1, 15), 4, [5, 6, 7, 8]), (D(2026, 7, 15), 4, [4, 5, 6, 7]), (D(2025, 11, 2), 4, [4, 5, 7, 8]), (D(2026, 3, 8), 5, [5, 6, 6, 7, 8])])
def test_weather_at_local_hours(spark, tmp_path, day, hours, want):
    seen = io.explode_weather(spark.createDataFrame([("s", payload(day, 48))], "station string, payload string"))
    wanted = spark.createDataFrame([("s", day + i * HOUR) for i in range(hours)], "station string, hour timestamp_ntz")
    got = features.weather_local_hourly(seen, wanted).orderBy("hour")
    assert [r.temperature_2m for r in got.collect()] == want
    io.write_weather(got.select("hour", "temperature_2m", "precipitation"), str(tmp_path / "w"))
    assert io.read_weather(spark, str(tmp_path / "w")).count() == hours
    with pytest.raises(ValueError):
        io.write_weather(got.select("hour", F.lit(None).cast("double").alias("temperature_2m"), "precipitation"), str(tmp_path / "x"))


def test_scored_sink(spark, tmp_path):
    zones = spark.createDataFrame([(1, "Manhattan"), (2, "Queens")], "zone_id int, borough string")
    rows = evaluate.scored(backtest(spark).withColumn("borough", F.lit("?")), "actual", "baseline", "forecast")
    io.write_scored(rows, str(tmp_path / "s"))
    back = io.read_scored(spark, str(tmp_path / "s"), zones)
    assert back.count() == 96 and {r.borough for r in back.select("borough").distinct().collect()} == {"Manhattan", "Queens"}
    periods = evaluate.evaluate_periods(back.withColumn("period", F.lit("p")))
    assert json.loads(io.metrics_json(p=periods))["p"][0]["mae_forecast"] == 2.5
    boroughs = evaluate.borough_metrics(back.withColumn("period", F.lit("p")))
    io.write_table_csv(boroughs, str(tmp_path / "b"))
    again = io.read_table_csv(spark, str(tmp_path / "b"), boroughs.schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, boroughs.collect())) and again.dtypes == boroughs.dtypes
    with pytest.raises(Exception, match="stands twice"):
        io.with_boroughs(back, zones.unionByName(zones.limit(1))).collect()


@pytest.mark.parametrize("hours", [168, 200, 720])
def test_lags_by_slice_equal_lags(spark, hours):
    rows = demand(spark, grid(900, (1, 2, 3), D(2025, 12, 17, 5)))
    one, two = features.lags(rows), features.lags_by_slice(rows, hours=hours)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    with pytest.raises(ValueError):
        features.lags_by_slice(rows, hours=100)


@pytest.mark.parametrize(("a", "z"), [(500, 501), (300, 700), (663, 664), (672, 673), (1, 2), (880, 881)])
def test_lags_by_slice_watch_the_grid_over_borders(spark, a, z):
    rows = [r for r in grid(900, (1,), D(2026, 1, 1)) if not a <= (r[0] - D(2026, 1, 1)) // HOUR < z]
    with pytest.raises(Exception, match="without a gap"):
        features.lags_by_slice(demand(spark, rows + grid(900, (2,), D(2026, 1, 1))), hours=168).collect()


@pytest.mark.parametrize("few", [0, 2, 64])
def test_match_by_cells_equals_all_pairs(spark, monkeypatch, few):
    """Whole and half seconds, points on the edges of cells, nulls, a key that most rows have."""
    def side(n, seed, span, step):
        r = random.Random(seed)
        at = lambda k: r.randrange(int(k / step)) * step
        some = lambda x: x if r.random() > 0.03 else None
        rows = [(i, some(p := D(2026, 3, 8) + T(seconds=at(span))), some(p + T(seconds=at(900))), r.choice([1, 1, 1, 2, None]), r.choice([7, 7, 8, None])) for i in range(n)]
        return spark.createDataFrame(rows, "id long, pickup timestamp_ntz, dropoff timestamp_ntz, pu int, do int")

    monkeypatch.setattr(matching, "FEW", few)
    total = 0
    for seconds, span, step in ((120, 6000, 1), (60, 1200, 30), (120, 3000, 0.5), (0, 600, 30), (7, 900, 0.25)):
        left, right = side(500, seconds, span, step), side(250, span, span, step)
        want = sorted(r.id for r in matching.matched_plain(left, right, ["pu", "do"], seconds).collect())
        assert sorted(r.id for r in matching.matched(left, right, ["pu", "do"], seconds).collect()) == want
        total += len(want)
    assert total > 100
    assert matching.matched(left, right.where("false"), ["pu", "do"], 60).collect() == [] and matching.matched(left.where("false"), right, ["pu"], 60).collect() == []


def test_match_of_a_hot_key_is_linear(spark):
    """Most rows in one cell: no join makes more rows than the two sides have, but for summaries."""
    at = lambda k: f"timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * {k}) % 119)"
    rows = spark.range(60_000).selectExpr("id", f"{at(7919)} AS pickup", f"{at(104729)} AS dropoff", "1 AS pu", "2 AS do")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would meet in one task again
    try:
        found = matching.matched(rows, rows, ["pu", "do"], 120)
        parts = found.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.sum() == 60_000 and len(parts) > 1 and parts.max() < 45_000


def test_audit_sees_what_was_changed(spark):
    one = features.build_features(demand(spark, grid()))
    columns = ["lag_1", "roll_mean_24"]
    assert tuple(features.audit(one, one, columns).first()) == (0, 0, 0)
    at = F.col("hour") == F.lit(D(2026, 1, 5)).cast("timestamp_ntz")
    two = one.withColumn("lag_1", F.when(at & (F.col("zone_id") == 1), F.col("lag_1") + 4).otherwise(F.col("lag_1"))).where(~at | (F.col("zone_id") == 1))
    assert tuple(features.audit(one, two, columns).first()) == (1, 4, 0)


def test_model_protocol(spark):
    r = random.Random(1)
    rows = [(D(2026, 1, 1) + i * HOUR, z, "B", max(0, round(level * (1 + 0.5 * ((i % 24) in range(8, 20))) + r.gauss(0, level**0.5)))) for z, level in ((1, 80), (2, 20), (3, 3)) for i in range(24 * 28)]
    rows = features.build_features(demand(spark, rows))
    bounds = [("train", ntz("2026-01-08"), ntz("2026-01-20")), ("validation", ntz("2026-01-20"), ntz("2026-01-24")), ("test", ntz("2026-01-24"), ntz("2026-01-29"))]
    split = features.chrono_split(rows, bounds)
    features.check_order(split, ["train", "validation", "test"])
    train, validation, test = (split.where(F.col("split") == n) for n, *_ in bounds)
    assert train.count() == 3 * 12 * 24
    names = (*model.CALENDAR, *model.HISTORY)
    found = model.search(train, validation, names, ({"maxDepth": 2}, {"maxDepth": 2, "loss": "poisson"}), rounds=3)
    assert [x["mae"] for x in found] == sorted(x["mae"] for x in found) and len(found) == 2
    out = model.backtest(train.unionByName(validation), test, names, {"maxDepth": 3}, 5)
    assert out.count() == test.count() and out.where("forecast < 0").isEmpty()
    scored = evaluate.scored(out, "trips_total", "lag_168", "forecast").withColumn("period", F.lit("t"))
    assert evaluate.evaluate_periods(scored).first()["n_rows"] == 3 * 5 * 24
