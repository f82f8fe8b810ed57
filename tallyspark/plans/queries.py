"""One query per operator of the demand pipeline, bound to the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import time
from tallyspark.functions.time import ntz
from tallyspark.operators import evaluate, features, matching, model, partials, reports
from tallyspark.operators import mart as marts
from tallyspark.plans import bindings as b
from tallyspark.sources import io
from tallyspark.sources.files import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TRIPS = reports.trip_columns(b.SERVICES)


def query(f: Query) -> Query:
    """Registers a query by its name; doubles are rounded to 6 places, so that engines that sum in other orders agree."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def _span(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min(F.to_date("hour")).alias("first"), F.max(F.to_date("hour")).alias("last"))


# Sources and dimensions


@query
def trip_scan(s, d):
    return b.trips(s, d).select("service", "pickup", "zone")


@query
def trip_files(s, d):
    """Trips read back from a file for each service and part of the month; zones are stored as whole numbers in some of them."""
    path, rows = scratch_path(s), b.trips(s, d)
    for kind, some in (("int", "month IN ('W1', 'W4')"), ("double", "month NOT IN ('W1', 'W4')")):
        rows.where(some).withColumn("zone", F.col("zone").cast(kind)).write.mode("append").partitionBy("service", "month").parquet(path)
    months = [r["month"] for r in rows.select("month").distinct().orderBy("month").collect()]  # five at most
    found = [x for x in b.SERVICES if not rows.where((F.col("service") == x)).isEmpty()]
    return io.scan_trips(s, {x: ("pickup", "zone") for x in found}, months, path + "/service={service}/month={month}")


@query
def dim_zone(s, d):
    return b.zones(s, d)


@query
def dim_service(s, d):
    seen = b.trips(s, d).select("service").distinct()
    return b.services(s, d).join(seen, "service", "left_semi").select("service_id", "service")


@query
def dim_hour(s, d):
    """Every hour of the years that events fall in."""
    y = b.table(s, d, "events").agg(F.min(F.year("ts")).alias("a"), F.max(F.year("ts")).alias("z"))
    bounds = y.select(F.make_date("a", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("start"), F.make_date(F.col("z") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("end"))
    return time.calendar(time.hours_between(bounds))


@query
def read_mart(s, d):
    path = scratch_path(s)
    io.write_months(b.demand(s, d), path)
    return io.read_months(s, path, ["hour", "zone_id", "borough", "trips_total"])


@query
def read_mart_wide(s, d):
    path = scratch_path(s)
    io.write_months(b.demand(s, d).drop("borough"), path)
    return io.with_boroughs(io.read_months(s, path), b.zones(s, d))


@query
def fact_pickups_hourly(s, d):
    return b.facts(s, d)


@query
def months_to_build(s, d):
    wanted = b.table(s, d, "orders").select(time.month_label(F.col("o_orderdate")).alias("month")).distinct()
    return io.months_to_build(wanted, wanted.where("month < '2001-01'"))


@query
def quality_upsert(s, d):
    rows = b.entries(s, d)
    old = rows.where("month <= 'W2'").withColumn("rows_read", F.col("rows_read") * 10).withColumn("seconds", F.lit(1.5))
    return io.upsert_entries(old, rows.where("month BETWEEN 'W2' AND 'W3'"), b.SERVICES)


@query
def quality_newest(s, d):
    """The same by builds that append: the newest entry of each service and month."""
    path, rows = scratch_path(s), b.entries(s, d)
    io.append_entries(rows.where("month <= 'W2'").withColumn("rows_read", F.col("rows_read") * 10), path, build=1)
    io.append_entries(rows.where("month BETWEEN 'W2' AND 'W3'"), path, build=2)
    return io.newest_entries(s, path, b.SERVICES)


@query
def weather_explode(s, d):
    return io.explode_weather(b.payloads(s, d))


@query
def weather_gaps(s, d):
    grid = b.hours(s).crossJoin(b.observed(s, d).select("station").distinct())
    return io.weather_gaps(grid.join(b.observed(s, d).withColumnRenamed("time", "hour"), ["station", "hour"], "left"))


@query
def weather_local_hourly(s, d):
    grid = b.hours(s).crossJoin(b.observed(s, d).select("station").distinct())
    return features.weather_local_hourly(io.explode_weather(b.payloads(s, d)), grid)


@query
def read_backtest(s, d):
    path = scratch_path(s)
    io.write_scored(b.scored(s, d), path)
    return io.read_scored(s, path, b.zones(s, d)).withColumn("zone_id", F.col("zone_id").cast("int"))


@query
def mart_unpivot(s, d):
    return marts.unpivot(b.demand(s, d), b.SERVICES)


@query
def dim_date(s, d):
    return reports.date_dimension(_span(b.orders_mart(s, d)))


@query
def daily_by_service(s, d):
    return reports.daily_by_service(b.orders_mart(s, d), b.PRIORITIES)


# The mart


@query
def month_raw(s, d):
    return b.raw(s, d)


@query
def quality_month(s, d):
    return marts.quality(b.raw(s, d), b.RANGES)


@query
def mart_demand_hourly(s, d):
    return b.demand(s, d)


@query
def month_bounds(s, d):
    return time.month_bounds(b.table(s, d, "orders").select(time.month_label(F.col("o_orderdate")).alias("month")).distinct())


@query
def month_weeks(s, d):
    return time.month_weeks(b.table(s, d, "orders").select(time.month_label(F.col("o_orderdate")).alias("month")).distinct())


@query
def partition_compare(s, d):
    one = b.demand(s, d)
    return marts.compare(one, one.where("zone_id <> 7"), TRIPS)


@query
def dim_consistency(s, d):
    one = b.zones(s, d)
    two = one.where("zone_id <> 3").withColumn("zone", F.when(F.col("zone_id") == 5, "ELSEWHERE").otherwise(F.col("zone")))
    extra = two.where("zone_id = 1").withColumn("zone_id", F.lit(99))
    return reports.dimension_check(one, two.unionByName(extra))


# Features


@query
def build_features(s, d):
    return b.feature_rows(s, d)


@query
def build_features_sliced(s, d):
    """The same by slices of a week with the week before as halo."""
    return features.build_features(b.demand(s, d).select("hour", "zone_id", "borough", "trips_total"), slice_hours=168)


@query
def build_features_month(s, d):
    """Features of the newest month of a mart kept by months: its own files and the week before are read."""
    path = scratch_path(s)
    io.write_months(b.demand(s, d, b.EARLIER), path)
    return features.build_month_features(s, path, "2024-01")


@query
def join_many_to_one(s, d):
    return features.join_many_to_one(b.facts(s, d), b.zones(s, d), ["zone_id"])


@query
def feature_audit(s, d):
    """Features against the same computed by joins on the hours before."""
    rows = b.demand(s, d).select("hour", "zone_id", "borough", "trips_total")
    at = lambda k: rows.select("zone_id", (F.col("hour") + F.expr(f"interval {k} hours")).alias("hour"), F.col("trips_total").alias(f"lag_{k}"))
    day = rows.select("zone_id", F.explode(F.expr("sequence(hour + interval 1 hour, hour + interval 24 hours, interval 1 hour)")).alias("hour"), "trips_total")
    mean = day.groupBy("zone_id", "hour").agg(F.when(F.count("*") == 24, F.avg("trips_total")).alias("roll_mean_24"))
    other = rows.select("zone_id", "hour")
    for part in (at(1), at(24), at(168), mean):
        other = other.join(part, ["zone_id", "hour"], "left")
    return features.audit(features.build_features(rows), other, ["lag_1", "lag_24", "lag_168", "roll_mean_24"])


@query
def feature_audit_changed(s, d):
    """Features against those of demand with one hour of one zone changed."""
    rows = b.demand(s, d).select("hour", "zone_id", "borough", "trips_total")
    here = (F.col("zone_id") == 3) & (F.col("hour") == ntz("2024-01-10 05:00:00"))
    changed = features.build_features(rows.withColumn("trips_total", F.when(here, F.col("trips_total") + 5).otherwise(F.col("trips_total"))))
    return features.audit(b.feature_rows(s, d), changed, ["lag_1", "lag_24", "lag_168", "roll_mean_24"])


@query
def grid_violations(s, d):
    return features.grid_violations(b.demand(s, d).where("NOT (zone_id = 2 AND hour(hour) = 5)"))


def _split(s, d):
    return features.chrono_split(b.feature_rows(s, d), [("train", ntz("2024-01-10"), ntz("2024-01-18")), ("validation", ntz("2024-01-18"), ntz("2024-01-21")), ("test", ntz("2024-01-21"), ntz(b.END))])


@query
def chrono_split(s, d):
    return _split(s, d).select("hour", "zone_id", "split")


@query
def split_counts(s, d):
    return _split(s, d).groupBy("split").agg(F.count("*").alias("n_rows"))


# Reports


@query
def overview_kpis(s, d):
    return reports.overview_kpis(b.demand(s, d))


@query
def daily_totals(s, d):
    return reports.daily_totals(b.orders_mart(s, d), b.PRIORITIES)


@query
def service_share(s, d):
    return reports.service_share(b.demand(s, d), b.SERVICES)


@query
def hourly_profile(s, d):
    return reports.hourly_profile(b.demand(s, d))


def _totals(s, d):
    return reports.zone_totals(b.demand(s, d), b.zones(s, d))


@query
def zone_totals(s, d):
    return _totals(s, d)


@query
def zone_log_volume(s, d):
    return reports.log_volume(reports.zone_totals(b.orders_mart(s, d), b.zones(s, d)))


@query
def top_zones(s, d):
    return reports.top_zones(_totals(s, d))


@query
def zone_labels(s, d):
    return reports.zone_labels(b.zones(s, d))


@query
def source_vs_mart(s, d):
    return reports.source_vs_mart(b.entries(s, d), b.SERVICES)


@query
def largest_gap(s, d):
    return reports.largest_gap(reports.source_vs_mart(b.entries(s, d), b.SERVICES), b.SERVICES)


@query
def null_zone_share(s, d):
    return reports.null_zone_share(b.entries(s, d), "view")


@query
def null_zone_summary(s, d):
    return reports.null_zone_summary(reports.null_zone_share(b.entries(s, d), "view"))


@query
def borough_hourly(s, d):
    return reports.borough_hourly(b.demand(s, d), b.SERVICES)


@query
def weekday_heatmap(s, d):
    return reports.weekday_heatmap(b.demand(s, d))


@query
def monthly_trend(s, d):
    return reports.monthly_trend(b.orders_mart(s, d), "borough")


@query
def monthly_trend_city(s, d):
    return reports.monthly_trend(b.orders_mart(s, d))


@query
def trend_wide(s, d):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return reports.wide(reports.monthly_trend(b.orders_mart(s, d), "borough"), "month", "borough", names, "trips_per_day")


@query
def month_over_month(s, d):
    return reports.month_over_month(reports.monthly_trend(b.orders_mart(s, d), "borough"), "borough")


@query
def bi_mom(s, d):
    return reports.month_to_month(b.orders_mart(s, d).where("hour NOT BETWEEN timestamp_ntz'1997-03-01' AND timestamp_ntz'1997-03-31'"))


@query
def service_mix(s, d):
    return reports.service_mix(b.demand(s, d), b.SERVICES)


@query
def zone_kpis(s, d):
    return reports.zone_kpis(b.demand(s, d), ("zone_id",))


@query
def unusual_days(s, d):
    return reports.unusual_days(reports.daily_totals(b.orders_mart(s, d), b.PRIORITIES), b.PRIORITIES)


@query
def unusual_days_report(s, d):
    days = reports.unusual_days(reports.daily_totals(b.orders_mart(s, d), b.PRIORITIES), b.PRIORITIES)
    return reports.unusual_days_report(days).select("date", "weekday", "trips_total", "pct_of_normal")


@query
def volume_rank(s, d):
    return reports.volume_rank(b.orders_mart(s, d), "borough")


@query
def bi_measures(s, d):
    return reports.bi_measures(marts.unpivot(b.demand(s, d), b.SERVICES).select("hour", "zone_id", "service", "trips"))


@query
def borough_month_matrix(s, d):
    return reports.borough_month_matrix(b.orders_mart(s, d), time.month_range("1998-01", "1998-06"))


@query
def zone_slice(s, d):
    return reports.slice_zone(b.demand(s, d), 4)


@query
def heatmap_slice(s, d):
    return reports.slice_heatmap(b.demand(s, d), "ASIA", "click")


# Reports from sums kept by month


def _kept(s, mart, names):
    path = scratch_path(s)
    partials.keep(mart, path, names)
    return partials.hours(s, path), partials.zones(s, path)


@query
def kept_overview_kpis(s, d):
    return partials.overview_kpis(*_kept(s, b.demand(s, d), b.SERVICES))


@query
def kept_zone_totals(s, d):
    return partials.zone_totals(*_kept(s, b.demand(s, d), b.SERVICES), b.zones(s, d))


@query
def kept_zone_kpis(s, d):
    return partials.zone_kpis(_kept(s, b.demand(s, d), b.SERVICES)[1])


@query
def kept_daily_totals(s, d):
    return reports.daily_totals(_kept(s, b.orders_mart(s, d), b.PRIORITIES)[0], b.PRIORITIES)


@query
def kept_service_mix(s, d):
    return reports.service_mix(_kept(s, b.demand(s, d), b.SERVICES)[0], b.SERVICES)


@query
def kept_weekday_heatmap(s, d):
    return reports.weekday_heatmap(_kept(s, b.demand(s, d), b.SERVICES)[0])


@query
def kept_monthly_trend(s, d):
    return reports.monthly_trend(_kept(s, b.orders_mart(s, d), b.PRIORITIES)[0], "borough")


# Matching


@query
def interval_match(s, d):
    return matching.matched(b.match_side(s, d, "click"), b.match_side(s, d, "view"), ["user_id"], b.TOLERANCE)


@query
def interval_match_zones(s, d):
    """Clicks and views with the same two zones."""
    return matching.matched(b.match_side(s, d, "click"), b.match_side(s, d, "view"), ["pu", "do_zone"], b.TOLERANCE)


@query
def interval_match_window(s, d):
    """Clicks of one week against views of that week widened by the tolerance."""
    a, z = ntz("2024-01-08"), ntz("2024-01-15")
    left, right = matching.within(b.match_side(s, d, "click"), a, z), matching.within(b.match_side(s, d, "view"), a, z, seconds=b.TOLERANCE)
    return matching.matched(left, right, ["user_id"], b.TOLERANCE)


def _rates(s, d):
    left = b.match_side(s, d, "click")
    return matching.match_rate(left, matching.matched(left, b.match_side(s, d, "view"), ["user_id"], b.TOLERANCE), "grp")


@query
def match_rate(s, d):
    return _rates(s, d)


@query
def match_rate_ci(s, d):
    return matching.match_rate_ci(_rates(s, d), ("1", "2"))


# Forecasts


@query
def score_clip(s, d):
    """A forecast that can fall below 0: last hour plus its change."""
    rows = b.feature_rows(s, d).where("lag_2 IS NOT NULL").select("hour", "zone_id", (2 * F.col("lag_1") - F.col("lag_2")).cast("double").alias("forecast"))
    return evaluate.clip(rows, "forecast")


@query
def scored(s, d):
    return b.scored(s, d)


@query
def hour_snapshot(s, d):
    return evaluate.snapshot(b.scored(s, d), ntz("2024-01-16 09:00:00"))


@query
def snapshot_kpis(s, d):
    return evaluate.snapshot_kpis(evaluate.snapshot(b.scored(s, d), ntz("2024-01-16 09:00:00")))


@query
def backtest_series(s, d):
    return evaluate.series(b.scored(s, d), ntz("2024-01-16"), ntz("2024-01-18"))


@query
def month_slice(s, d):
    return evaluate.month_slice(b.scored(s, d), ntz("2024-01-01"), ntz("2024-02-01"), "ASIA")


@query
def mae_by_hour(s, d):
    return evaluate.mae_by_hour(b.scored(s, d))


@query
def zone_errors(s, d):
    return evaluate.zone_errors(b.scored(s, d), 0.15)


@query
def largest_misses(s, d):
    return evaluate.largest_misses(b.scored(s, d))


@query
def error_metrics(s, d):
    return evaluate.error_metrics(b.scored(s, d), "forecast")


@query
def naive_metrics(s, d):
    rows = b.feature_rows(s, d).where("lag_168 IS NOT NULL").withColumn("actual", F.col("trips_total"))
    last, week = (evaluate.error_metrics(rows, c).withColumn("reference", F.lit(c)) for c in ("lag_1", "lag_168"))
    return last.unionByName(week)


@query
def evaluate_periods(s, d):
    return evaluate.evaluate_periods(b.periods(b.scored(s, d)))


@query
def borough_metrics(s, d):
    return evaluate.borough_metrics(b.periods(b.scored(s, d)))


@query
def day_bootstrap(s, d):
    return evaluate.day_bootstrap(b.periods(b.scored(s, d)), n_boot=200)


@query
def accuracy_report(s, d):
    rows = b.periods(b.scored(s, d))
    return evaluate.accuracy_report(evaluate.evaluate_periods(rows), evaluate.day_bootstrap(rows, n_boot=200))


# Models. Boosting stops by itself, so the whole grid and the default rounds are run.

ALL = (*model.CALENDAR, *model.HISTORY)


def _parts(s, d):
    rows = _split(s, d)
    return [rows.where(F.col("split") == x) for x in ("train", "validation", "test")]


@query
def train_demand_model(s, d):
    """Forecasts of the test rows by an ensemble that stops by its validation error."""
    train, validation, test = _parts(s, d)
    found, _, _ = model.fit_stopping(train, validation, ALL, model.GRID[0])
    return evaluate.clip(found.transform(test), "forecast").select("hour", "zone_id", "trips_total", "forecast")


@query
def param_search(s, d):
    train, validation, _ = _parts(s, d)
    found = model.search(train, validation, ALL)
    return s.createDataFrame([(str(r["params"]), r["rounds"], r["mae"], r["hit_limit"]) for r in found], "params string, rounds int, mae double, hit_limit boolean")


@query
def feature_ablation(s, d):
    train, validation, _ = _parts(s, d)
    out = model.ablation(train, validation, model.HISTORY, model.CALENDAR, model.GRID[0])
    return s.createDataFrame([(out["mae_without"], out["mae_with"], out["kept"])], "mae_without double, mae_with double, kept boolean")


@query
def backtest_scored(s, d):
    """Test rows scored by the candidate and the rounds that the search finds best, refitted with the validation rows."""
    train, validation, test = _parts(s, d)
    best = model.search(train, validation, ALL)[0]
    rows = model.backtest(train.unionByName(validation), test, ALL, best["params"], best["rounds"])
    return evaluate.scored(rows, "trips_total", "lag_168", "forecast")


@query
def leakage_ablation(s, d):
    """Validation error without the last hours' features."""
    train, validation, _ = _parts(s, d)
    keep = tuple(f for f in ALL if f not in model.RECENT)
    _, rounds, error = model.fit_stopping(train, validation, keep, model.GRID[0])
    return s.createDataFrame([(len(keep), rounds, error)], "n_features int, rounds int, mae double")
