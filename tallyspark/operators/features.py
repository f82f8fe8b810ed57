"""Features of hourly demand: nothing of hour t uses hour t or later, nor another zone."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.time import calendar, ntz
from tallyspark.sources.months import read_months

LAGS, ROLLING = (1, 2, 3, 24, 168), 24
HOUR = "interval 1 hour"
#: Hours that features look back, and hours of a slice.
HALO = max(*LAGS, ROLLING)
SLICE = 720


def _by_zone() -> W:
    return W.partitionBy("zone_id").orderBy("hour")


def grid_violations(demand: DataFrame) -> DataFrame:
    """One row: pairs of neighbouring rows of a zone that aren't one hour apart."""
    step = F.col("hour") - F.lag("hour").over(_by_zone())
    return demand.select((step != F.expr(HOUR)).alias("bad")).agg(F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("violations"))


def check_grid(demand: DataFrame) -> DataFrame:
    """The same rows; raises ValueError if they are no complete hourly grid per zone."""
    if grid_violations(demand).first()["violations"]:
        raise ValueError("a zone's hours don't follow one another without a gap")
    return demand


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; raises ValueError if a key stands twice on the right."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} are not unique on the right")
    return left.join(right, keys, "left")


def _with_lags(rows: DataFrame, w: W, target: str, broken: Column) -> DataFrame:
    """Adds lag_k and roll_mean_24 (null unless all 24 rows exist) over a window. A job fails at a row where broken holds; it is told by the window's own columns."""
    before = w.rowsBetween(-ROLLING, -1)
    out = {f"lag_{k}": F.lag(target, k).over(w) for k in LAGS}
    mean = F.when(F.count(target).over(before) == ROLLING, F.avg(target).over(before))
    stop = F.raise_error(F.lit("a zone's hours don't follow one another without a gap")).cast("boolean")
    watched = rows.withColumns({**out, f"roll_mean_{ROLLING}": mean, "_whole": F.when(broken, stop).otherwise(F.lit(True))})
    return watched.where("_whole").drop("_whole")


def _step(w: W) -> Column:
    """Time since the row before. Both ends come from the window: a later filter on hour must not be put in for the column here."""
    return F.max("hour").over(w.rowsBetween(W.currentRow, W.currentRow)) - F.lag("hour").over(w)


def lags(demand: DataFrame, target: str = "trips_total") -> DataFrame:
    """Adds lag_k and roll_mean_24; one window, so one shuffle by zone.

    Lags go by position, so the same window also watches the grid: a job fails at the first row of a zone that doesn't stand
    one hour behind the row before it.
    """
    w = _by_zone()
    return _with_lags(demand, w, target, _step(w) != F.expr(HOUR))


def lags_by_slice(demand: DataFrame, target: str = "trips_total", hours: int = SLICE) -> DataFrame:
    """The same by slices of so many hours of each zone, so that the number of tasks doesn't end at the number of zones.

    The last HALO hours of a slice are repeated at the head of the next one, for its lags; they cost HALO / hours more rows. The grid is watched over
    the borders too: every row needs one before it in its slice, but for a zone's first hour, which gets a marker row without a value.
    """
    if hours < HALO:
        raise ValueError(f"a slice has {HALO} hours at least")
    since = F.date_diff(F.to_date("hour"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("hour")
    own, place = F.floor(since / hours), F.pmod(since, F.lit(hours))
    slices = F.when(place >= hours - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    rows = demand.select("*", own.alias("_own"), F.explode(slices).alias("_slice")).withColumn("_halo", F.col("_own") != F.col("_slice")).drop("_own")
    first = demand.groupBy("zone_id").agg(F.min("hour").alias("hour"))
    marker = first.select("zone_id", (F.col("hour") - F.expr(HOUR)).alias("hour"), own.alias("_slice"), F.lit(True).alias("_halo"))
    w = W.partitionBy("zone_id", "_slice").orderBy("hour")
    halo = F.max("_halo").over(w.rowsBetween(W.currentRow, W.currentRow))
    out = _with_lags(rows.unionByName(marker, allowMissingColumns=True), w, target, ~halo & F.coalesce(_step(w) != F.expr(HOUR), F.lit(True)))
    return out.where(~F.col("_halo")).drop("_slice", "_halo")


def build_features(demand: DataFrame, weather: DataFrame | None = None, zone: str = "America/New_York", slice_hours: int | None = None) -> DataFrame:
    """Lags, rolling mean, calendar and, if given, weather of demand(hour, zone_id, borough, trips_total).

    demand must be a complete hourly grid per zone; a job over the result fails where it isn't (check_grid tells at once). With slice_hours the windows
    go by slices of that length (lags_by_slice).
    """
    days = calendar(demand.select("hour").distinct(), zone).select("hour", "hour_of_day", "day_of_week", F.col("is_holiday").cast("byte").alias("is_holiday"))
    lagged = lags(demand) if slice_hours is None else lags_by_slice(demand, hours=slice_hours)
    out = lagged.join(days, "hour", "left")  # calendar() gives each hour once
    return out if weather is None else join_many_to_one(out, weather.select("hour", "temperature_2m", "precipitation"), ["hour"])


def build_month_features(spark: SparkSession, path: str, month: str, zone: str = "America/New_York") -> DataFrame:
    """Features of one month of a mart kept by months: only this month and the last HALO hours before it are read."""
    (start, end), earlier = _bounds(month), _month_before(month)
    rows = read_months(spark, path, ["hour", "zone_id", "borough", "trips_total"], {earlier, month})
    near = rows.where((F.col("hour") >= start - F.expr(f"interval {HALO} hours")) & (F.col("hour") < end))
    return build_features(near, zone=zone).where(F.col("hour") >= start)


def _month_before(month: str) -> str:
    year, number = map(int, month.split("-"))
    return f"{year - (number == 1):04d}-{number - 1 or 12:02d}"


def _bounds(month: str) -> tuple[Column, Column]:
    start = ntz(f"{month}-01")
    return start, F.add_months(F.to_date(start), 1).cast("timestamp_ntz")


def audit(features: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Two computations of the same features key by key: keys on one side only, and the largest difference of each column.

    A value that is null on one side only counts as unmatched.
    """
    a, b = features.alias("a"), other.alias("b")
    both = a.join(b, (F.col("a.zone_id") == F.col("b.zone_id")) & (F.col("a.hour") == F.col("b.hour")), "full_outer")
    odd = F.col("a.zone_id").isNull() | F.col("b.zone_id").isNull()
    for c in columns:
        odd = odd | (F.col(f"a.{c}").isNull() != F.col(f"b.{c}").isNull())
    diffs = [F.coalesce(F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))), F.lit(0)).cast("double").alias(f"max_diff_{c}") for c in columns]
    return both.agg(F.coalesce(F.sum(odd.cast("long")), F.lit(0)).alias("unmatched"), *diffs)


def chrono_split(rows: DataFrame, bounds: list[tuple[str, Column, Column]]) -> DataFrame:
    """Adds split: the first name whose [start, end) holds the hour; other rows go."""
    split = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        split = F.when((F.col("hour") >= start) & (F.col("hour") < end), name).otherwise(split)
    return rows.withColumn("split", split).where("split IS NOT NULL")


def check_order(split: DataFrame, names: list[str]) -> None:
    """Raises ValueError unless each split ends before the next begins."""
    ends = {r["split"]: (r["a"], r["z"]) for r in split.groupBy("split").agg(F.min("hour").alias("a"), F.max("hour").alias("z")).collect()}
    if any(ends[x][1] >= ends[y][0] for x, y in zip(names, names[1:]) if x in ends and y in ends):
        raise ValueError("splits overlap in time")


def weather_local_hourly(observed: DataFrame, hours: DataFrame, zone: str = "America/New_York", by: str = "station") -> DataFrame:
    """UTC observations(station, time, temperature_2m, precipitation) at the wanted local hours(station, hour).

    Of two observations of one local hour the first stays; an hour without one, or with nulls, takes the last value before it
    among the wanted hours.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("time"))
    first = F.row_number().over(W.partitionBy(by, local).orderBy("time"))
    seen = observed.withColumn("_n", first).where("_n = 1").select(by, local.alias("hour"), "temperature_2m", "precipitation")
    before = W.partitionBy(by).orderBy("hour").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = hours.join(seen, [by, "hour"], "left")
    return rows.select(by, "hour", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in ("temperature_2m", "precipitation")))
