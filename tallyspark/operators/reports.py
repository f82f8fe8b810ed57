"""Reports over the mart: mart(hour, zone_id, borough, trips_total, trips_<service>...).

`names` are the services in report order. Every function takes rows of any size and aggregates before it does
anything in order; windows without a partition see at most a row per day, month or service.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.functions.time import days_between, month_label

WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
REASONS = ["rows_outside_month", "rows_zone_null", "rows_zone_unknown", "rows_zone_out_of_range"]


def trip_columns(names: list[str]) -> list[str]:
    return ["trips_total", *(f"trips_{s}" for s in names)]


def _sums(columns: list[str]) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in columns]


def _position(names: list[str], column: str = "service") -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col(column))


def overview_kpis(mart: DataFrame) -> DataFrame:
    return mart.agg(F.sum("trips_total").cast("long").alias("total_trips"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.countDistinct("zone_id").alias("n_zones"))


def daily_totals(mart: DataFrame, names: list[str]) -> DataFrame:
    """(date, sums): every day between the first and the last, days without rows as 0."""
    columns = trip_columns(names)
    daily = mart.groupBy(F.to_date("hour").alias("date")).agg(*_sums(columns))
    days = days_between(daily.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    return days.join(daily, "date", "left").select("date", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def daily_by_service(mart: DataFrame, names: list[str]) -> DataFrame:
    long = daily_totals(mart, names).drop("trips_total").unpivot(["date"], [f"trips_{s}" for s in names], "service", "trips")
    return long.withColumn("service", F.regexp_replace("service", "^trips_", ""))


def service_share(mart: DataFrame, names: list[str]) -> DataFrame:
    """(service, trips, share_pct) in the order of names; shares of nothing are 0."""
    long = mart.agg(*(F.sum(f"trips_{s}").cast("long").alias(s) for s in names)).unpivot([], names, "service", "trips")
    total = F.sum("trips").over(W.partitionBy())  # a row per service
    share = F.coalesce(F.try_divide(100.0 * F.col("trips"), total), F.lit(0.0))
    return long.withColumn("share_pct", share).orderBy(_position(names))


def hourly_profile(mart: DataFrame) -> DataFrame:
    hourly = mart.groupBy("hour").agg(F.sum("trips_total").alias("t"))
    kind = F.when(F.weekday("hour") >= 5, "Weekend").otherwise("Weekday")
    return hourly.groupBy(kind.alias("day_type"), F.hour("hour").alias("hour_of_day")).agg(F.avg("t").alias("trips_per_hour"))


def zone_totals(mart: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, trips_total, avg_trips_per_hour, zone, borough): the mean is over all hours of the mart."""
    hours = mart.agg(F.countDistinct("hour").alias("n_hours"))  # one row
    totals = mart.groupBy("zone_id").agg(F.sum("trips_total").cast("long").alias("trips_total"))
    out = totals.crossJoin(F.broadcast(hours)).withColumn("avg_trips_per_hour", F.col("trips_total") / F.col("n_hours")).drop("n_hours")
    return out.join(F.broadcast(zones.select("zone_id", "zone", "borough")), "zone_id", "left")


def log_volume(totals: DataFrame) -> DataFrame:
    return totals.select("zone_id", F.log10(F.greatest("avg_trips_per_hour", F.lit(1.0))).alias("log10_trips"))


def top_zones(totals: DataFrame, n: int = 15) -> DataFrame:
    return totals.orderBy(F.desc("trips_total"), "zone_id").limit(n)


def zone_labels(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", F.format_string("%s, %s [%d]", "zone", "borough", "zone_id").alias("label"))


def source_vs_mart(entries: DataFrame, services: list[str]) -> DataFrame:
    """Row account per service and for all, with the part in the mart in %."""
    counts = ["rows_read", *REASONS, "rows_in_mart"]
    rows = entries.where(F.col("service").isin(services)).rollup("service").agg(*_sums(counts), F.grouping("service").alias("g"))
    out = rows.withColumn("service", F.when(F.col("g") == 1, "all").otherwise(F.col("service"))).withColumn("pct_in_mart", F.try_divide(100.0 * F.col("rows_in_mart"), F.col("rows_read")))
    return out.orderBy("g", _position(services)).drop("g")


def largest_gap(account: DataFrame, services: list[str]) -> DataFrame:
    """(service, reason, rows) that drops most; ties go to the earlier service, then reason."""
    long = account.where("service <> 'all'").unpivot(["service"], REASONS, "reason", "rows")
    return long.orderBy(F.desc("rows"), _position(services), _position(REASONS, "reason")).limit(1)


def null_zone_share(entries: DataFrame, service: str) -> DataFrame:
    return entries.where(F.col("service") == service).select("month", F.try_divide(100.0 * F.col("rows_zone_null"), F.col("rows_read")).alias("pct_zone_null"))


def null_zone_summary(shares: DataFrame) -> DataFrame:
    """One row: lowest and highest share, the two worst months, the median of the others (a row a month in one window)."""
    n = F.row_number().over(W.partitionBy().orderBy(F.desc("pct_zone_null"), "month"))
    rows = shares.withColumn("n", n)
    pick = lambda k: F.max(F.when(F.col("n") == k, F.col("month")))
    return rows.agg(F.min("pct_zone_null").alias("lowest"), F.max("pct_zone_null").alias("highest"), pick(1).alias("worst_month"), pick(2).alias("second_month"), F.median(F.when(F.col("n") > 2, F.col("pct_zone_null"))).alias("median_rest"))


def borough_hourly(mart: DataFrame, names: list[str]) -> DataFrame:
    return mart.groupBy("borough", "hour").agg(*_sums(trip_columns(names)))


def weekday_heatmap(mart: DataFrame, column: str = "trips_total") -> DataFrame:
    """(weekday, h00..h23): mean per hour; all seven days, null where there is nothing."""
    hourly = mart.groupBy("hour").agg(F.sum(column).alias("t")).select(F.weekday("hour").alias("d"), F.hour("hour").alias("h"), "t")
    table = hourly.groupBy("d").pivot("h", list(range(24))).agg(F.avg("t"))
    days = mart.sparkSession.range(7).select(F.col("id").cast("int").alias("d"))
    names = F.array(*map(F.lit, WEEKDAYS))
    return days.join(table, "d", "left").orderBy("d").select(F.element_at(names, F.col("d") + 1).alias("weekday"), *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24)))


def monthly_trend(mart: DataFrame, by: str | None = None) -> DataFrame:
    """(month, [by], trips_per_day): days are counted over all rows, not per group."""
    rows = mart.withColumn("month", month_label(F.col("hour")))
    days = rows.groupBy("month").agg(F.countDistinct(F.to_date("hour")).alias("n_days"))
    keys = ["month", *([by] if by else [])]
    totals = rows.groupBy(*keys).agg(F.sum("trips_total").alias("t"))
    return totals.join(days, "month").select(*keys, (F.col("t") / F.col("n_days")).alias("trips_per_day"))


def month_over_month(trend: DataFrame, by: str) -> DataFrame:
    """(month, by, change_pct) for every month and group of the trend; null where one of the two months has no value."""
    frame = trend.select("month").distinct().crossJoin(trend.select(by).distinct())  # months x groups of a report
    rows = frame.join(trend, ["month", by], "left")
    before = F.lag("trips_per_day").over(W.partitionBy(by).orderBy("month"))
    return rows.select("month", by, (100 * (F.try_divide("trips_per_day", before) - 1)).alias("change_pct"))


def month_to_month(mart: DataFrame) -> DataFrame:
    """(month, trips, previous, change_pct) against the calendar month before, null if it has no rows."""
    months = mart.groupBy(month_label(F.col("hour")).alias("month")).agg(F.sum("trips_total").cast("long").alias("trips"))
    after = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")
    before = months.select(after.alias("month"), F.col("trips").alias("previous"))
    return months.join(before, "month", "left").withColumn("change_pct", F.try_divide(100.0 * (F.col("trips") - F.col("previous")), "previous"))


def service_mix(mart: DataFrame, names: list[str]) -> DataFrame:
    """(borough, service, trips, share_pct): shares within a borough, null without trips."""
    long = mart.groupBy("borough").agg(*(F.sum(f"trips_{s}").cast("long").alias(s) for s in names)).unpivot(["borough"], names, "service", "trips")
    total = F.nullif(F.sum("trips").over(W.partitionBy("borough")), F.lit(0))
    return long.withColumn("share_pct", 100.0 * F.col("trips") / total)


def zone_kpis(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """Total, mean per hour, the busiest hour of the day (the earlier on ties) and its mean."""
    hourly = rows.groupBy(*by, F.hour("hour").alias("h")).agg(F.avg("trips_total").alias("a"), F.sum("trips_total").alias("t"), F.count("trips_total").alias("n"))
    out = hourly.groupBy(*by).agg(F.sum("t").cast("long").alias("total_trips"), (F.sum("t") / F.sum("n")).alias("avg_trips_per_hour"), F.max_by("h", F.struct("a", -F.col("h"))).alias("peak_hour_of_day"), F.max("a").alias("peak_hour_avg_trips"))
    return out


def unusual_days(daily: DataFrame, names: list[str], low: float = 0.6, high: float = 1.4, weeks: int = 4, least: int = 4) -> DataFrame:
    """Days below low or above high times the median of the same weekday in the weeks before and after.

    daily: a row per day, without gaps. The join goes by date, a row per day and neighbour, so it spreads over tasks.
    """
    columns = trip_columns(names)
    offsets = F.explode(F.array(*(F.lit(7 * k) for k in range(-weeks, weeks + 1) if k)))
    near = daily.withColumn("off", offsets).select(F.date_add("date", F.col("off")).alias("date"), *(F.col(c).cast("double").alias(f"n_{c}") for c in columns))
    normal = near.groupBy("date").agg(F.count("n_trips_total").alias("n"), *(F.nullif(F.median(f"n_{c}"), F.lit(0.0)).alias(f"m_{c}") for c in columns))
    rows = daily.join(normal, "date").where(F.col("n") >= least)
    ratio = lambda c: F.col(c) / F.col(f"m_{c}")
    flagged = rows.where((ratio("trips_total") < low) | (ratio("trips_total") > high))
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("date") + 1)
    return flagged.select("date", day.alias("weekday"), "trips_total", (100 * ratio("trips_total")).alias("pct_of_normal"), *((100 * ratio(f"trips_{s}")).alias(f"pct_{s}") for s in names))


def unusual_days_report(days: DataFrame) -> DataFrame:
    """In order of date, dates as text, percentages to one decimal (half to even)."""
    pct = [c for c in days.columns if c.startswith("pct_")]
    return days.orderBy("date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "weekday", "trips_total", *(F.bround(c, 1).alias(c) for c in pct))


def volume_rank(mart: DataFrame, by: str) -> DataFrame:
    return mart.groupBy(by).agg(F.sum("trips_total").cast("long").alias("trips_total")).orderBy(F.desc("trips_total"), by)


def bi_measures(long: DataFrame) -> DataFrame:
    """Per service of long(hour, zone_id, service, trips): total, share of all, mean per zone and hour."""
    rows = long.groupBy("service").agg(F.sum("trips").cast("long").alias("trips"), F.countDistinct("zone_id").alias("z"), F.countDistinct("hour").alias("h"))
    total = F.sum("trips").over(W.partitionBy())  # a row per service
    return rows.select("service", "trips", F.try_divide(100.0 * F.col("trips"), total).alias("share_pct"), (F.col("trips") / (F.col("z") * F.col("h"))).alias("avg_per_zone_hour"))


def borough_month_matrix(mart: DataFrame, months: list[str]) -> DataFrame:
    return mart.withColumn("month", month_label(F.col("hour"))).groupBy("borough").pivot("month", months).agg(F.sum("trips_total").cast("long"))


def wide(long: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    """One row per index, one column per listed value."""
    return long.groupBy(index).pivot(column, values).agg(F.first(value))


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Every date of bounds(first, last) with year-month, weekday name and weekend flag."""
    return days_between(bounds).select("date", F.date_format("date", "yyyy-MM").alias("year_month"), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("date") + 1).alias("weekday"), (F.weekday("date") >= 5).alias("is_weekend"))


def slice_zone(mart: DataFrame, zone: int) -> DataFrame:
    return mart.where(F.col("zone_id") == zone).drop("borough")


def slice_heatmap(mart: DataFrame, borough: str | None = None, service: str | None = None) -> DataFrame:
    """(hour, trips) of a borough and a service, of all where not given."""
    rows = mart if borough is None else mart.where(F.col("borough") == borough)
    return rows.groupBy("hour").agg(F.sum(f"trips_{service or 'total'}").cast("long").alias("trips"))


def dimension_check(one: DataFrame, two: DataFrame) -> DataFrame:
    """(zone_id, problem) where two zone tables differ: missing, extra, or another name."""
    a, b = one.alias("a"), two.alias("b")
    both = a.join(b, F.col("a.zone_id") == F.col("b.zone_id"), "full_outer")
    problem = F.when(F.col("b.zone_id").isNull(), "missing").when(F.col("a.zone_id").isNull(), "extra").when(~F.col("a.zone").eqNullSafe(F.col("b.zone")), "name")
    return both.select(F.coalesce("a.zone_id", "b.zone_id").alias("zone_id"), problem.alias("problem")).where("problem IS NOT NULL")
