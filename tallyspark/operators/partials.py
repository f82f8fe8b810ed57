"""Sums of the mart that are kept by month beside it, so that reports don't read the mart again.

Two tables by months: hours(borough, hour, sums), and zones(month, zone_id, hour_of_day, trips, rows). Sums, counts and the sets of hours merge
over months, so each report over any months follows from these rows; a new or rebuilt month replaces its own rows only. Reports that
need hours and boroughs alone take hours as their mart: reports.daily_totals, daily_by_service, service_share, hourly_profile, borough_hourly,
weekday_heatmap, monthly_trend, month_to_month and service_mix. The others are here.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.time import month_label
from tallyspark.operators.reports import trip_columns
from tallyspark.sources.months import read_months, retract, write_months


def hour_sums(mart: DataFrame, names: list[str]) -> DataFrame:
    """(borough, hour, sums)."""
    return mart.groupBy("borough", "hour").agg(*(F.sum(c).cast("long").alias(c) for c in trip_columns(names)))


def zone_sums(mart: DataFrame) -> DataFrame:
    """(month, zone_id, hour_of_day, trips, rows)."""
    return mart.groupBy(month_label(F.col("hour")).alias("month"), "zone_id", F.hour("hour").alias("hour_of_day")).agg(F.sum("trips_total").cast("long").alias("trips"), F.count("trips_total").alias("rows"))


def keep(mart: DataFrame, path: str, names: list[str]) -> list[str]:
    """Writes the sums of the months that mart holds, which replace those kept before; other months stay. Returns the months."""
    write_months(hour_sums(mart, names), f"{path}/hours")
    return write_months(zone_sums(mart), f"{path}/zones", F.col("month"))


def drop(spark: SparkSession, path: str, months: Iterable[str]) -> None:
    """Takes months out that are no longer in the mart."""
    for table in ("hours", "zones"):
        retract(spark, f"{path}/{table}", months)


def hours(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """(borough, hour, sums) of some months or all; only their files are read."""
    return read_months(spark, f"{path}/hours", months=months)


def zones(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> DataFrame:
    """(zone_id, hour_of_day, trips, rows), a row for each month of some months or all."""
    return read_months(spark, f"{path}/zones", months=months)


def overview_kpis(hours: DataFrame, zones: DataFrame) -> DataFrame:
    """reports.overview_kpis() from kept sums."""
    n = zones.agg(F.countDistinct("zone_id").alias("n_zones"))  # a row each
    return hours.agg(F.sum("trips_total").cast("long").alias("total_trips"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour")).crossJoin(n)


def zone_totals(hours: DataFrame, zones: DataFrame, names: DataFrame) -> DataFrame:
    """reports.zone_totals() from kept sums; names(zone_id, zone, borough) is a dimension."""
    n = hours.agg(F.countDistinct("hour").alias("n_hours"))  # one row
    totals = zones.groupBy("zone_id").agg(F.sum("trips").cast("long").alias("trips_total")).crossJoin(F.broadcast(n))
    out = totals.select("zone_id", "trips_total", (F.col("trips_total") / F.col("n_hours")).alias("avg_trips_per_hour"))
    return out.join(F.broadcast(names.select("zone_id", "zone", "borough")), "zone_id", "left")


def zone_kpis(zones: DataFrame) -> DataFrame:
    """reports.zone_kpis() by zone from kept sums."""
    by_hour = zones.groupBy("zone_id", "hour_of_day").agg(F.sum("trips").alias("t"), F.sum("rows").alias("n")).withColumn("a", F.col("t") / F.col("n"))
    return by_hour.groupBy("zone_id").agg(
        F.sum("t").cast("long").alias("total_trips"), (F.sum("t") / F.sum("n")).alias("avg_trips_per_hour"),
        F.max_by("hour_of_day", F.struct("a", -F.col("hour_of_day"))).alias("peak_hour_of_day"), F.max("a").alias("peak_hour_avg_trips"),
    )
