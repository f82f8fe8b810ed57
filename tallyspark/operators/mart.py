"""From raw trips to the hourly demand mart, with an account of every row."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.time import hour_floor


@dataclass(frozen=True)
class ZoneRanges:
    """Zones with a name, the unknown ones behind them, and the order of all."""

    last_known: int = 263
    last: int = 265

    def known(self, zone: Column) -> Column:
        return zone.between(1, self.last_known)

    def valid(self, zone: Column) -> Column:
        return zone.between(1, self.last)


def zone_number(zone: Column) -> Column:
    """A zone id from text or numbers: rounded half to even; what is no number becomes null."""
    return F.bround(zone.try_cast("double")).try_cast("int")


def month_raw(trips: DataFrame, start: Column, end: Column, by: tuple = ("service",)) -> DataFrame:
    """(*by, in_month, hour, zone_id, trips): one scan of trips(*by, pickup, zone), counted by hour and zone.

    in_month: start <= pickup < end; a null pickup is outside.
    """
    inside = F.coalesce((F.col("pickup") >= start) & (F.col("pickup") < end), F.lit(False))
    return trips.groupBy(*by, inside.alias("in_month"), hour_floor(F.col("pickup")).alias("hour"), zone_number(F.col("zone")).alias("zone_id")).agg(F.count("*").alias("trips"))


def quality(raw: DataFrame, ranges: ZoneRanges, by: tuple = ("service",)) -> DataFrame:
    """Row account: five classes that exclude each other and add up to rows_read."""
    zone, inside = F.col("zone_id"), F.col("in_month")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("trips"))), F.lit(0)).cast("long")
    return raw.groupBy(*by).agg(
        F.coalesce(F.sum("trips"), F.lit(0)).cast("long").alias("rows_read"),
        total(~inside).alias("rows_outside_month"),
        total(inside & zone.isNull()).alias("rows_zone_null"),
        total(inside & ranges.valid(zone) & ~ranges.known(zone)).alias("rows_zone_unknown"),
        total(inside & ~ranges.valid(zone)).alias("rows_zone_out_of_range"),
        total(inside & ranges.known(zone)).alias("rows_in_mart"),
    )


def fact(raw: DataFrame, services: DataFrame, ranges: ZoneRanges) -> DataFrame:
    """(hour, zone_id, service_id, trips) of rows inside the month with a valid zone."""
    rows = raw.where(F.col("in_month") & ranges.valid(F.col("zone_id"))).join(F.broadcast(services), "service")
    return rows.groupBy("hour", "zone_id", "service_id").agg(F.sum("trips").cast("int").alias("trips"))


def demand_mart(facts: DataFrame, services: DataFrame, hours: DataFrame, zones: DataFrame, names: list[str], ranges: ZoneRanges) -> DataFrame:
    """The complete grid of hours and known zones, with trips in total and per service; hours without trips are 0.

    names: the services, a column each. zones and services are dimensions (hundreds of rows) and are broadcast; the grid
    is as large as the mart itself.
    """
    grid = hours.select("hour").crossJoin(F.broadcast(zones.where(ranges.known(F.col("zone_id"))).select("zone_id", "borough")))
    one = lambda s: F.sum(F.when(F.col("service") == s, F.col("trips"))).alias(f"trips_{s}")
    sums = facts.join(F.broadcast(services), "service_id").groupBy("hour", "zone_id").agg(F.sum("trips").alias("trips_total"), *(one(s) for s in names))
    counts = [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("trips_total", *(f"trips_{s}" for s in names))]
    return grid.join(sums, ["hour", "zone_id"], "left").select("hour", "zone_id", "borough", *counts)


def summary(mart: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and sums."""
    return mart.agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))


def compare(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """Two versions of a partition: differences of rows and sums, and whether none differs."""
    names = ["n_rows", *columns]
    both = summary(one, columns).crossJoin(summary(two, columns).select(*(F.col(c).alias(f"{c}_2") for c in names)))  # a row each
    out = both.select(*(F.col(c).alias(f"{c}_1") for c in names), *(f"{c}_2" for c in names), *((F.col(f"{c}_2") - F.col(c)).alias(f"{c}_diff") for c in names))
    same = F.lit(True)
    for c in names:
        same = same & (F.col(f"{c}_diff") == 0)
    return out.withColumn("identical", same)


def unpivot(mart: DataFrame, names: list[str]) -> DataFrame:
    """Long form (date, hour, zone_id, borough, service, trips), without the total."""
    long = mart.unpivot(["hour", "zone_id", "borough"], [f"trips_{s}" for s in names], "service", "trips")
    return long.select(F.to_date("hour").alias("date"), "hour", "zone_id", "borough", F.regexp_replace("service", "^trips_", "").alias("service"), "trips")
