"""Readers and writers: dimensions, weather, scored rows, reports. Trips, tables by months and quality entries have modules of their own."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.entries import ENTRY_COUNTS, append_entries, compact_entries, newest_entries, read_entries, upsert_entries  # noqa: F401
from tallyspark.sources.months import built_months, read_months, replace_months, write_months  # noqa: F401
from tallyspark.sources.trips import scan_trips  # noqa: F401

ZONE_COLUMNS = ("zone_id", "borough", "zone", "service_zone")


def service_dimension(spark: SparkSession, services: list[str]) -> DataFrame:
    """(service_id, service): 1-based positions."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(services, 1)], "service_id byte, service string")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV with a header; all text but the id. "N/A" stays text."""
    schema = T.StructType([T.StructField("zone_id", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ZONE_COLUMNS[1:])])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, nullValue="")


def write_zones(zones: DataFrame, path: str) -> None:
    """Ordered CSV with a header, one file (a few hundred rows)."""
    zones.orderBy("zone_id").coalesce(1).write.mode("overwrite").csv(path, header=True)


def with_boroughs(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Joins borough back by zone_id, many to one (zones is a dimension of a few hundred rows). A zone that stands twice makes the job fail."""
    twice = F.raise_error(F.concat(F.lit("zone stands twice: "), F.col("zone_id").cast("string"))).cast("string")
    one = zones.groupBy("zone_id").agg(F.count("*").alias("n"), F.first("borough").alias("borough")).select("zone_id", F.when(F.col("n") > 1, twice).otherwise(F.col("borough")).alias("borough"))
    return rows.drop("borough").join(F.broadcast(one), "zone_id", "left")


def months_to_build(wanted: DataFrame, built: DataFrame, force: bool = False) -> DataFrame:
    """(month) of wanted that are not built yet; all of them with force."""
    return wanted.select("month") if force else wanted.select("month").join(built.select("month").distinct(), "month", "left_anti")


def explode_weather(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(..., time, temperature_2m, precipitation): parallel arrays of JSON {"hourly": {...}} as rows."""
    kind = "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>>"
    h = F.from_json(column, kind)["hourly"]
    rows = payloads.withColumn("_r", F.explode(F.arrays_zip(h["time"].alias("time"), h["temperature_2m"].alias("t"), h["precipitation"].alias("p"))))
    others = [c for c in payloads.columns if c != column]
    return rows.select(*others, F.col("_r")["time"].cast("timestamp_ntz").alias("time"), F.col("_r")["t"].alias("temperature_2m"), F.col("_r")["p"].alias("precipitation"))


def weather_gaps(hours: DataFrame) -> DataFrame:
    """One row: hours, and hours with any missing value."""
    missing = F.col("temperature_2m").isNull() | F.col("precipitation").isNull()
    return hours.agg(F.count("*").alias("hours"), F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("missing"))


def write_weather(hours: DataFrame, path: str) -> None:
    """CSV of the hours; refuses series with missing values."""
    if (bad := weather_gaps(hours).first()["missing"]) > 0:
        raise ValueError(f"{bad} hours have no value")
    hours.orderBy("hour").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="hour timestamp_ntz, temperature_2m double, precipitation double")


def write_scored(rows: DataFrame, path: str) -> None:
    rows.drop("borough").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_scored(spark: SparkSession, path: str, zones: DataFrame) -> DataFrame:
    return with_boroughs(spark.read.parquet(path), zones)


def write_table_csv(rows: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report written by write_table_csv()."""
    return spark.read.csv(path, header=True, schema=schema)


def metrics_json(**tables: DataFrame) -> str:
    """Report tables of tens of rows as one JSON document."""
    return json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in tables.items()}, default=str, sort_keys=True)
