"""The given tables in the roles of the demand pipeline.

Trips are events: pickup = ts, service = event_type, raw zone = user_id % 30 with 27 as null. Zones are nations (1-25), 26-28
stand for unknown ones. The long daily series are orders by day, nation and priority.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.time import hours_between, ntz
from tallyspark.operators import evaluate, features, mart
from tallyspark.sources import io

SERVICES = ["click", "view", "purchase", "signup", "error"]
PRIORITIES = ["urgent", "high", "medium", "not", "low"]
START, END = "2024-01-03", "2024-01-25"
EARLIER = "2023-12-20"
TEST, NEXT = "2024-01-15", "2024-01-20"
RANGES = mart.ZoneRanges(25, 28)
TOLERANCE = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("user_id") % 30 == 27, F.lit(None)).otherwise(F.col("user_id") % 30).cast("double")
    part = F.concat(F.lit("W"), F.floor((F.dayofmonth("ts") - 1) / 7) + 1)
    return table(spark, d, "events").select(F.col("event_type").alias("service"), part.alias("month"), F.col("ts").alias("pickup"), zone.alias("zone"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select((F.col("n_nationkey") + 1).cast("int").alias("zone_id"), F.col("r_name").alias("borough"), F.col("n_name").alias("zone"))


def services(spark: SparkSession, d: str) -> DataFrame:
    return io.service_dimension(spark, SERVICES)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return mart.month_raw(trips(spark, d), ntz(START), ntz(END))


def entries(spark: SparkSession, d: str) -> DataFrame:
    by = ("service", "month")
    return mart.quality(mart.month_raw(trips(spark, d), ntz(START), ntz(END), by), RANGES, by)


def facts(spark: SparkSession, d: str) -> DataFrame:
    return mart.fact(raw(spark, d), services(spark, d), RANGES)


def hours(spark: SparkSession, start: str = START) -> DataFrame:
    return hours_between(spark.range(1).select(ntz(start).alias("start"), ntz(END).alias("end")))


def demand(spark: SparkSession, d: str, start: str = START) -> DataFrame:
    """The mart from some day on; there are no trips before START."""
    return mart.demand_mart(facts(spark, d), services(spark, d), hours(spark, start), zones(spark, d), SERVICES, RANGES)


def orders_mart(spark: SparkSession, d: str) -> DataFrame:
    """(hour, zone_id, borough, trips_total, trips_<priority>) of orders: hour is the order's day."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    name = F.lower(F.regexp_extract("o_orderpriority", r"^\d-(\w+)", 1))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderdate").alias("hour"), (F.col("c_nationkey") + 1).cast("int").alias("zone_id"), name.alias("service"))
    one = [F.sum(F.when(F.col("service") == s, 1).otherwise(0)).cast("int").alias(f"trips_{s}") for s in PRIORITIES]
    sums = rows.groupBy("hour", "zone_id").agg(F.count("*").cast("int").alias("trips_total"), *one)
    return io.with_boroughs(sums, zones(spark, d))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return features.build_features(demand(spark, d).select("hour", "zone_id", "borough", "trips_total"))


def periods(rows: DataFrame) -> DataFrame:
    return rows.withColumn("period", F.when(F.col("hour") < ntz(NEXT), "P1").otherwise("P2"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored hours: the baseline is lag_168, the forecast the mean of the last day."""
    rows = feature_rows(spark, d).where(F.col("hour") >= ntz(TEST))
    return evaluate.scored(rows, "trips_total", "lag_168", "roll_mean_24")


def match_side(spark: SparkSession, d: str, kind: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stop = F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    group = F.when(k % 5 != 0, (k % 5).cast("string"))
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("ts").alias("pickup"), stop.alias("dropoff"), "user_id", (F.col("user_id") % 30).alias("pu"), (k % 7).alias("do_zone"), group.alias("grp"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    """(station, time, temperature_2m, precipitation): hourly figures of events by type, as UTC observations."""
    from tallyspark.functions.time import hour_floor

    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("station"), hour_floor(F.col("ts")).alias("time"))
    return rows.agg(F.round(F.sum("value"), 2).alias("temperature_2m"), (F.count("*") / 10).alias("precipitation"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """(station, payload): the observations as JSON of parallel arrays; a series per station and day."""
    rows = observed(spark, d).groupBy("station", F.to_date("time").alias("day")).agg(F.sort_array(F.collect_list(F.struct("time", "temperature_2m", "precipitation"))).alias("x"))
    hourly = F.struct(
        F.transform("x", lambda r: F.date_format(r["time"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("x.temperature_2m").alias("temperature_2m"), F.col("x.precipitation").alias("precipitation"),
    )
    return rows.select("station", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
