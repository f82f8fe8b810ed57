"""Hand-made trips of one month and four services: the account of rows, the fact, the grid, builds, calendars."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import time
from tallyspark.functions.time import ntz
from tallyspark.operators import mart as m
from tallyspark.operators import reports
from tallyspark.sources import io

CONFIG = {"yellow": ("tpep_pickup_datetime", "PULocationID"), "green": ("lpep_pickup_datetime", "PULocationID"), "fhv": ("pickup_datetime", "PUlocationID"), "fhvhv": ("pickup_datetime", "PULocationID")}
ROWS = {
    "yellow": ("int", [(D(2026, 6, 1, 0, 10), 1), (D(2026, 6, 1, 0, 50), 1), (D(2026, 6, 1, 2, 5), 2), (D(2008, 12, 31, 23, 3), 1), (D(2026, 7, 1), 1), (D(2026, 6, 30, 23, 59), 1), (D(2026, 6, 2, 8), None), (D(2026, 6, 2, 8), 265), (D(2026, 6, 2, 9), 264)]),
    "green": ("int", [(D(2026, 6, 1, 0, 30), 1)]),
    "fhv": ("double", [(D(2026, 6, 1, 0, 0), None), (D(2026, 6, 1, 0, 1), None), (D(2026, 6, 1, 0, 2), 2.0)]),
    "fhvhv": ("int", [(D(2026, 6, 1), 2), (D(2026, 6, 1, 2, 59), 2)]),
}
ZONES = "LocationID,Borough,Zone,service_zone\n1,North,Old Harbour,outer\n2,East,\"Mill, Lower\",inner\n3,East,Hill/Quarry,inner\n264,Unknown,N/A,N/A\n265,N/A,Elsewhere,N/A\n"
NAMES = list(CONFIG)
RANGES = m.ZoneRanges()


@pytest.fixture(scope="module", params=["UTC", "America/New_York"])
def built(spark, tmp_path_factory, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    top = tmp_path_factory.mktemp("trips")
    for s, (kind, rows) in ROWS.items():
        pickup, zone = CONFIG[s]
        spark.createDataFrame([(1, p, z, "x") for p, z in rows], f"VendorID int, `{pickup}` timestamp_ntz, `{zone}` {kind}, request_source string").write.parquet(f"{top}/{s}_2026-06.parquet")
    (top / "zones.csv").write_text(ZONES)
    trips = io.scan_trips(spark, CONFIG, ["2026-06"], str(top / "{service}_{month}.parquet"))
    raw = m.month_raw(trips, ntz("2026-06-01"), ntz("2026-07-01"), ("service", "month"))
    services, zones = io.service_dimension(spark, NAMES), io.read_zones(spark, str(top / "zones.csv"))
    facts = m.fact(raw, services, RANGES)
    hours = time.hours_of_months(spark, ["2026-06"])
    yield {"spark": spark, "raw": raw, "zones": zones, "facts": facts, "services": services, "mart": m.demand_mart(facts, services, hours, zones, NAMES, RANGES).cache(), "top": top}
    spark.conf.set("spark.sql.session.timeZone", old)


def test_row_account(built):
    got = {r.service: r for r in m.quality(built["raw"], RANGES).collect()}
    assert tuple(got["yellow"])[1:] == (9, 2, 1, 2, 0, 4) and tuple(got["fhv"])[1:] == (3, 0, 2, 0, 0, 1)
    assert all(r.rows_read == sum(tuple(r)[2:]) for r in got.values())


def test_grid_is_complete_and_zero_filled(built):
    mart = built["mart"]
    assert mart.count() == 3 * 30 * 24 == mart.select("hour", "zone_id").distinct().count()
    assert mart.agg(F.min("hour"), F.max("hour")).first()[:] == (D(2026, 6, 1), D(2026, 6, 30, 23))
    assert mart.where("zone_id = 3").agg(F.sum("trips_total")).first()[0] == 0


def test_mart_values(built):
    at = {(r.hour, r.zone_id): r for r in built["mart"].where("trips_total > 0").collect()}
    one, two, late = at[D(2026, 6, 1), 1], at[D(2026, 6, 1), 2], at[D(2026, 6, 30, 23), 1]
    assert (one.trips_yellow, one.trips_green, one.trips_total) == (2, 1, 3) and (two.trips_fhv, two.trips_fhvhv, two.trips_total) == (1, 1, 2) and late.trips_yellow == 1
    in_mart = m.quality(built["raw"], RANGES).agg(F.sum("rows_in_mart")).first()[0]
    assert built["mart"].agg(F.sum("trips_total")).first()[0] == in_mart


def test_fact_keeps_unknown_zones(built):
    assert built["facts"].where("zone_id >= 264").agg(F.sum("trips")).first()[0] == 2
    assert built["facts"].where("hour < timestamp_ntz'2026-06-01' OR hour >= timestamp_ntz'2026-07-01'").isEmpty()


def test_months_are_replaced_alone(built):
    spark, path = built["spark"], f"{built['top']}/mart"
    with pytest.raises(FileNotFoundError):
        io.read_months(spark, path)
    io.write_months(built["mart"], path)
    earlier = built["mart"].limit(3).withColumn("hour", F.expr("hour - interval 31 days"))
    io.write_months(earlier, path)
    io.write_months(earlier.limit(2), path)
    back = io.read_months(spark, path)
    assert back.count() == 2160 + 2 and "month" not in back.columns
    assert sorted(r.month for r in io.built_months(spark, path).collect()) == ["2026-05", "2026-06"]
    wanted = spark.createDataFrame([("2026-06",), ("2026-07",)], "month string")
    assert [r.month for r in io.months_to_build(wanted, io.built_months(spark, path)).collect()] == ["2026-07"]
    assert io.months_to_build(wanted, io.built_months(spark, path), force=True).count() == 2
    same = m.compare(io.read_months(spark, path).where("hour >= timestamp_ntz'2026-06-01'"), built["mart"], ["trips_total"]).first()
    assert same.identical and same.trips_total_diff == 0


def test_upsert(built):
    new = m.quality(built["raw"], RANGES, ("service", "month"))
    old = new.limit(0).unionByName(new.where("service = 'yellow'").withColumn("month", F.lit("2026-05"))).unionByName(new.where("service = 'fhv'").withColumn("rows_read", F.lit(99).cast("long"))).withColumn("seconds", F.lit(1.0))
    rows = io.upsert_entries(old, new, NAMES).collect()
    assert [(r.month, r.service) for r in rows] == [("2026-05", "yellow"), *(("2026-06", s) for s in NAMES)] and "seconds" not in rows[0] and rows[3].rows_read == 3
    path = f"{built['top']}/entries.json"
    with open(path, "w") as f:
        import json

        json.dump({"entries": [r.asDict() for r in rows]}, f)
    assert io.read_entries(built["spark"], path).count() == 5


def test_zone_files(built):
    zones = built["zones"]
    assert zones.where("zone_id = 264").first()["zone"] == "N/A" and zones.count() == 5
    io.write_zones(zones, f"{built['top']}/out")
    assert io.read_zones(built["spark"], f"{built['top']}/out").collect() == zones.orderBy("zone_id").collect()
    assert reports.zone_labels(zones).where("zone_id = 2").first()["label"] == "Mill, Lower, East [2]"


def test_zone_numbers_round_half_to_even(spark):
    rows = spark.createDataFrame([("2.5",), ("3.5",), ("-0.5",), ("2.7",), ("x",), ("NaN",), (None,)], "z string")
    assert [r[0] for r in rows.select(m.zone_number(F.col("z"))).collect()] == [2, 4, 0, 3, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_calendar_facts(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = time.calendar(time.hours_of_months(spark, time.month_range("2025-06", "2026-07"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(rows) == 426 * 24 and sorted(r.hour for r in rows if r.is_dst_transition) == [D(2025, 11, 2, 1), D(2026, 3, 8, 2)]
    free = {str(r.date) for r in rows if r.is_holiday}
    assert {"2025-07-04", "2025-12-25", "2026-07-03"} <= free and "2026-06-10" not in free
    assert next(r.day_of_week for r in rows if r.hour == D(2026, 6, 1)) == 0


def test_holidays_equal_the_pandas_calendar(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = {d.date() for d in USFederalHolidayCalendar().holidays("2015-01-01", "2035-12-31")}
    got = {r.date for r in time.holidays(spark.range(2015, 2036).selectExpr("cast(id as int) as year")).collect() if r.date.year <= 2035}
    assert got == want


def test_hour_floor_on_missing_hours(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.createDataFrame([(D(2026, 3, 8, 2, 30),), (None,)], "p timestamp_ntz").select(time.hour_floor(F.col("p"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [r[0] for r in got] == [D(2026, 3, 8, 2), None]


def test_month_helpers(spark):
    assert time.month_range("2025-11", "2026-02") == ["2025-11", "2025-12", "2026-01", "2026-02"]
    assert time.parse_months("2026-01:2026-02") == ["2026-01", "2026-02"] and time.parse_months("2026-03") == ["2026-03"]
    with pytest.raises(ValueError):
        time.parse_months("2026-03:2026-01")
    weeks = time.month_weeks(spark.createDataFrame([("2026-05",)], "month string")).orderBy("start").collect()
    assert len(weeks) == 5 and (weeks[-1].start, weeks[-1].end) == (D(2026, 5, 29), D(2026, 6, 1))


def test_fact_months_are_deleted_and_inserted(built):
    spark, path, facts = built["spark"], f"{built['top']}/fact", built["facts"]
    later = facts.withColumn("hour", F.expr("hour + interval 31 days"))
    io.write_months(facts.unionByName(later), path)
    for _ in range(2):
        io.replace_months(facts.where("zone_id = 1"), path, ["2026-06"])
        back = io.read_months(spark, path)
        assert back.where("hour < timestamp_ntz'2026-07-02'").exceptAll(facts.where("zone_id = 1")).isEmpty()
        assert back.count() == facts.where("zone_id = 1").count() + later.count()
    io.replace_months(facts.where("false"), path, ["2026-06"])
    assert io.read_months(spark, path).count() == later.count()
