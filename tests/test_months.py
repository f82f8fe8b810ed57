"""Months that readers never see half written, sums kept by month, appended entries, files whose columns drift."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime as D
from datetime import timedelta as T

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import features, partials, reports
from tallyspark.sources import entries, io, months

MART = "hour timestamp_ntz, zone_id int, borough string, trips_total int, trips_a int, trips_b int"
NAMES = ["a", "b"]


def mart(spark, start: D, days: int, seed: int, zones=(1, 2, 3)):
    r = random.Random(seed)
    rows = [(start + T(hours=i), z, f"B{z % 2}", (a := r.randrange(9)) + (b := r.randrange(5)), a, b) for z in zones for i in range(24 * days)]
    return spark.createDataFrame(rows, MART)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_a_lost_writer_leaves_the_old_months(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/mart"
    old, new = mart(spark, D(2026, 1, 25), 10, 1), mart(spark, D(2026, 1, 25), 10, 2)
    assert io.write_months(old, path) == ["2026-01", "2026-02"]
    # lost after the files are there, before anything names them
    build, staged = months.stage(new, path)
    assert staged == ["2026-01", "2026-02"] and content(io.read_months(spark, path)) == content(old)
    # lost between two months: each month is whole, the old one or the new one
    rename = months._rename_over

    def dies(spark_, source, target):
        if "month=2026-02" in target:
            raise RuntimeError("lost")
        rename(spark_, source, target)

    monkeypatch.setattr(months, "_rename_over", dies)
    with pytest.raises(RuntimeError):
        months.publish(spark, path, build, staged)
    monkeypatch.undo()
    january = F.col("hour") < F.lit(D(2026, 2, 1)).cast("timestamp_ntz")
    assert content(io.read_months(spark, path)) == content(new.where(january).union(old.where(~january)))
    # the next writer isn't disturbed, and what was left behind goes
    io.write_months(new, path)
    assert content(io.read_months(spark, path)) == content(new)
    months.vacuum(spark, path)
    assert content(io.read_months(spark, path)) == content(new) and len(list((tmp_path / "mart").glob("month=*/build=*"))) == 2


def test_a_reader_that_has_begun_can_finish(spark, tmp_path):
    path = f"file://{tmp_path}/mart"
    versions = [mart(spark, D(2026, 3, 1), 2, i) for i in range(4)]
    io.write_months(versions[0], path)
    begun = io.read_months(spark, path)
    io.write_months(versions[1], path)
    assert content(begun) == content(versions[0])
    for v in versions[2:]:
        io.write_months(v, path)
    assert content(io.read_months(spark, path)) == content(versions[3]) and len(list((tmp_path / "mart").glob("month=*/build=*"))) == 2


def test_writers_of_one_month_do_not_delete_each_others_builds(spark, tmp_path):
    path = f"file://{tmp_path}/mart"
    slow, *others = (mart(spark, D(2026, 3, 1), 2, i) for i in range(4))
    build, staged = months.stage(slow, path)
    for v in others:
        io.write_months(v, path)
    assert content(io.read_months(spark, path)) == content(others[-1])
    months.publish(spark, path, build, staged)
    assert content(io.read_months(spark, path)) == content(slow)


def test_a_failing_job_commits_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/mart"
    old = mart(spark, D(2026, 3, 1), 2, 1)
    io.write_months(old, path)
    broken = old.withColumn("trips_a", F.when(F.col("zone_id") == 3, F.raise_error(F.lit("broken")).cast("int")).otherwise(0))
    with pytest.raises(Exception, match="broken"):
        io.write_months(broken, path)
    assert content(io.read_months(spark, path)) == content(old)


def test_only_named_months_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/mart"
    io.write_months(mart(spark, D(2026, 1, 30), 35, 1), path)
    some = io.read_months(spark, path, ["hour"], ["2026-02", "2027-01"])
    assert {f.split("month=")[1][:7] for f in some.inputFiles()} == {"2026-02"} and some.count() == 28 * 24 * 3
    with pytest.raises(FileNotFoundError):
        io.read_months(spark, path, months=["2025-01"])
    months.retract(spark, path, ["2026-02", "2020-01"])
    assert sorted(months.committed(spark, path)) == ["2026-01", "2026-03"]


# Sums kept by month


def reports_of(hours, zones, names):
    return [reports.daily_totals(hours, NAMES), reports.service_mix(hours, NAMES), reports.hourly_profile(hours), reports.monthly_trend(hours, "borough"), reports.month_to_month(hours), partials.overview_kpis(hours, zones), partials.zone_totals(hours, zones, names), partials.zone_kpis(zones)]


def reports_of_mart(rows, names):
    return [reports.daily_totals(rows, NAMES), reports.service_mix(rows, NAMES), reports.hourly_profile(rows), reports.monthly_trend(rows, "borough"), reports.month_to_month(rows), reports.overview_kpis(rows), reports.zone_totals(rows, names), reports.zone_kpis(rows, ("zone_id",))]


def test_kept_sums_give_the_reports_and_a_new_month_touches_its_own(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    one, two, again = mart(spark, D(2026, 1, 20), 25, 1), mart(spark, D(2026, 3, 1), 3, 2, (2, 3, 4)), mart(spark, D(2026, 2, 1), 5, 3)
    names = spark.createDataFrame([(i, f"Z{i}", f"B{i % 2}") for i in range(1, 5)], "zone_id int, zone string, borough string")
    assert partials.keep(one, path, NAMES) == ["2026-01", "2026-02"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").glob("*/month=2026-01/**/*")}
    assert partials.keep(two, path, NAMES) == ["2026-03"] and partials.keep(again, path, NAMES) == ["2026-02"]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").glob("*/month=2026-01/**/*")}
    rows = one.where("hour < timestamp_ntz'2026-02-01'").union(two).union(again)
    for got, want in zip(reports_of(partials.hours(spark, path), partials.zones(spark, path), names), reports_of_mart(rows, names), strict=True):
        assert got.columns == want.columns and content(got) == content(want)
    partials.drop(spark, path, ["2026-03"])
    assert content(partials.zone_kpis(partials.zones(spark, path))) == content(reports.zone_kpis(rows.where("hour < timestamp_ntz'2026-03-01'"), ("zone_id",)))


def test_features_of_a_month_read_its_halo_only(spark, tmp_path):
    path = f"file://{tmp_path}/mart"
    rows = mart(spark, D(2025, 11, 20), 55, 4)
    io.write_months(rows, path)
    whole = features.build_features(rows.select("hour", "zone_id", "borough", "trips_total"))
    for month, start, end in (("2025-11", D(2025, 11, 1), D(2025, 12, 1)), ("2025-12", D(2025, 12, 1), D(2026, 1, 1)), ("2026-01", D(2026, 1, 1), D(2026, 2, 1))):
        got = features.build_month_features(spark, path, month)
        at = F.col("hour").between(F.lit(start).cast("timestamp_ntz"), F.lit(end - T(hours=1)).cast("timestamp_ntz"))
        want = whole.where(at)
        assert content(got.select(*want.columns).fillna(-1)) == content(want.fillna(-1))
    files = {f.split("month=")[1][:7] for f in features.build_month_features(spark, path, "2026-01").inputFiles()}
    assert files == {"2025-12", "2026-01"}


# Entries


def entry(spark, service, month, n):
    return spark.createDataFrame([(service, month, n, 0, 0, 0, 0, n)], "service string, month string, " + ", ".join(f"{c} long" for c in entries.ENTRY_COUNTS))


def test_two_builds_at_once_keep_both_entries(spark, tmp_path):
    path, names = f"file://{tmp_path}/entries", ["x", "y"]
    assert io.newest_entries(spark, path, names).collect() == []
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: io.append_entries(entry(spark, names[i % 2], f"2026-0{1 + i // 2}", i), path), range(6)))
    seen = lambda: [(r.month, r.service, r.rows_read) for r in io.newest_entries(spark, path, names).collect()]
    assert seen() == [("2026-01", "x", 0), ("2026-01", "y", 1), ("2026-02", "x", 2), ("2026-02", "y", 3), ("2026-03", "x", 4), ("2026-03", "y", 5)]
    io.append_entries(entry(spark, "x", "2026-02", 77), path)
    io.append_entries(entry(spark, "x", "2026-02", 5), path, build=1)  # older than those there
    assert seen()[2] == ("2026-02", "x", 77)
    before = seen()
    # a build that isn't finished isn't read; compaction leaves what it doesn't know
    unfinished = tmp_path / "entries" / "part=9-x"
    unfinished.mkdir()
    io.compact_entries(spark, path)
    assert seen() == before and len(list((tmp_path / "entries").glob("part=*/_SUCCESS"))) == 1 and unfinished.exists()
    io.append_entries(entry(spark, "y", "2026-03", 9), path)
    assert seen()[-1] == ("2026-03", "y", 9)


# Trip files


def test_many_files_of_few_kinds_are_few_branches(spark, tmp_path):
    config = {"one": ("p", "PUlocationID"), "two": ("started", "z")}
    labels = [f"{2000 + i // 12}-{i % 12 + 1:02d}" for i in range(40)]
    want = []
    for s, (p, z) in config.items():
        for kind, some in (("int", labels[::3]), ("double", labels[1::3]), ("long", labels[2::3])):
            rows = [(D(2026, 1, 1), m, i) for m in some for i in (1, None)]
            want += [(s, m, D(2026, 1, 1), None if i is None else float(i)) for _, m, i in rows]
            table = spark.createDataFrame(rows, "p timestamp_ntz, m string, z int").select(F.col("p").alias(p), F.col("z").cast(kind).alias(z), F.lit("x").alias(f"extra_{kind}"), "m")
            table.coalesce(1).write.partitionBy("m").mode("append").parquet(f"file://{tmp_path}/{s}")
            for m in some:
                (tmp_path / s / f"m={m}").rename(tmp_path / f"{s}_data_{m}.parquet")
    got = io.scan_trips(spark, config, labels, f"file://{tmp_path}/" + "{service}_data_{month}.parquet")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6
    with pytest.raises(ValueError, match="no column"):
        io.scan_trips(spark, {"one": ("p", "other")}, labels[:1], f"file://{tmp_path}/" + "{service}_data_{month}.parquet")
