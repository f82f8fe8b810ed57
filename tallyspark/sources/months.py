"""A table by months that readers never see half written.

Layout: month=YYYY-MM/build=<id>/*.parquet, and month=YYYY-MM/_current, which names the month's committed build and the one before it. A writer first
writes new builds, which nothing reads yet; then it replaces each month's _current by renaming a finished file over it. So a month is either the old one
or the new one, whole; a writer that is lost in between leaves the old one, and builds that nothing names until vacuum() deletes them. The build before the
current one stays, so that a reader that has just begun can finish.
"""

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.files import delete_path, file_system

CURRENT = "_current"
#: Rows of a file are in the order of those of these columns that a table has.
ORDER = ("hour", "zone_id", "hour_of_day", "borough")


def _rename_over(spark: SparkSession, source: str, target: str) -> None:
    """Puts a file in the place of another in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    _, at = file_system(spark, target)
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(at.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(hadoop.Path(source), at, overwrite)


def _put(spark: SparkSession, path: str, content: dict) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def _get(spark: SparkSession, status) -> dict:
    fs, at = file_system(spark, status.getPath().toString())
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _found(spark: SparkSession, pattern: str) -> list:
    fs, at = file_system(spark, pattern)
    return list(fs.globStatus(at) or [])


def _month_of(path: str) -> str:
    return next(x for x in path.split("/") if x.startswith("month="))[len("month=") :]


def _pointers(spark: SparkSession, path: str) -> dict[str, dict]:
    """month -> content of its file. A month is one small file, so this is a listing of some hundred files."""
    return {_month_of(s.getPath().toString()): _get(spark, s) for s in _found(spark, f"{path}/month=*/{CURRENT}")}


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """month -> committed build."""
    return {m: x["build"] for m, x in _pointers(spark, path).items()}


def stage(rows: DataFrame, path: str, month: Column | None = None) -> tuple[str, list[str]]:
    """Writes a build of the months that rows hold, which nothing reads yet. (build, months)."""
    build = uuid.uuid4().hex
    label = F.date_format("hour", "yyyy-MM") if month is None else month
    new = rows.withColumn("month", label).withColumn("build", F.lit(build)).repartition("month").sortWithinPartitions(*(c for c in ORDER if c in rows.columns))
    new.write.mode("append").option("compression", "zstd").partitionBy("month", "build").parquet(path)
    return build, sorted(_month_of(s.getPath().toString()) for s in _found(rows.sparkSession, f"{path}/month=*/build={build}"))


def publish(spark: SparkSession, path: str, build: str, months: Iterable[str]) -> None:
    """Makes a staged build the current one of its months, month by month; the build before the one replaced is deleted. Builds of other writers stay."""
    now = _pointers(spark, path)
    for month in months:
        folder, old = f"{path}/month={month}", now.get(month, {})
        _put(spark, f"{folder}/{CURRENT}.{build}", {"build": build, "before": old.get("build")})
        _rename_over(spark, f"{folder}/{CURRENT}.{build}", f"{folder}/{CURRENT}")
        if old.get("before"):
            delete_path(spark, f"{folder}/build={old['before']}")


def retract(spark: SparkSession, path: str, months: Iterable[str]) -> None:
    """Months without rows from now on: first nothing names their builds, then these go."""
    for month in months:
        fs, at = file_system(spark, f"{path}/month={month}/{CURRENT}")
        if fs.exists(at):
            fs.delete(at, False)
            _delete_builds(spark, path, month, set())


def _delete_builds(spark: SparkSession, path: str, month: str, keep: set[str]) -> None:
    """Deletes a month's builds but some."""
    for s in _found(spark, f"{path}/month={month}/build=*"):
        if s.getPath().getName()[len("build=") :] not in keep:
            delete_path(spark, s.getPath().toString())


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes all builds but the current ones, for times when nobody writes: what lost writers have left goes too."""
    now = committed(spark, path)
    for s in _found(spark, f"{path}/month=*"):
        month = _month_of(s.getPath().toString())
        _delete_builds(spark, path, month, {now[month]} if month in now else set())


def write_months(mart: DataFrame, path: str, month: Column | None = None) -> list[str]:
    """Replaces exactly the months that mart holds, each in one step; others stay. Running it again gives the same rows."""
    build, months = stage(mart, path, month)
    publish(mart.sparkSession, path, build, months)
    return months


def replace_months(rows: DataFrame, path: str, months: list[str]) -> None:
    """Deletes months of a table such as the fact and inserts them again from rows(hour, ...). A month without rows is gone; others stay."""
    full = write_months(rows.where(F.date_format("hour", "yyyy-MM").isin(months)), path)
    retract(rows.sparkSession, path, set(months) - set(full))


def read_months(spark: SparkSession, path: str, columns: list[str] | None = None, months: Iterable[str] | None = None) -> DataFrame:
    """Committed months (those named, or all) without the partition columns; only their folders are read. Raises FileNotFoundError if there is none."""
    wanted = None if months is None else set(months)
    paths = [f"{path}/month={m}/build={b}" for m, b in sorted(committed(spark, path).items()) if wanted is None or m in wanted]
    if not paths:
        raise FileNotFoundError(f"no month under {path}")
    rows = spark.read.parquet(*paths)
    return rows.select(*columns) if columns else rows


def built_months(spark: SparkSession, path: str) -> DataFrame:
    """(month) of the committed months under a path."""
    return spark.createDataFrame([(m,) for m in sorted(committed(spark, path))], "month string")
