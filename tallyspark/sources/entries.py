"""Quality entries: counts of the rows of each service and month.

Builds append their entries with a build number and never rewrite those of others, so two builds at the same time keep both. The newest entry of a service and month
counts; compact_entries() drops the others.
"""

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.files import delete_path, file_system

ENTRY_COUNTS = ("rows_read", "rows_outside_month", "rows_zone_null", "rows_zone_unknown", "rows_zone_out_of_range", "rows_in_mart")
KEEP = ["service", "month", *ENTRY_COUNTS]


def upsert_entries(old: DataFrame, new: DataFrame, services: list[str]) -> DataFrame:
    """Quality entries where the new ones replace the old of the same service and month, by month and service order; other columns go."""
    stay = old.select(*KEEP).join(new.select("service", "month"), ["service", "month"], "left_anti")
    order = F.array_position(F.lit(services), F.col("service"))
    return stay.unionByName(new.select(*KEEP)).orderBy("month", order)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON document {"entries": [...]}."""
    return spark.read.json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def append_entries(new: DataFrame, path: str, build: int | None = None) -> int:
    """Adds entries of one build in a folder of their own; returns its number, by default the time in nanoseconds."""
    build = time.time_ns() if build is None else build
    new.select(*KEEP, F.lit(build).cast("long").alias("build")).coalesce(1).write.parquet(f"{path}/part={build}-{uuid.uuid4().hex}")
    return build


def _parts(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, f"{path}/part=*/_SUCCESS")
    return sorted(s.getPath().getParent().toString() for s in fs.globStatus(at) or [])


def _all(spark: SparkSession, parts: list[str]) -> DataFrame:
    kinds = ", ".join(f"{c} {'string' if c in KEEP[:2] else 'long'}" for c in [*KEEP, "build"])
    return spark.read.schema(kinds).parquet(*parts) if parts else spark.createDataFrame([], kinds)


def _newest(rows: DataFrame) -> DataFrame:
    # of two entries with one build number (repeated after a failure) the larger one, so that the choice is the same in every run
    order = F.struct("build", *ENTRY_COUNTS)
    return rows.groupBy("service", "month").agg(F.max(order).alias("e")).select("service", "month", "e.*")


def newest_entries(spark: SparkSession, path: str, services: list[str]) -> DataFrame:
    """The newest entry of every service and month, by month and service order. Only finished builds are read."""
    return _newest(_all(spark, _parts(spark, path))).orderBy("month", F.array_position(F.lit(services), F.col("service"))).select(*KEEP)


def compact_entries(spark: SparkSession, path: str) -> None:
    """Puts the newest entries, with their build numbers, in one folder and then deletes the folders they came from. Entries that are added meanwhile stay.

    If it ends in between, entries stand there twice, which changes nothing.
    """
    parts = _parts(spark, path)
    if len(parts) > 1:
        _newest(_all(spark, parts)).select(*KEEP, "build").coalesce(1).write.parquet(f"{path}/part=0-{uuid.uuid4().hex}")
        for p in parts:
            delete_path(spark, p)
