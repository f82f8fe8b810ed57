"""Trips of several services from monthly files whose columns drift."""

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.files import file_system

#: Footers read at a time.
FOOTERS = 16


def _footer(spark: SparkSession, path: str, columns: tuple[str, ...]) -> tuple[str, ...]:
    """The stored names and types of some columns of a Parquet file, or of the first file of a folder."""
    fs, at = file_system(spark, path)
    if fs.getFileStatus(at).isDirectory():
        at = min((s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"), key=lambda p: p.getName(), default=None)
        if at is None:
            raise FileNotFoundError(f"no file under {path}")
    source = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, spark._jsparkSession.sessionState().newHadoopConf())
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        fields = {f.getName().lower(): f.toString() for f in reader.getFileMetaData().getSchema().getFields()}
    finally:
        reader.close()
    missing = [c for c in columns if c.lower() not in fields]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return tuple(fields[c.lower()] for c in columns)


def scan_trips(spark: SparkSession, config: dict, months: list[str], url: str) -> DataFrame:
    """(service, month, pickup, zone) of every service and month; only two columns of each file are read.

    config: service -> (pickup column, zone column); url: a pattern with {service} and {month}. Files are grouped by service and by the types that their footers
    store the two columns with; each group is one read with that schema, so that hundreds of files are a handful of branches of the
    plan. The month comes from the file's name. Zones become doubles, so that files that store them as numbers of any kind union.
    """
    files = [(s, m, url.format(service=s, month=m)) for s in config for m in months]
    with ThreadPoolExecutor(FOOTERS) as pool:
        kinds = list(pool.map(inheritable_thread_target(spark)(lambda f: _footer(spark, f[2], config[f[0]])), files))
    groups: dict[tuple, list[tuple[str, str]]] = defaultdict(list)
    for (s, m, path), kind in zip(files, kinds, strict=True):
        groups[s, kind].append((m, path))
    parts = []
    for (s, _), some in groups.items():
        pickup, zone = config[s]
        stored = spark.read.parquet(some[0][1]).select(pickup, zone).schema
        rows = spark.read.schema(T.StructType(stored.fields)).parquet(*(path for _, path in some))
        before, after = url.rsplit("/", 1)[-1].format(service=s, month="\0").split("\0")
        # the last part of the path that looks like the pattern: a file, or a folder of files
        name = F.regexp_extract(F.col("_metadata.file_path"), f"{_quoted(before)}([^/]*){_quoted(after)}(?:/[^/]*)?$", 1)
        parts.append(rows.select(F.lit(s).alias("service"), name.alias("month"), F.col(pickup).cast("timestamp_ntz").alias("pickup"), F.col(zone).cast("double").alias("zone")))
    return reduce(DataFrame.unionByName, parts)


def _quoted(text: str) -> str:
    """A literal part of a Java pattern."""
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in text)
