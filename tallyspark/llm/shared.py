"""Small helpers that several corpus operators use."""

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot that more than one in HOT_PART of all rows have, so there are HOT_PART of them at most; its rows go to SALTS tasks.
HOT_PART, SALTS = 1000, 64

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. On one machine (local master) a temporary one will do where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write a result as Parquet in the shared folder and read it back: lineage is cut, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that written() makes within, for a caller that writes its result and then needs them no more.

    At the end all of them are deleted that are still in the list; the caller takes out those that stay.
    """
    tables: list[DataFrame] = []
    token = _made.set(tables)
    try:
        yield tables
    finally:
        _made.reset(token)
        discard(*tables)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(). For those that nothing reads any more: neither a later step nor the result."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """A column by its name, whatever is in it (blanks, dots, commas, backticks)."""
    return F.col("`" + column.replace("`", "``") + "`")


def join_hot(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with few, which has each key once and in column c how many of the rows have it; without c.

    Rows of hot keys are dealt out by their other columns, and few's row of such a key is repeated for each part. The hot keys are
    broadcast, at most HOT_PART of them. few is counted when the plan is made, so it should be a written table.
    """
    total = few.agg(F.sum("c")).first()[0] or 0
    is_hot = F.col("c") > max(total // HOT_PART, SALTS)
    hot = F.broadcast(few.where(is_hot).select(*keys, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(SALTS))).otherwise(0)
    left = rows.join(hot, keys, "left").withColumn("salt", salt.cast("int"))
    right = few.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "salt"]).drop("hot", "salt", "c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(work: Callable) -> Callable:
    """The same work on batches; at its end the worker gives memory that it has freed back to the system. Workers stay, so what one stage has left would stand beside what the next one needs."""

    @wraps(work)
    def go(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return go


@trimmed
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            packed = pa.array([None if t is None else pack(t.encode()) for t in part.column(at).to_pylist()], pa.binary())
            yield part.set_column(at, "text", packed)


def packed(df: DataFrame) -> DataFrame:
    """The same rows with the column text compressed, for shuffles of whole texts; unpack() gives the texts back."""
    return df.mapInArrow(_packed, T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in df.schema]))


def unpack(column: pa.Array) -> pa.Array:
    """Texts of a column made by packed(), as UTF-8 strings; null stays null."""
    back = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else back(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())
