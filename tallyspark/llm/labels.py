"""Labelled rows for training: a bounded sample, never of the held-out fifth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled documents train a model; beyond, a sample by hash of the id.
TRAIN_ROWS = 20_000


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is of the held-out fifth: crc32 of the id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of labelled documents outside the held-out fifth, about `most` at most.

    Rows without a label of 0 or 1, an id or a text are left out. Labels that repeat count once; ids labelled both
    ways are left out. The chosen ids, a bounded number, are broadcast, so that texts aren't shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y1")).where("y = y1").select("doc_id", F.col("y").cast("int").alias("y"))
    n = known.count()
    if n > most:
        span = 1 << 20
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(span)) < int(span * most / n))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
