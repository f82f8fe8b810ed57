"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by weight; no source may be repeated more than `most` times,
so what a small source can't take is shared again by weight (water filling). A document of a source
is wanted target / source_size times: its whole part is taken for certain, its fractional part is a
probability. Probabilities are rounded in pairs: the longest open document and the pool of all shorter ones of its group.
Words are moved from one of the two to the other, in a random direction that keeps all expectations, until the document or one
of the pool is 0 or 1. So long documents are settled first, and what is left in the end is short. A group of up to
GROUP documents leaves one residual; residuals are grouped again, level by level, until a source has
one, which a last draw rounds. So a source's words differ from its target by less than one of its
documents, mostly a short one, and every document is taken as often on average as it is wanted.

Draws come from a hash of (seed, level, row), groups from a hash of the row, so that reruns agree
however the rows are partitioned.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import fresh, named, written

#: Documents rounded together, rows alike that are told apart by one task, and sources whose totals are broadcast (about 50 bytes each).
GROUP, ALIKE, SOURCES_BROADCAST = 128, 10_000, 100_000
EPS = 1e-9


def source_plan(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> tuple[DataFrame, int, int]:
    """((s, source_size, target, left) of each source, number of sources, rows of the largest) of docs(source, size).

    Sources go by code point, null last. The ranks that weigh them come from a range sort and one offset a partition, and the level at which targets
    stop rising from sums over all sources, again until no other source is full; so the driver sees sums only, however many sources there are.
    """
    spark, order = docs.sparkSession, F.col("source").asc_nulls_last()
    sums = written(docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("rows")))  # the range sort reads them twice
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's within
    ranged = written(sums.repartitionByRange(order).sortWithinPartitions(order).select("*", F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    offsets, before = [], 0
    for r in ranged.groupBy("part").agg(F.count("*").alias("k")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["k"]
    rank = F.pmod(F.col("at") + F.col("before"), F.lit(len(weights))) + 1
    known = ranged.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), rank.cast("int")))
    unit, full = 0.0, -1
    while True:
        over = F.col("weight") * unit > most * F.col("n")
        r = known.agg(F.count(F.when(over, 1)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.sum(F.when(over, F.col("n"))).alias("taken"), F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
        if r["full"] == full or not r["open"]:
            break
        unit, full = (r["n"] - most * (r["taken"] or 0)) / r["open"], r["full"]
    over = F.col("weight") * unit > most * F.col("n")
    target = F.when(over, most * F.col("n")).otherwise(F.col("weight") * unit)
    return known.select(F.col("source").alias("s"), F.col("n").alias("source_size"), target.cast("double").alias("target"), F.col("rows").alias("left")), before, r["rows"] or 0


def _draw(*what) -> float:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big") / 2.0**64


def _snap(p: np.ndarray) -> np.ndarray:
    return np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))


def settle(p: np.ndarray, size: np.ndarray, keys: list[int], *salt) -> np.ndarray:
    """p with at most one fraction left, its sum of p * size unchanged and every expectation kept. Rows come longest first."""
    p = _snap(p)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    while len(open_) > 1:
        one, pool = open_[0], open_[1:]
        spread = p[pool] * (1 - p[pool])
        words = float((spread * size[pool]).sum())
        up = min((1 - p[one]) * size[one], words / (1 - p[pool]).max())  # words that can go from the pool to the document
        down = min(p[one] * size[one], words / p[pool].max())
        move = up if _draw(*salt, keys[one], len(open_)) * (up + down) < down else -down
        p[one] += move / size[one]
        p[pool] -= move * spread / words
        p[open_] = _snap(p[open_])
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def _round_group(level: int, last: bool, seed: int):
    """Rounds one group of documents (columns row, size, p); at most one keeps a fraction. At the last level a draw rounds that one too."""

    def go(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group, [("size", "descending"), ("row", "ascending")]))
        keys = group["row"].to_pylist()
        p = settle(group["p"].to_numpy().copy(), group["size"].to_numpy().astype(float), keys, seed, level)
        if last:
            for i in np.flatnonzero((p > 0) & (p < 1)):
                p[i] = float(_draw(seed, level, keys[i], "last") < p[i])
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return go


def mix(docs: DataFrame, size: str = "size", weights: tuple = (5, 2, 1), most: float = 3.0, seed: int = 20240501, keep: tuple = ()) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, *keep) of docs(doc_id, source, `size`, *keep).

    Every row is a document of its own, repeated ids too. A null source is a source. A row of size 0
    (null or blank text) carries no words: only the whole part of its share is taken. Sources whose
    size is 0 have target 0. No rows in, no rows out.
    """
    docs = docs.select("doc_id", "source", F.col(size).cast("long").alias("size"), *keep)
    plan, sources, largest = source_plan(docs, weights, most)
    if sources <= SOURCES_BROADCAST:
        plan = F.broadcast(plan)
    # rows that are alike are counted, then numbered in blocks, so that a repeated id is no hot group
    known = ["doc_id", "source", "size", *keep]
    blocks = docs.groupBy(*known).agg(F.count("*").alias("alike")).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(alike - 1) div {ALIKE}"))))
    blocks = blocks.repartition(*known, "block")
    numbers = F.sequence(F.col("block") * ALIKE, F.least(F.col("alike"), (F.col("block") + 1) * ALIKE) - 1)
    rows = blocks.withColumn("number", F.explode(numbers)).select(*known, F.xxhash64(F.lit(seed), *known, "number").alias("row"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(ratio + EPS).cast("int"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0)))
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    left, level, out = max(1, largest), 0, None
    while True:
        last = left <= GROUP
        groups = F.lit(1) if last else F.ceil(F.col("left") / GROUP)
        rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(level), "row"), groups))
        done = rows.groupBy("source", "g").applyInArrow(_round_group(level, last, seed), rows.schema).drop("g")
        if not last:
            done = written(done)
        settled = done if last else done.where(~fractional)
        out = settled if out is None else out.unionByName(settled)
        if last:
            break
        rows = done.where(fractional).withColumn("left", F.ceil(F.col("left") / GROUP))
        left, level = math.ceil(left / GROUP), level + 1
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"), *keep)


def words() -> Column:
    """Runs of other than ASCII white space in the column text; null text: 0."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def mixed_documents(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """mix() of documents, sized in words."""
    return mix(docs.select("doc_id", "source", words().alias("size")), "size", weights, most)


def repeated_documents(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns.

    Rows alike in id, text and source count together: the first of them by its columns stands for all.
    """
    key, id_, copies, rows, row, copy = (fresh(docs, x) for x in ("key", "id", "copies", "rows", "row", "copy"))
    keyed = F.xxhash64("text", "source")
    taken = mix(docs.select("doc_id", "source", words().alias("size"), keyed.alias("t")), "size", weights, most, keep=("t",))
    taken = taken.groupBy(F.col("doc_id").alias(id_), F.col("t").alias(key)).agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & (keyed == F.col(key)))
    single = met.where(F.col(rows) == 1).select(*map(named, docs.columns), copies)
    several = met.where(F.col(rows) > 1).groupBy(id_, key).agg(F.min(F.struct(*map(named, docs.columns))).alias(row), F.first(copies).alias(copies)).select(f"{row}.*", copies)
    return single.unionByName(several).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*map(named, docs.columns))
