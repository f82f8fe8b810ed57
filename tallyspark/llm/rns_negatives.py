"""Hard-negative mining: exact integer scores of anchors against all rows by residue-number matrix products.

Components are integers. Rows are dealt by a hash into blocks, sorted by label and id, and written as packed matrices; anchors travel in packs.
A block's matrix and the packs that ask it come to one task in a row, the matrix once, and stream through it.

Scores are made by float32 matrix products modulo several small primes: with balanced residues, a sum of CHUNK products stays below
2**24, so every float32 sum is exact whatever the order of addition. Balanced mixed-radix digits (Chinese remainders) give the signed
score back; as many primes are taken as the largest possible score needs, which the largest components tell.

1. Every pack meets the rows of its anchors' labels in each block; the first rows of all blocks are the positives.
2. Every pack, now with its positives' scores, meets all rows of other labels; for each positive the first ones within its
   window of scores stay, first block by block, then over all blocks.

Anchors are a stated set that meets all rows; that costs two passes over anchors times blocks, the first only over own labels.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.llm.shared import written

#: Fewest and most rows of a block, blocks that are aimed at between, anchors of a pack, and scores made at a time.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, PACK, CELLS = 2048, 1 << 15, 64, 512, 1 << 21
#: Products that one float32 sum adds: 64 * 510**2 < 2**24.
CHUNK, LARGEST_PRIME = 64, 1021
PACKED = "dim int, block int, kind int, ids binary, labels binary, points binary, aux binary"


def primes(bound: int) -> list[int]:
    """Primes from LARGEST_PRIME downwards whose product is over 2 * bound, so that every |score| <= bound has residues of its own."""
    sieve = np.ones(LARGEST_PRIME + 1, bool)
    sieve[:2] = False
    for i in range(2, int(LARGEST_PRIME**0.5) + 1):
        sieve[i * i :: i] &= not sieve[i]
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out or [LARGEST_PRIME]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo an odd p between -(p - 1) / 2 and (p - 1) / 2."""
    half = (p - 1) // 2
    return np.mod(x + half, p) - half


class Residues:
    """A matrix of integers as one float32 matrix for each prime."""

    def __init__(self, points: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        self.parts = [balanced(points, p).astype(np.float32) for p in moduli]

    def rows(self, some: slice | np.ndarray) -> "Residues":
        out = object.__new__(Residues)
        out.moduli, out.parts = self.moduli, [x[some] for x in self.parts]
        return out

    def products(self, other: "Residues") -> np.ndarray:
        """Exact integer scores (own rows x other's rows)."""
        digits: list[np.ndarray] = []
        for p, a, b in zip(self.moduli, self.parts, other.parts, strict=True):
            total = np.zeros((len(a), len(b)), np.int64)
            for i in range(0, a.shape[1], CHUNK):
                total += (a[:, i : i + CHUNK] @ b[:, i : i + CHUNK].T).astype(np.int64)
            # the digit of p: what the lower digits leave, divided by the primes before
            left, place = balanced(total, p), 1
            for q, d in zip(self.moduli, digits, strict=False):
                left = balanced(left - d * place, p)
                place = place * q % p
            digits.append(balanced(left * pow(place, -1, p), p))
        out = digits[-1]
        for p, d in zip(self.moduli[-2::-1], digits[-2::-1], strict=True):
            out = out * p + d
        return out


def narrow(points: np.ndarray) -> bytes:
    """Integers in the smallest of 2, 4 or 8 bytes that holds them all; the first byte of the result tells which."""
    top = max(abs(int(points.min(initial=0))), abs(int(points.max(initial=0))))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + points.astype(kind).tobytes()


def widened(data: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[data[0]], offset=1).reshape(n, dim).astype(np.int64)


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, earlier places first on ties, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        some = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")]


def _pack(kind: int):
    def go(key: tuple, rows: pa.Table) -> pa.Table:
        dim, n = key[0].as_py(), rows.num_rows
        rows = rows.take(pa.compute.sort_indices(rows, [("label", "ascending"), ("vec_id", "ascending")]))
        points = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
        known: set[tuple] = set()  # rows that are alike have one hash, so they meet here
        key_of = ((label, id_, p.tobytes()) for label, id_, p in zip(rows["label"].to_pylist(), rows["vec_id"].to_pylist(), points, strict=True))
        single = [i for i, x in enumerate(key_of) if not (x in known or known.add(x))]
        rows, points = rows.take(single), points[single]
        ids, labels = (rows[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label"))
        aux = np.array([len(x) for x in rows["positives"].to_pylist()], np.int64).tobytes() + b"".join(np.array([(p["id"], p["score"]) for p in x], np.int64).tobytes() for x in rows["positives"].to_pylist()) if kind else b""
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "kind": pa.array([kind], pa.int32()), "ids": pa.array([ids], pa.binary()), "labels": pa.array([labels], pa.binary()), "points": pa.array([narrow(points)], pa.binary()), "aux": pa.array([aux], pa.binary())})

    return go


def _positives(row: dict, block: tuple, moduli: list[int], k: int) -> Iterator[tuple]:
    """(anchor, label, other, score): the first k rows of a block with an anchor's label."""
    ids, labels, own = block
    asked = Residues(row["points"], moduli)
    for label in np.unique(row["labels"]):
        a, z = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
        anchors = np.flatnonzero(row["labels"] == label)
        for i in range(0, len(anchors), step := max(1, CELLS // max(1, z - a))):
            some = anchors[i : i + step]
            for anchor, scores in zip(row["ids"][some].tolist(), asked.rows(some).products(own.rows(slice(a, z))), strict=True):
                other = np.flatnonzero(ids[a:z] != anchor)
                for j in other[first(scores[other], k)].tolist():
                    yield anchor, int(label), int(ids[a + j]), int(scores[j])


def _negatives(row: dict, block: tuple, moduli: list[int], k: int, low: int) -> Iterator[tuple]:
    """(anchor, label, positive, positive's score, other, score): the first k rows of a block with another label in each positive's window."""
    ids, labels, own = block
    by_id = np.argsort(ids, kind="stable")
    asked = Residues(row["points"], moduli)
    for i in range(0, len(row["ids"]), step := max(1, CELLS // len(ids))):
        for at, scores in zip(range(i, i + step), asked.rows(slice(i, i + step)).products(own), strict=False):
            label, found = int(row["labels"][at]), row["positives"][at]
            if not len(found):
                continue
            ends = [(-(-low * s // 100), s) for s in found[:, 1].tolist()]
            order = by_id[labels[by_id] != label]
            order = order[(scores[order] >= min(a for a, _ in ends)) & (scores[order] <= max(z for _, z in ends))]
            near = scores[order]
            for (positive, ps), (a, z) in zip(found.tolist(), ends, strict=True):
                within = np.flatnonzero((near >= a) & (near <= z))
                for j in within[first(near[within], k)].tolist():
                    yield int(row["ids"][at]), label, positive, ps, int(ids[order[j]]), int(near[j])


def _streamed(work: Callable, moduli: dict[int, list[int]], names: list[str]):
    """Runs work over each pack with its block: rows sorted by (dim, block, kind), the matrix first."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                points = widened(row["points"], row["dim"], len(ids))
                key = row["dim"], row["block"]
                if row["kind"] == 0:
                    open_, block = key, (ids, labels, Residues(points, moduli[row["dim"]]))
                elif key == open_:
                    aux = np.frombuffer(row["aux"], np.int64)
                    counts = aux[: len(ids)]
                    pairs = np.split(aux[len(ids) :].reshape(-1, 2), np.cumsum(counts)[:-1])
                    found = list(work({"ids": ids, "labels": labels, "points": points, "positives": pairs}, block, moduli[row["dim"]]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    return go


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id long, label long, vector array<long>).

    The positives of an anchor are the first rows of its label by score, ties to smaller ids. For each, the first rows of another label
    with low * positive_score <= 100 * score <= 100 * positive_score, so a positive with a score below 0 has none. Only vectors of one length meet. Rows with the
    anchor's own id are never its positives or negatives; rows that are alike in all columns count once, rows that share an id but
    differ are rows of their own, as anchors answered together. No rows, no anchors or one label only: no rows out. A possible score that 64 bits don't
    hold is an error.
    """
    rows = rows.select(F.size("vector").alias("dim"), "vec_id", F.col("label").cast("long").alias("label"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where("dim > 0")
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(20,0)"))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(most).alias("top"), F.max(F.when(F.col("anchor"), most)).alias("asked")).collect()
    moduli = {}
    for r in sizes:
        bound = r["dim"] * int(r["top"]) * int(r["asked"] or 0)
        if bound >= 1 << 63:
            raise OverflowError(f"scores may pass 64 bits: components of up to {r['top']} in {r['dim']} dimensions")
        moduli[r["dim"]] = primes(bound)
    n, asked = (max([0, *(r[c] for r in sizes)]) for c in ("n", "anchors"))
    blocks, packs = max(1, -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS))))), max(1, -(-asked // PACK))
    dealt = F.xxhash64("vec_id", "label", "vector")
    matrices = written(rows.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(_pack(0), PACKED))  # no positives are read
    anchors = rows.where("anchor").select("dim", F.pmod(dealt, F.lit(packs)).cast("int").alias("pack"), "vec_id", "label", "vector")
    none = F.array().cast("array<struct<id: long, score: long>>")

    def ask(anchors: DataFrame, work: Callable, names: list[str]) -> DataFrame:
        sent = anchors.groupBy("dim", "pack").applyInArrow(_pack(1), PACKED).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = matrices.unionByName(sent).repartition(max(blocks, len(sizes)), "dim", "block").sortWithinPartitions("dim", "block", "kind")
        return both.mapInArrow(_streamed(work, moduli, names), ", ".join(f"{c} long" for c in names))

    near = ask(anchors.withColumn("positives", none), lambda row, block, m: _positives(row, block, m, positives), ["anchor_id", "label", "positive_id", "positive_score"])
    best = W.partitionBy("anchor_id", "label").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    lists = near.groupBy("anchor_id", "label").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    told = anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "label"])
    names = ["anchor_id", "label", "positive_id", "positive_score", "negative_id", "negative_score"]
    far = ask(told, lambda row, block, m: _negatives(row, block, m, negatives, low), names).dropDuplicates(names)
    best = W.partitionBy("anchor_id", "label", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
