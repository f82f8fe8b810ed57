"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are words, word pairs, triples of word shapes (runs of upper case, lower case, digits; punctuation as it
is) and equal neighbours, hashed into 2**BITS places. Each kind's counts are scaled to square length 1. FTRL-proximal
trains on the bounded sample of labels.training(), dealt by hash into parts of about PER_SHARD rows that learn apart; their
weights are averaged by their numbers of rows. The model is one array of 2**BITS weights; a score is a sparse dot product through the logistic curve.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.labels import TRAIN_ROWS, held_out, training
from tallyspark.llm.words import Words, mix, powers, runs, slices

BITS, PER_SHARD, EPOCHS = 17, 5000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
CUT = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def shapes(words: Words) -> np.ndarray:
    """One hash of each word's shape: its character classes with runs collapsed."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    cls = _CLASS[words.data]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[words.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    kept = cls[keep].astype(np.uint64) + np.uint64(1)
    up, down = powers(0xBF58476D1CE4E5B9, len(kept) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept * up[: len(kept)], dtype=np.uint64)])
    a, b = at[words.starts], at[words.ends]
    return mix((total[b] - total[a]) * down[a])


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text; place 0 is the bias."""
    h, s = words.hashes(), shapes(words)
    shift = np.uint64(64 - BITS)
    kinds = [mix(h ^ _SALTS[0]) >> shift, mix(runs(h, 2) ^ _SALTS[1]) >> shift, mix(runs(s, 3) ^ _SALTS[2]) >> shift, mix(s ^ _SALTS[3]) >> shift]
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        places, values = [np.zeros(1, np.int64)], [np.ones(1)]
        for kind, length in zip(kinds, (1, 2, 3, 1), strict=True):
            if b - a >= length:
                at, n = np.unique(kind[a : b - length + 1], return_counts=True)
                v = np.sqrt(n)
                places.append(at.astype(np.int64))
                values.append(v / np.sqrt((v * v).sum()))
        if b - a > 1:
            places.append(np.array([1, 2]))
            same = float((h[a + 1 : b] == h[a : b - 1]).mean())
            values.append(np.array([np.sqrt(same), np.log1p(b - a) / 10]))
        yield np.concatenate(places), np.concatenate(values)


class Ftrl:
    """FTRL-proximal with a learning rate per place."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)


def _train(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.take(pa.compute.sort_indices(rows, [("order", "ascending")]))
    texts, y = rows["text"].combine_chunks(), rows["y"].to_pylist()
    found = [f for _, _, words in slices(texts) for f in features(words)]
    model = Ftrl(1 << BITS)
    for epoch in range(EPOCHS):
        for i in range(len(y)) if epoch % 2 == 0 else reversed(range(len(y))):
            model.learn(*found[i], y[i])
    w = model.weights()
    at = np.flatnonzero(w)
    return pa.table({"place": pa.array(at, pa.int32()), "weight": pa.array(w[at] * len(y)), "rows": pa.array([len(y)] * len(at), pa.int64())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights by place. Without labelled rows all are 0, so that every score is 0.5."""
    rows = training(docs, labels, label, most)
    total = rows.count()
    shards = max(1, -(-total // PER_SHARD))
    rows = rows.withColumn("order", F.xxhash64("doc_id")).withColumn("shard", F.pmod("order", F.lit(shards)))
    parts = rows.groupBy("shard").applyInArrow(_train, "place int, weight double, rows long")
    found = parts.groupBy("place").agg(F.sum("weight").alias("w")).collect()  # 2**BITS rows at most
    out = np.zeros(1 << BITS)
    for r in found:
        out[r["place"]] = r["w"] / total
    return out


def _score(weights: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for a, b, words in slices(batch.column(1)):
                dots = np.array([w[at] @ x for at, x in features(words)])
                part = [c.slice(a, b - a) for c in (batch.column(0), batch.column(2))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], ["doc_id", "held_out", "score"])

    return go


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null texts score as empty ones. Only the text counts."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    out = rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
