"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts are cut into chunks of CHUNK characters that overlap. Chunks are pre-tokenised on their own; texts of more than SPLIT
characters are dealt out in stretches of SPLIT, which overlap and meet alike, to tasks of their own. A chunk that starts inside a pre-token is out of step with the one before, until both
put a boundary at the same place of their overlap: from there on both see the same text and the pattern never looks back,
so there the later chunk takes over. The pieces between boundaries are encoded one by one;
decoding concatenates the ids' raw bytes. Where two chunks never meet in their overlap (a run without boundaries that is
longer than the overlap) the whole text is pre-tokenised in one go.

Ranks come from a file whose path is a parameter; executors read it by that path (it is part of the
installed tokenizer package) once per process.
"""

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import written

CHUNK, SPLIT, OVERLAP = 1024, 1 << 16, 96
#: Pieces that a process remembers with their ids at most, about 15 MB.
MEMO = 60_000


class Bpe:
    """One vocabulary: pieces to ids by its merge ranks, ids to bytes. Results of frequent pieces are remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.whole = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.raw = {i: b for b, i in self.ranks.items()}
        self.said = {i: str(i) for i in self.raw}
        self.memo: dict[str, list[int]] = {}

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pattern's matches, in order."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for p in pieces:
            ids = memo.get(p)
            if ids is None:
                ids = self.whole.encode_ordinary(p)
                if len(p) <= 32:
                    memo[p] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def line(self, ids: list[int]) -> bytes:
        return ",".join(map(self.said.__getitem__, ids)).encode()


@lru_cache(maxsize=4)
def bpe(ranks_path: str, pattern: str) -> Bpe:
    return Bpe(ranks_path, pattern)


def reliable(ends: list[int], start: int, size: int, is_last: bool) -> list[int]:
    """Boundaries of a chunk at `start` that the text behind the chunk can't change: those before its last two characters."""
    return [start + e for e in ends if is_last or e < size - 1]


def pieces_by_chunks(text: str, vocab: Bpe, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pattern's matches over a text, found chunk by chunk.

    A chunk's pieces hold up to the first boundary in its overlap that the next chunk has too. Where there is none the chunk is made twice as long.
    """
    n, find = len(text), vocab.pattern.findall
    out, at, start, size = [], 0, 0, chunk + overlap
    pieces = find(text[:size])
    while start + size < n:
        end = start + size
        after = end - overlap
        ends = list(accumulate(map(len, pieces), initial=start))
        if ends[-1] != end:  # a pattern whose matches leave something out
            return find(text)
        new = find(text[after : after + chunk + overlap])
        marks = set(accumulate(map(len, new), initial=after))
        to = next((e for e in ends[bisect_left(ends, max(after, at)) :] if e in marks and e < end - 1), None)
        if to is None:
            size *= 2
            pieces = find(text[start : start + size])
            continue
        out += pieces[bisect_left(ends, at) : bisect_left(ends, to)]
        at, start, size, pieces = to, after, chunk + overlap, new
    ends = list(accumulate(map(len, pieces), initial=start))
    return out + pieces[bisect_left(ends, at) :]


def _encode_short(ranks_path: str, pattern: str, chunk: int, overlap: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [vocab.encode_pieces(pieces_by_chunks(t, vocab, chunk, overlap)) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return go


def _boundaries(ranks_path: str, pattern: str, split: int, overlap: int):
    """Per stretch: boundaries inside the overlap at its head and at its tail (positions in the text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(ranks_path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(batch.num_rows)):
                start, n, text = part.column(1)[0].as_py(), part.column(2)[0].as_py(), part.column(3)[0].as_py()
                ends = reliable(vocab.boundaries(text), start, len(text), start + len(text) >= n)
                head = [e for e in ends if e <= start + overlap]
                tail = [e for e in ends if e >= start + split]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([head], pa.list_(pa.int32())), pa.array([tail], pa.list_(pa.int32()))], ["row", "start", "head", "tail"])

    return go


def _encode_spans(ranks_path: str, pattern: str):
    """Rows (row, start, text, from, to): the ids of text[from - start:to - start], whose ends are pre-token boundaries."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(ranks_path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(batch.num_rows)):
                start, text, a, b = (part.column(k)[0].as_py() for k in (1, 2, 3, 4))
                ids, at, span = [], a - start, b - start
                pieces = []
                for m in vocab.pattern.finditer(text, at):
                    if m.end() > span:
                        break
                    pieces.append(m.group())
                ids = vocab.encode_pieces(pieces)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([ids], pa.list_(pa.int32()))], ["row", "start", "ids"])

    return go


def encode(docs: DataFrame, ranks_path: str, pattern: str, split: int = SPLIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the token ids of each text, as encoding each match of `pattern` separately gives.

    Null and empty texts have no ids. Repeated rows stay. Texts of up to split + overlap characters are encoded in chunks where
    they are; longer ones are dealt out stretch by stretch. Neither size changes the ids.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= split + overlap).mapInArrow(_encode_short(ranks_path, pattern, chunk, overlap), "doc_id long, ids array<int>")
    long = docs.where(F.length("text") > split + overlap).withColumn("n", F.length("text")).withColumn("key", F.sha2("text", 256))
    # a repeated row encodes alike, so stretches are kept once per text and joined back by it
    keys = long.select("doc_id", "key")
    texts = long.dropDuplicates(["key"]).select(F.col("key").alias("row"), "n", "text")
    parts = texts.select("row", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(split))).alias("start"), "text")
    parts = parts.select("row", "start", "n", F.expr(f"substring(text, start + 1, {split + overlap})").alias("text"))
    parts = parts.repartition("row", "start")
    ends = parts.mapInArrow(_boundaries(ranks_path, pattern, split, overlap), "row string, start int, head array<int>, tail array<int>")
    here = ends.select("row", "start", "head")
    before = ends.select("row", (F.col("start") + split).alias("start"), "tail")
    meets = here.join(before, ["row", "start"], "left").select("row", "start", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.array_append("head", F.col("start")), "tail"))).alias("at"))
    meets = written(meets)
    lost = meets.groupBy("row").agg(F.bool_or(F.col("at").isNull()).alias("lost"))
    nexts = meets.select("row", (F.col("start") - split).alias("start"), F.col("at").alias("to"))
    spans = parts.join(meets, ["row", "start"]).join(nexts, ["row", "start"], "left").join(lost.where(~F.col("lost")), "row")
    spans = spans.select("row", "start", "text", "at", F.coalesce("to", "n").cast("int").alias("to"))
    coded = spans.mapInArrow(_encode_spans(ranks_path, pattern), "row string, start int, ids array<int>")
    joined = coded.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))
    together = keys.join(joined, keys["key"] == joined["row"]).select("doc_id", "ids")
    odd = long.join(lost.where("lost"), long["key"] == lost["row"]).select("doc_id", "text")
    odd = odd.mapInArrow(_encode_short(ranks_path, pattern, chunk, overlap), "doc_id long, ids array<int>")
    return short.unionByName(together).unionByName(odd)


def _decode(ranks_path: str, pattern: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [vocab.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return go


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of each row's ids, joined; null and empty lists give no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(ranks_path, pattern), "doc_id long, bytes binary")


def _digest(ranks_path: str, pattern: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                offsets, values = part.column(1).offsets.to_numpy(), part.column(1).values.to_numpy()
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    ids = values[a:b].tolist()
                    rows.append((len(ids), hashlib.sha256(vocab.line(ids)).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest()))
                n, one, two = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two), part.column(1)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return go


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of encoded rows: digests of the ids and of the bytes they decode to."""
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_digest(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def token_bytes(ranks_path: str, pattern: str) -> np.ndarray:
    """Bytes of each token, by id."""
    raw = bpe(ranks_path, pattern).raw
    out = np.zeros(max(raw) + 1, np.int64)
    for i, b in raw.items():
        out[i] = len(b)
    return out
