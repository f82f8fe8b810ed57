"""Removal of word passages that repeat an earlier document: Rabin-Karp hashes of every window of 50 words.

1. Every window gets a rolling hash. Neighbouring windows are told by their minimizer, the smallest hash among
   a window's runs of PROBE words: windows in a row with one minimizer make a group. Equal windows have equal minimizers, so
   groups whose minimizer occurs in one document only repeat nothing, and are dropped at once.
2. Groups with equal words (minimizer and hash of the whole span) repeat as one: all windows of a group
   that an earlier document has too are removals. Of groups with equal words the earliest stands for all.
3. Where a minimizer's groups differ in words, the windows of those that stand for others are counted one by one in Spark,
   by two 64-bit hashes: the smallest document id of each window, partial results first.
4. A document's removals merge into maximal intervals of words, which are cut from the whole text.

Windows are judged on the input. Rows are told apart by (doc_id, hash of the text), so repeated ids and rows are fine.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.shared import discard, join_hot, named, packed, trimmed, unpack, written
from tallyspark.llm.words import WORD_BASES, Words, buffers, mix, powers, run_starts, runs, slices

WINDOW, PROBE = 50, 8
KEY = ("doc_id", "t")


def window_minimizers(probes: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every `span` consecutive values, by doubling."""
    out, have = probes, 1
    while have * 2 <= span:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (span - have)], out[span - have :]) if span > have else out


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, minimizer, text index) of each window of each text."""
    h = words.hashes()
    at = run_starts(words.first, window)
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    probe = min(PROBE, window)
    low = window_minimizers(runs(h, probe), window - probe + 1)[at]
    return at, low, words.doc()[at]


def _groups(window: int):
    """Rows (doc_id, t, m, s, at, n): windows in a row with one minimizer, the hash of the words they span, first word, number."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in slices(batch.column(2)):
                at, low, doc = _windows(words, window)
                if not len(low):
                    continue
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                n = np.diff([*first, len(low)])
                starts, ends, doc, low = at[first], at[first] + n + window - 1, doc[first], low[first]
                h = words.hashes()
                up, down = powers(WORD_BASES[1], len(h) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
                span = mix((total[ends] - total[starts]) * down[starts] + n.astype(np.uint64))
                rows = pa.array(doc + a)
                local = (starts - words.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(low.view(np.int64)), pa.array(span.view(np.int64)), pa.array(local), pa.array(n.astype(np.int32))], [*KEY, "m", "s", "at", "n"])

    return go


def _candidates(window: int):
    """Rows (doc_id, t, at, h1, h2): the windows of a text's listed groups."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpack(batch.column(2))
            for a, b, words in slices(texts):
                h = words.hashes()
                hashes = [runs(h, window, base) for base in WORD_BASES]
                part = batch.slice(a, b - a)
                wanted, owner = [], []
                for d, groups in enumerate(part.column(3).to_pylist()):
                    for g in groups:
                        wanted.append(np.arange(g["at"], g["at"] + g["n"]) + words.first[d])
                        owner.append(np.full(g["n"], d))
                w, doc = np.concatenate(wanted), np.concatenate(owner)
                local = (w - words.first[doc]).astype(np.int32)
                one, two = (x[w].view(np.int64) for x in hashes)
                for i in range(0, len(w), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    rows = pa.array(doc[j])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(local[j]), pa.array(one[j]), pa.array(two[j])], [*KEY, "at", "h1", "h2"])

    return go


def merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of the union of intervals (any order)."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(lo, kind="stable"):
        if out and lo[i] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], int(hi[i])))
        else:
            out.append((int(lo[i]), int(hi[i])))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words in spans; what stands around the others stays as it is."""
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words.starts[a]])
        at = int(words.starts[b]) if b < len(words.starts) else len(text)
    return b"".join([*out, text[at:]])


def _kept(window: int, as_is: bool):
    """Applies removals: rows (doc_id, n_words, n_removed, kept, ...) of texts with their groups of repeated windows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                n_words, n_removed, kept = [], [], []
                data, offsets = buffers(unpack(part.column(1)))
                for d, groups in enumerate(part.column(2).to_pylist()):
                    raw = data[offsets[d] : offsets[d + 1]].tobytes()
                    words = raw.split()
                    n_words.append(len(words))
                    cut, spans = 0, []
                    if groups:
                        lo, n = np.array([(g["at"], g["n"]) for g in groups], np.int64).T
                        left, at = [], 0
                        spans = merge(lo, lo + n + window - 1)
                        for a, b in spans:
                            left += words[at:a]
                            cut += b - a
                            at = b
                        words = left + words[at:]
                    n_removed.append(cut)
                    kept.append((_cut(raw, spans) if as_is else b" ".join(words)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *part.columns[3:]], ["doc_id", "n_words", "n_removed", "kept", *part.schema.names[3:]])

    return go


def repeated_windows(docs: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, groups): groups (at, n) of n windows from word `at` on that also start in a document with a smaller id.

    docs(doc_id, t, text) with t a hash of the text; texts: the same rows, packed().
    """
    every = docs.mapInArrow(_groups(window), "doc_id long, t int, m long, s long, at int, n int")
    several_docs = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")]
    shared = written(every.groupBy("m").agg(*several_docs).where("lo < hi").select("m", "c"))
    groups = written(join_hot(every, shared, ["m"]))
    discard(shared)
    spans = written(groups.groupBy("m", "s").agg(*several_docs))
    whole = join_hot(groups, spans.where("lo < hi").select("m", "s", "lo", "c"), ["m", "s"]).where("lo < doc_id").select(*KEY, "at", "n")
    several = written(spans.groupBy("m").agg(F.count("*").alias("c"), F.min("lo").alias("a"), F.max("hi").alias("z")).where("c > 1 AND a < z").select("m", "c"))
    first = groups.join(join_hot(spans.select("m", "s", F.col("lo").alias("doc_id")), several, ["m"]), ["m", "s", "doc_id"], "left_semi")
    lists = first.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("groups"))
    again = texts.join(lists, list(KEY)).select(*KEY, "text", "groups")
    hashed = written(again.mapInArrow(_candidates(window), "doc_id long, t int, at int, h1 long, h2 long"))
    least = written(hashed.groupBy("h1", "h2").agg(*several_docs).where("lo < hi").select("h1", "h2", "lo", "c"))
    single = join_hot(hashed, least, ["h1", "h2"]).where("lo < doc_id").select(*KEY, "at", F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("groups"))


def _removed(docs: DataFrame, window: int, as_is: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, row): row holds all columns but the text, whatever they are called."""
    others = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.hash(text).alias("t"), text.alias("text"), F.struct(*map(named, others)).alias("row"))
    known = keyed.where("doc_id IS NOT NULL").select(*KEY, "text")
    found = repeated_windows(known, packed(known), window)
    joined = packed(keyed).join(found, list(KEY), "left").select("doc_id", "text", "groups", "row")
    new = [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))]
    return joined.mapInArrow(trimmed(_kept(window, as_is)), T.StructType([*new, keyed.schema["row"]]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, as_is: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *other columns): each text without its repeated passages.

    The kept words are joined by one space, in texts with nothing to remove too; with as_is, white space around kept
    words stays as it was. Null: no words. Texts of under `window` words keep all. A null id is
    neither smaller nor larger than another: such rows lose nothing and take nothing from others. Copies of one
    id are one document: they don't repeat each other. Other columns pass through, but for those called like the new ones.
    """
    new = ("doc_id", "n_words", "n_removed", "kept")
    others = [F.col("row")[c].alias(c) for c in docs.columns if c != "text" and c.lower() not in new]
    return _removed(docs, window, as_is).select(*new, *others)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with all their columns, whatever those are called, and with repeated passages cut from the text as it is; a null text becomes an empty one."""
    return _removed(docs, window, True).select(*(F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def digests(cut: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_repeats()."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
