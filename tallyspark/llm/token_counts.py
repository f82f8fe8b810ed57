"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens have byte spans, mapped to characters; its sections have
character spans. The two are interval-joined, and a token that crosses a boundary between sections goes
by an explicit rule:

* first: to the section that holds its first character (a token that starts in the middle of a
  character counts at that character),
* most: to the section that holds most of its characters, the earlier one on ties,
* share: to each section in proportion to its characters (fractions; a document's counts still add up).

Tokens outside every section are attributed to none.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import bpe, pieces_by_chunks, token_bytes

RULES = ("first", "most", "share")


def char_spans(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character (last exclusive) that each token touches."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return char[starts], char[ends - 1] + 1


def allocate(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> np.ndarray:
    """Tokens [first, last) of each section [lo, hi). Sections are disjoint and in order; spans are in order."""
    if rule == "first":
        return (np.searchsorted(first, hi) - np.searchsorted(first, lo)).astype(np.float64)
    out = np.zeros(len(lo))
    left = np.searchsorted(hi, first, "right")  # the first section that ends behind a token's start
    right = np.searchsorted(lo, last, "left") - 1  # the last that starts before its end
    inside = left == right
    np.add.at(out, left[inside & (first >= lo[np.minimum(left, len(lo) - 1)]) & (last <= hi[np.minimum(left, len(lo) - 1)])], 1.0)
    rest = np.flatnonzero((left <= right) & ~(inside & (first >= lo[np.minimum(left, len(lo) - 1)]) & (last <= hi[np.minimum(left, len(lo) - 1)])))
    for t in rest:
        s = np.arange(left[t], right[t] + 1)
        part = np.minimum(hi[s], last[t]) - np.maximum(lo[s], first[t])
        if rule == "share":
            out[s] += part / (last[t] - first[t])
        elif part.max() > 0:
            out[s[np.argmax(part)]] += 1.0
    return out


def line_spans(text: str) -> list[tuple[int, int]]:
    """Spans of a text's lines; a line feed belongs to the line it ends."""
    out, at = [], 0
    for line in text.split("\n"):
        to = min(at + len(line) + 1, len(text))
        if to > at:
            out.append((at, to))
        at = to
    return out


def _count(ranks_path: str, pattern: str, rule: str, split: Callable | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, sizes = bpe(ranks_path, pattern), token_bytes(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                spans = [split(t) for t in texts] if split else [[(s["start"], s["end"]) for s in x] for x in part.column(2).to_pylist()]
                cols = [[np.zeros(0, np.int64)] for _ in range(4)]
                owner, total = [], []
                for key, text, span in zip(keys, texts, spans, strict=True):
                    if not span:
                        continue
                    ids = np.array(vocab.encode_pieces(pieces_by_chunks(text, vocab)), np.int64)
                    lo, hi = np.array(span, np.int64).T
                    got = allocate(*char_spans(text, ids, sizes), lo, hi, rule)
                    for col, x in zip(cols, (np.arange(len(lo)), lo, hi, got), strict=True):
                        col.append(x)
                    owner += [key] * len(lo)
                    total += [len(ids)] * len(lo)
                section, lo, hi, got = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(section, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(got, pa.float64()), pa.array(total, pa.int64())], ["doc_id", "section", "char_start", "char_end", "tokens", "doc_tokens"])

    return go


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", split: Callable | None = line_spans) -> DataFrame:
    """(doc_id, section, char_start, char_end, tokens, doc_tokens) of docs(doc_id, text[, sections]).

    Sections come from `split` (text -> spans; lines by default) or, where that is None, from a column
    `sections`: array of struct(start, end), in characters. They are disjoint and in order, and numbered from 0.
    Documents whose text is null or empty, and those without sections, give no rows. Repeated rows stay.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs = docs.withColumn("text", F.col("text").cast("string")).where(F.length("text") > 0)
    docs = docs.select("doc_id", "text") if split else docs.where(F.size("sections") > 0).select("doc_id", "text", "sections")
    return docs.mapInArrow(_count(ranks_path, pattern, rule, split), "doc_id long, section int, char_start long, char_end long, tokens double, doc_tokens long")
