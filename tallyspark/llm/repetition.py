"""Quality rules of repetition: how many characters of a text lie inside repeated word n-grams and lines.

Every text is cut into words; rolling hashes of all its windows of 5 to 10 words are made in numpy, slice by slice of a
column. A window that stands twice or more in a text covers its words, the first occurrence included; overlaps count once. A line that
stands twice or more covers its words likewise. The characters (code points of words) covered by each length, and
by lines, are held against limits in per cent: longer windows have lower limits, since a long repeat is the rarer accident.

All figures are of one text, so there is no shuffle, and a task holds one slice (or one text, if that is longer) at a time. Windows
and lines are told apart by 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.shared import named
from tallyspark.llm.words import BYTE_BASE, WORD_BASES, Words, mix, powers, run_starts, runs, slices

#: Per cent of word characters that windows of so many words may cover, and that lines may.
LIMITS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
LINE_LIMIT = 30
#: The base rules: fewest words, and the window and the per cent of words that repeated windows may hold.
LEAST_WORDS, BASE_WINDOW, BASE_LIMIT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", *(f"chars_{n}" for n in LIMITS))


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d + 1]] for each text d."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key stands twice or more with its owner, whether an equal one stands before it)."""
    told = mix(keys + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(told, kind="stable")
    same = told[order][1:] == told[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether each of n words lies in a window of `length` words that begins at one of starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first word, word after the last) of each line with a word. Lines end at line feeds and where texts end."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    ends[-1:] = len(data)
    closed = np.zeros(len(starts), bool)
    closed[np.searchsorted(starts, breaks, "right") - 1] = True
    a, z = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    keep = z > a
    starts, ends, closed, a, z = starts[keep], ends[keep], closed[keep], a[keep], z[keep]
    up, down = powers(BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    stop = ends - closed
    return np.searchsorted(offsets, starts, "right") - 1, mix((total[stop] - total[starts]) * down[starts]), a, z


def coverage(words: Words) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    data, first, n = words.data, words.first, len(words.starts)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[words.ends] - points[words.starts]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {"n_words": words.counts, "word_chars": _by_text(chars, first), "n_symbols": np.diff(symbols[words.offsets])}
    text, line, a, z = _lines(words)
    twice, later = repeated(line, text)
    edge = np.zeros(n + 1, np.int32)
    edge[a[twice]] += 1
    np.subtract.at(edge, z[twice], 1)
    out["n_dup_lines"] = np.bincount(text[later], minlength=len(words.counts))
    out["line_chars"] = _by_text(chars * (np.cumsum(edge[:-1]) > 0), first)
    h, doc = words.hashes(), words.doc()
    alive = np.ones(n, bool)  # where a window may repeat: only where the shorter one did
    for length in sorted({BASE_WINDOW, *LIMITS}):
        at = run_starts(first, length)
        at = at[alive[at]]
        at = at[repeated(runs(h, length, WORD_BASES[0])[at], doc[at])[0]]
        alive = np.zeros(n, bool)
        alive[at] = True
        inside = covered(at, length, n)
        if length == BASE_WINDOW:
            out["n_repeat_words"] = _by_text(inside, first)
        if length in LIMITS:
            out[f"chars_{length}"] = _by_text(chars * inside, first)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, *COUNTS) of rows (row, text)."""
    for batch in batches:
        for a, b, words in slices(batch.column(1)):
            found = coverage(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["row", *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, kept, *other columns but the text) of each row of docs(doc_id, text, ...).

    base_failed: fewer than LEAST_WORDS words, or more than BASE_LIMIT per cent of them in repeated windows of BASE_WINDOW words.
    kept: not so, and no length of LIMITS and no line covers more of the word characters than its limit. Null, empty and blank texts
    have no words: all counts are 0 and they fail the base rules. Repeated rows and null ids are rows like others. Columns that
    are called like new ones are replaced by these. No rows in, no rows out.
    """
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    kept_columns = [f for f in others if f.name.lower() not in {"doc_id", "text", "base_failed", "kept", *COUNTS}]
    row = F.struct(F.col("doc_id"), *(named(f.name).alias(f"c{i}") for i, f in enumerate(kept_columns)))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    found = rows.mapInArrow(_measured, schema)
    fails = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    within = 100 * F.col("line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, limit in LIMITS.items():
        within = within & (100 * F.col(f"chars_{n}") <= limit * F.col("word_chars"))
    passed = [F.col("row")[f"c{i}"].alias(f.name) for i, f in enumerate(kept_columns)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, fails.alias("base_failed"), (~fails & within).alias("kept"), *passed)
