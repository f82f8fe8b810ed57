"""Words of a column of texts as numpy arrays: positions, 64-bit hashes, hashes of runs of words.

A word is a run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D). All hashes
are Rabin-Karp polynomials modulo 2**64 (odd bases, so prefix sums can be shifted back by the
inverse), finished by a bijective mixer. They depend on the words alone, never on the process.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size at least; tables grow as needed, one of each base stays."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(1 << max(12, (size - 1).bit_length()), b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts. Word w is data[starts[w]:ends[w]]; text d has words first[d]:first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~_SPACE[self.data]
        left, right = np.empty_like(solid), np.empty_like(solid)
        left[1:], right[:-1] = solid[:-1], solid[1:]
        inner = offsets[offsets < len(data)]
        left[:1] = right[-1:] = False
        left[inner] = False
        right[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(solid & ~left)
        self.ends = np.flatnonzero(solid & ~right) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(BYTE_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def text(self, w: int) -> bytes:
        return self.data[self.starts[w] : self.ends[w]].tobytes()


def runs(hashes: np.ndarray, length: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """Rolling hash of every run of `length` hashes, by its first position."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: len(hashes) - length + 1])


def run_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a run of `length` words lies within one text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    base = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)
    return base + np.arange(counts.sum())


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) over a column, about `most` bytes at a time, so that arrays stay small."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to
