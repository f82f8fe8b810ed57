"""Phrase collocations: counting quotient filters of packed word-id n-grams, merged shard by shard.

1. Words are counted by language. Every (language, word) gets an id of B bits: the leading bits of its hash. Ids that two words would
   share, one of them frequent, are told apart by a short list (exceptions): frequent words get reserved ids, the others none. B follows
   from the number of words, so that the list stays short.
2. An n-gram of two or three words is packed from its ids, 0 for a missing third, into 3 * B bits, permuted by a Feistel network
   (which is invertible) and split in a shard (leading bits), a quotient and the full remainder. A counting quotient filter holds sorted
   n-grams: a bit for each quotient that occurs, a bit for each entry that ends its quotient's run, remainders in whole bytes,
   counts in one byte (larger ones aside). Nothing is lost: every n-gram can be read back with its exact count.
3. Tasks count their n-grams in sorted arrays and send one filter a shard; a shard's filters are merged like sorted lists. The number of shards follows
   from the number of words, so a merged filter stays small. N-grams of LEAST occurrences or more are read back.
4. The candidates, at most one in LEAST of all occurrences, are joined with the counts of their parts, scored in exact decimals, and ranked.

A word of fewer than LEAST occurrences is in no candidate; a bitmap of the frequent ids (of fixed size) leaves most n-grams with such
words out beforehand. Its false positives cost time only.
"""

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.llm.shared import discard, join_hot, written
from tallyspark.llm.words import SLICE_BYTES, Words, buffers, mix

LEAST, TOP = 10, 2000
#: Ids have between these many bits: 3 * 22 bits fill 64 at least, 3 * 42 are two halves of 63. About so many exceptions are expected at most.
FEWEST_BITS, MOST_BITS, EXCEPTIONS = 22, 42, 1 << 13
#: Bits of the bitmap of frequent ids (4 MB), in CHUNKS parts.
BITMAP, CHUNKS = 1 << 25, 128
#: N-grams counted at a time, entries a task holds before it sends its filters, occurrences a shard is meant for, shards and tasks at most.
BATCH, HELD, SHARD, MOST_SHARDS, TASKS = 1 << 19, 1 << 20, 1 << 21, 1 << 18, 1 << 12
SALTS, ROUNDS = 16, 4

# A piece ends at these bytes, words within it also at blanks and tabs.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(BREAKS)] = 0x20
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True


class Pieces:
    """Lower-cased words of some texts, their 64-bit hashes by language, and where pieces begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.words = Words(_PLAIN[raw], offsets, lower=True)
        breaks = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_BREAK[raw], out=breaks[1:])
        starts, ends = self.words.starts, self.words.ends
        self.begins = np.ones(len(starts) + 1, bool)
        self.begins[1:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
        self.begins[self.words.first] = True
        self.doc = self.words.doc()
        self.hashes = mix(self.words.hashes() ^ langs[self.doc])

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        starts, sizes = self.words.starts[at], self.words.ends[at] - self.words.starts[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = self.words.data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, list[str]]]:
    """(pieces, languages) of rows (lang, text), about SLICE_BYTES at a time."""
    names = batch.column(0).to_pylist()
    langs = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    data, offsets = buffers(batch.column(1))
    at = 0
    while at < len(names):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield Pieces(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], langs[at:to]), names[at:to]
        at = to


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, h, n), each word once a slice."""
    for batch in batches:
        for p, names in _pieces(batch):
            if len(p.hashes):
                h, at, n = np.unique(p.hashes, return_index=True, return_counts=True)
                lang = pa.array(names, pa.string()).take(pa.array(p.doc[at]))
                yield pa.RecordBatch.from_arrays([lang, p.texts(at), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "h", "n"])


# Ids


def id_bits(words: int, frequent: int) -> int:
    """Bits of an id, so that about EXCEPTIONS words share one with a frequent word."""
    return min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(1, 2 * words * max(1, frequent) / EXCEPTIONS)))))


def id_column(h: Column, bits: int) -> Column:
    """The id that goes with a hash. Ids below 2 ** (bits - 4) are reserved: 0 for no word, others for exceptions."""
    top = F.shiftrightunsigned(h, 64 - bits)
    return F.when(top < 1 << bits - 4, top + F.lit(1 << bits - 1)).otherwise(top)


def ids_of(h: np.ndarray, bits: int) -> np.ndarray:
    """id_column() of an array."""
    top = h >> np.uint64(64 - bits)
    return np.where(top < np.uint64(1 << bits - 4), top + np.uint64(1 << bits - 1), top)


class Ids:
    """Ids of the words of pieces; 0 for words that no candidate has."""

    def __init__(self, bits: int, exceptions: list[tuple[str, str, int, int]], bitmap: np.ndarray):
        """exceptions: (lang, word, shared id, own id or 0); bitmap: packed bits of the frequent ids modulo BITMAP."""
        self.bits, self.own = bits, {(x[0], x[1]): x[3] for x in exceptions}
        self.shared = np.unique(np.array([x[2] for x in exceptions], np.uint64))
        self.bitmap = bitmap

    def of(self, p: Pieces, names: list[str]) -> np.ndarray:
        ids = ids_of(p.hashes, self.bits)
        if len(self.shared) and len(ids):
            odd = np.flatnonzero(self.shared[np.minimum(np.searchsorted(self.shared, ids), len(self.shared) - 1)] == ids)
            _, at, back = np.unique(p.hashes[odd], return_index=True, return_inverse=True)
            if len(at):
                told = [self.own[names[d], w] for d, w in zip(p.doc[odd[at]].tolist(), p.texts(odd[at]).to_pylist(), strict=True)]
                ids[odd] = np.array(told, np.uint64)[back]
        place = (ids & np.uint64(BITMAP - 1)).astype(np.int64)
        known = self.bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1
        return ids * known


# N-grams: packed, permuted, counted


class Packing:
    """N-grams of three ids of some bits as permuted numbers of 2 * half bits: key, the leading 64, and tail, the rest."""

    def __init__(self, bits: int):
        self.bits, self.half = bits, (3 * bits + 1) // 2
        self.tail = 2 * self.half - 64
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x: np.ndarray, i: int) -> np.ndarray:
        return mix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) >> np.uint64(64 - self.half)

    def packed(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = np.uint64
        right = (a | b << u(self.bits)) & self.mask
        left = b >> u(self.half - self.bits) | c << u(2 * self.bits - self.half)
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(right, i)
        return left << u(64 - self.half) | right >> u(self.tail), right & u((1 << self.tail) - 1)

    def unpacked(self, key: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = np.uint64
        left, right = key >> u(64 - self.half), (key << u(self.tail) | tail) & self.mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ self._round(left, i), left
        low = 2 * self.bits - self.half
        return right & u((1 << self.bits) - 1), right >> u(self.bits) | (left & u((1 << low) - 1)) << u(self.half - self.bits), left >> u(low)


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted keys, tails, counts
EMPTY: Counts = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merged(*parts: Counts) -> Counts:
    """One sorted list of several lists (sorted or not), counts of equal n-grams added."""
    key, tail, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(key):
        return EMPTY
    order = np.argsort(key)
    key, tail = key[order], tail[order]
    same = key[1:] == key[:-1]
    if (same & (tail[1:] != tail[:-1])).any():  # n-grams with equal keys needn't stand together now
        again = np.lexsort((tail, key))
        key, tail, order = key[again], tail[again], order[again]
        same = (key[1:] == key[:-1]) & (tail[1:] == tail[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return key[first], tail[first], np.add.reduceat(n[order], first)


def _bytes_of(x: np.ndarray, bits: int) -> bytes:
    """The low bits of numbers in whole bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _numbers(data: bytes, bits: int, n: int) -> np.ndarray:
    out, wide = np.zeros((n, 8), np.uint8), -(-bits // 8)
    out[:, :wide] = np.frombuffer(data, np.uint8).reshape(n, wide)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def encoded(counts: Counts, shard_bits: int, tail_bits: int) -> bytes:
    """A counting quotient filter of sorted n-grams that share their leading shard_bits."""
    key, tail, n = counts
    q = max(1, len(key).bit_length() - 1)
    rest = 64 - shard_bits - q
    quotient = key << np.uint64(shard_bits) >> np.uint64(64 - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.ones(len(key), bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    large = n[n >= 255]
    parts = [np.packbits(occupied), np.packbits(ends), _bytes_of(key & np.uint64((1 << rest) - 1), rest), _bytes_of(tail, tail_bits), np.minimum(n, 255).astype(np.uint8), large.astype("<i8")]
    return struct.pack("<qbq", len(key), q, len(large)) + b"".join(bytes(x) for x in parts)


def decoded(data: bytes, shard: int, shard_bits: int, tail_bits: int) -> Counts:
    """The sorted n-grams of a filter and their counts."""
    m, q, large = struct.unpack_from("<qbq", data)
    rest, at = 64 - shard_bits - q, struct.calcsize("<qbq")

    def part(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    occupied = np.unpackbits(np.frombuffer(part(-(-(1 << q) // 8)), np.uint8))[: 1 << q]
    ends = np.unpackbits(np.frombuffer(part(-(-m // 8)), np.uint8))[:m].astype(np.int64)
    quotient = np.flatnonzero(occupied).astype(np.uint64)[np.cumsum(ends) - ends]
    low, tail = _numbers(part(m * -(-rest // 8)), rest, m), _numbers(part(m * -(-tail_bits // 8)), tail_bits, m)
    n = np.frombuffer(part(m), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(part(8 * large), "<i8")
    return np.uint64(shard) << np.uint64(64 - shard_bits) | quotient << np.uint64(rest) | low, tail, n


def _filters(ids: Broadcast, shard_bits: int):
    """Rows (shard, filter) of rows (lang, text): a task's counts of n-grams of two and three words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book: Ids = ids.value
        packing, held, open_, n = Packing(book.bits), EMPTY, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            edges = np.searchsorted(held[0], np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits))
            edges = np.append(edges, len(held[0]))
            full = np.flatnonzero(np.diff(edges))
            for i in range(0, len(full), 1 << 10):
                some = full[i : i + (1 << 10)]
                data = [encoded(tuple(x[edges[j] : edges[j + 1]] for x in held), shard_bits, packing.tail) for j in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["shard", "filter"])

        for batch in batches:
            for p, names in _pieces(batch):
                x = book.of(p, names)
                if len(x) < 2:
                    continue
                two = (x[:-1] > 0) & (x[1:] > 0) & ~p.begins[1:-1]
                i, j = np.flatnonzero(two), np.flatnonzero(two[:-1] & two[1:])
                nothing = np.zeros(len(i), np.uint64)
                key, tail = packing.packed(np.concatenate([x[i], x[j]]), np.concatenate([x[i + 1], x[j + 1]]), np.concatenate([nothing, x[j + 2]]))
                open_.append((key, tail, np.ones(len(key), np.int64)))
                n += len(key)
                if n >= BATCH:
                    held, open_, n = merged(held, *open_), [], 0
                    if len(held[0]) >= HELD:
                        yield from sent()
                        held = EMPTY
        held = merged(held, *open_)
        yield from sent()

    return go


def _merged(bits: int, shard_bits: int, least: int):
    """Rows (x, y, z, n) of rows (shard, filter) sorted by shard: the n-grams of at least so many occurrences; z is 0 for two words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing, open_, stack = Packing(bits), None, []

        def result() -> Iterator[pa.RecordBatch]:
            key, tail, n = merged(*stack)
            keep = n >= least
            ids = packing.unpacked(key[keep], tail[keep])
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in ids), pa.array(n[keep])], ["x", "y", "z", "n"])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != open_ and stack:
                    yield from result()
                    stack = []
                open_ = shard
                stack.append(decoded(data.as_py(), shard, shard_bits, packing.tail))
                while len(stack) > 1 and 2 * len(stack[-1][0]) >= len(stack[-2][0]):  # lists of like sizes, so that each entry is merged a few times only
                    stack[-2:] = [merged(*stack[-2:])]
        if stack:
            yield from result()

    return go


def _bits(key: tuple, rows: pa.Table) -> pa.Table:
    """One chunk of the bitmap."""
    bits = np.zeros(BITMAP // CHUNKS, np.uint8)
    bits[rows["place"].to_numpy() % len(bits)] = 1
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


# The whole


def frequent_words(vocabulary: DataFrame, least: int) -> tuple[DataFrame, Ids]:
    """((id, lang, word, n) of words of at least so many occurrences, the ids) of vocabulary(lang, word, h, n)."""
    spark = vocabulary.sparkSession
    size = vocabulary.agg(F.count("*").alias("words"), F.count(F.when(F.col("n") >= least, 1)).alias("frequent")).first()
    bits = id_bits(size["words"], size["frequent"])
    known = vocabulary.select("lang", "word", "n", id_column(F.col("h"), bits).alias("id"))
    shared = known.groupBy("id").agg(F.count("*").alias("words"), F.max("n").alias("most")).where((F.col("words") > 1) & (F.col("most") >= least)).select("id")
    odd = known.join(shared, "id").orderBy("lang", "word").collect()  # about EXCEPTIONS of them
    exceptions, own = [], 0
    for r in odd:
        own += r["n"] >= least
        exceptions.append((r["lang"], r["word"], r["id"], own if r["n"] >= least else 0))
    if own >= 1 << bits - 4:
        raise OverflowError("more words share ids than there are reserved ids")
    table = F.broadcast(spark.createDataFrame(exceptions, "lang string, word string, id long, own long").drop("id"))
    often = written(known.where(F.col("n") >= least).join(table, ["lang", "word"], "left").select(F.coalesce("own", "id").alias("id"), "lang", "word", "n"))
    place = often.select(F.expr(f"id & {BITMAP - 1}").alias("place")).distinct()
    chunks = place.withColumn("chunk", F.expr(f"place div {BITMAP // CHUNKS}")).groupBy("chunk").applyInArrow(_bits, "chunk long, bits binary").collect()
    bitmap = np.zeros((CHUNKS, BITMAP // CHUNKS // 8), np.uint8)
    for r in chunks:
        bitmap[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return often, Ids(bits, exceptions, bitmap.reshape(-1))


def _joined(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with few, which has each key once. Keys that very many rows have are dealt out."""
    return join_hot(rows, written(few.join(rows.groupBy(*keys).agg(F.count("*").alias("c")), keys)), keys)


def _div(x: Column, y: Column) -> Column:
    """The whole part of a quotient of two positive decimals."""
    return F.call_function("div", x, y)


def _scored(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the cut with the lowest score, the first on ties. A count has up to 14 digits, so products have 37 at most."""
    d = lambda c: F.col(c).cast("decimal(14,0)")
    score = lambda l, r: _div(d("a") * d("a") * F.lit(1_000_000).cast("decimal(7,0)"), d(l) * d(r))
    each = [F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    return rows.withColumn("cut", F.least(*each) if len(each) > 1 else each[0])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language of docs(text, lang).

    Lower-cased A-Z; pieces end at BREAKS, words at blanks and tabs too. a: occurrences of the phrase within pieces; l, r: those of the
    two parts of its lowest-scoring cut; n: words of the language; score: floor(1000000 * a * a / (l * r)). Phrases of fewer than `least`
    occurrences are left out, and pairs within a triple that has at least half of their occurrences. `top` of each language by score, then a, then
    phrase. A null text has no words, a null language is `und`; a language without such phrases has no rows. Repeated rows count as
    often as they stand there. Other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = written(rows.mapInArrow(_word_counts, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n")))
    words = vocabulary.agg(F.sum("n").alias("n")).first()["n"] or 0
    often, book = frequent_words(vocabulary, least)
    shard_bits = max(1, math.ceil(math.log2(max(1, min(MOST_SHARDS, 2 * words / SHARD)))))
    ids = spark.sparkContext.broadcast(book)
    filters = rows.mapInArrow(_filters(ids, shard_bits), "shard int, filter binary")
    sorted_ = filters.repartition(min(TASKS, 1 << shard_bits), "shard").sortWithinPartitions("shard")
    grams = written(sorted_.mapInArrow(_merged(book.bits, shard_bits, least), "x long, y long, z long, n long"))
    word = lambda key, *more: often.select(F.col("id").alias(key), F.col("word").alias(f"w{key}"), F.col("n").alias(f"f{key}"), *more)
    two = _joined(grams.where("z = 0").select("x", "y", F.col("n").alias("fxy")), word("x", "lang"), ["x"])
    two = written(_joined(two, word("y"), ["y"]))
    three = _joined(grams.where("z > 0"), two.select("x", "y", "lang", "wx", "wy", "fx", "fxy"), ["x", "y"])
    three = written(_joined(three, two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("wy").alias("wz"), F.col("fy").alias("fz"), F.col("fxy").alias("fyz")), ["y", "z"]))
    discard(grams)
    inside = three.select("n", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("p")).groupBy("p.x", "p.y").agg(F.max("n").alias("longer"))
    pairs = two.join(inside, ["x", "y"], "left").where("longer IS NULL OR 100 * longer < 50 * fxy")
    pairs = _scored(pairs.select("lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), F.col("fxy").alias("a"), "fx", "fy"), [("fx", "fy")])
    triples = _scored(three.select("lang", F.concat_ws(" ", "wx", "wy", "wz").alias("phrase"), F.col("n").alias("a"), "fx", "fyz", "fxy", "fz"), [("fx", "fyz"), ("fxy", "fz")])
    every = pairs.select("lang", "phrase", "a", "cut.*").unionByName(triples.select("lang", "phrase", "a", "cut.*"))
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    total = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
