"""N-gram Jaccard join: components of documents whose sets of word shingles are alike.

A document's point is its count vector: shingle hashes dealt into groups by their leading bits, the number of shingles in
each group. Two sets share at most the sum of the smaller counts, group by group. Two sets of sizes a and b
reach similarity 0.75 exactly if they share I shingles with 7 * I >= 3 * (a + b).

1. Documents with equal sets are one node (a 64-bit digest of the set), so copies never meet as pairs.
2. Shingles have one order for all sets: those that a sample of the documents finds common come last, otherwise by hash. Linked sets
   share a shingle that is among the first n / 7 of the smaller one and among the first n / 4 of the larger one (the prefix
   bound, true for any order). So sets meet by what is rare; members of a family whose own parts are large don't meet at all.
3. Sets that share such a shingle are one cell: that of the set, among those of the shingle and a class of size, which shares
   most with most others (in a family of copies the one nearest to all). Linked sets are of one class of size or of neighbouring ones.
4. In a cell the sets are compared with its centre first. Then the points of those that aren't joined yet are indexed in
   R-trees, class by class; a dual descent keeps pairs that the bound on boxes, then on points, then on finer points, allows, and whole
   sets decide. Pairs that are joined already are skipped, so a cell gives fewer links than it has sets, and they connect what
   all of its links connect.
5. Components of all links; their smallest doc_id goes to every row.

Cells of very many sets are split in parts, so that no tree holds more than about 2 * PART points or the points of 2 * PART_SHINGLES shingles. All
parts first meet the centre alone, whose text comes to each part once. Then only the sets that aren't joined to the centre are left to compare: with each
other, every two parts in a task of their own, and with the joined ones, which are known to be joined to each other. So a family around a
centre costs what its texts are, and only sets that share a rare shingle with it without resembling it meet by pairs of parts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.graph import components
from tallyspark.llm.shared import discard, fresh, named, packed, unpack, written
from tallyspark.llm.words import WORD_BASES, Words, mix, powers, runs, slices

SHINGLE = 5
PART, PART_SHINGLES = 4096, 1 << 22
LEAF, FAN = 32, 8
CLASS_BASE = 1.34  # sizes of linked sets differ by at most 4/3, so by at most one class
#: One text in SAMPLE tells what is common: shingles of SEEN texts of the sample, the COMMON most frequent at most (16 MB). It
#: decides the order of shingles only, so the result doesn't depend on it.
SAMPLE, SEEN, COMMON = 8, 3, 1 << 21


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words has one for its whole sequence."""
    h = words.hashes()
    every = runs(h, size)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield mix(runs(h[a:b], int(b - a), WORD_BASES[1]) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def prefix_sizes(n: int) -> tuple[int, int]:
    """So many first shingles hold one of any partner's that is no smaller, and of any partner's at all."""
    return n - (6 * n + 6) // 7 + 1, n - (3 * n + 3) // 4 + 1


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n / 4 shingles of a set (sorted hashes), those in common (sorted) last."""
    most = prefix_sizes(len(hashes))[1]
    if not len(common):
        return hashes[:most]
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    rare = hashes[~late][:most]
    return rare if len(rare) == most else np.concatenate([rare, hashes[late][: most - len(rare)]])


def group_bits(n: int) -> int:
    """About two groups a shingle, 16 to 4096 groups."""
    return int(min(12, max(4, np.ceil(np.log2(max(n, 1) * 1.5)))))


def point(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Count vector over 2**bits groups."""
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set (sorted hashes)."""
    up, _ = powers(WORD_BASES[1], len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = (hashes * up[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(CLASS_BASE))


def _nodes(size: int):
    """Rows (doc_id, node, n): node is null for empty sets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in slices(batch.column(1), lower=True):
                node, n = zip(*((digest(s), len(s)) if len(s) else (None, 0) for s in shingle_sets(words, size)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "node", "n"])

    return go


def _shingles(size: int):
    """Rows (h, node) of texts' whole sets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in slices(batch.column(0), lower=True):
                found = {digest(s): s for s in shingle_sets(words, size) if len(s)}
                if found:
                    node = np.repeat(np.array(list(found), np.int64), [len(s) for s in found.values()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(found.values())).view(np.int64)), pa.array(node)], ["h", "node"])

    return go


def common_shingles(docs: DataFrame, size: int = SHINGLE, sample: int = SAMPLE, most: int = COMMON) -> np.ndarray:
    """Sorted hashes of shingles that at least SEEN texts of one in `sample` have; the most frequent ones, `most` at most."""
    texts = docs.where(F.pmod(F.xxhash64(F.lit("order"), "text"), F.lit(sample)) == 0).select("text")
    counts = texts.mapInArrow(_shingles(size), "h long, node long").groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("z"))
    counts = written(counts.where((F.col("n") >= SEEN) & (F.col("a") < F.col("z"))).select("h", "n"))
    least, left = SEEN, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("hashes")).orderBy(F.desc("n")).collect():
        left += r["hashes"]
        if left > most:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).select("h").toArrow()["h"].to_numpy()
    discard(counts)
    return np.sort(found.view(np.uint64))


def _prefixes(size: int, common: Broadcast):
    """Rows (h, node) of texts' prefixes. The last 8 bits of h are a 0 where it is among the set's first n / 7, else a 1, and its class of size."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = common.value
        for batch in batches:
            for _, _, words in slices(batch.column(0), lower=True):
                nodes, parts = [], []
                for s in shingle_sets(words, size):
                    if len(s):
                        nodes.append(digest(s))
                        part = (prefix(s, late) & ~np.uint64(255)) | np.uint64(size_class(len(s)))
                        part[prefix_sizes(len(s))[0] :] |= np.uint64(128)
                        parts.append(part)
                if parts:
                    node = np.repeat(np.array(nodes, np.int64), [len(p) for p in parts])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(node)], ["h", "node"])

    return go


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, node) sorted by both, those whose shingle has two nodes at least, one of them among its first n / 7; once each.

    Rows (h, k, late, node), k the class. A run of one shingle may be longer than a batch; only its last row is kept.
    """
    last = None  # (h, class, late, node, told, whether its run counts) of the row before
    for batch in batches:
        raw, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(raw), bool)
        new[1:] = (raw[1:] != raw[:-1]) | (node[1:] != node[:-1])
        raw, node = raw[new], node[new]
        h, k, late = raw >> 8, raw & 127, raw >> 7 & 1
        if last and len(h) and (h[0], k[0], node[0]) == (last[0], last[1], last[3]):
            h, k, late, node = h[1:], k[1:], late[1:], node[1:]
        if not len(h):
            continue
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[0] = bool(last) and h[0] == last[0]
        first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(h))))
        counts = late[first] == 0
        if same[0]:
            counts[first == 0] = last[5]
        shown = (same[:-1] | same[1:]) & counts
        out = [(h[shown], k[shown], late[shown], node[shown])]
        if same[0] and last[5] and not last[4]:
            out.append(tuple(np.array([x]) for x in last[:4]))
        last = (h[-1], k[-1], late[-1], node[-1], shown[-1], counts[-1])
        h, k, late, node = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k.astype(np.int32)), pa.array(late.astype(np.int32)), pa.array(node)], ["h", "k", "late", "node"])


class RTree:
    """Points packed into leaves in the order of component, size and leading counts; nodes keep their box's upper corner, sizes and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        half = points[:, : max(1, points.shape[1] // 2)].sum(1, dtype=np.int64)
        self.order = np.lexsort((half, sizes, comps))
        self.points, self.sizes, self.comps = points[self.order], sizes[self.order], comps[self.order]
        self.levels = []
        at = np.arange(0, len(points), LEAF)
        rows = [(np.maximum, self.points), (np.minimum, self.sizes), (np.maximum, self.sizes), (np.minimum, self.comps), (np.maximum, self.comps)]
        self.levels.append(tuple(f.reduceat(x, at) for f, x in rows))
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            self.levels.append(tuple(f.reduceat(x, at) for (f, _), x in zip(rows, self.levels[-1], strict=True)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (into the points as given) of pairs of different components whose bound allows a link."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            box, low, high, c_low, c_high = self.levels[level]
            if c_low[i] == c_high[i] == c_low[j] == c_high[j]:
                continue
            if 4 * high[i] < 3 * low[j] or 4 * high[j] < 3 * low[i]:
                continue
            if 7 * np.minimum(box[i], box[j]).sum(dtype=np.int64) < 3 * (low[i] + low[j]):
                continue
            if level:
                n = len(self.levels[level - 1][0])
                for x in range(i * FAN, min(n, i * FAN + FAN)):
                    for y in range(max(x, j * FAN), min(n, j * FAN + FAN)):
                        stack.append((level - 1, x, y))
                continue
            a, b = np.arange(i * LEAF, min(len(self.sizes), i * LEAF + LEAF)), np.arange(j * LEAF, min(len(self.sizes), j * LEAF + LEAF))
            x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            keep = (self.comps[x] != self.comps[y]) & ((i != j) | (x < y)) & (4 * self.sizes[x] >= 3 * self.sizes[y]) & (4 * self.sizes[y] >= 3 * self.sizes[x])
            x, y = x[keep], y[keep]
            if len(x):
                keep = allowed(self.points, self.sizes, x, y)
                if keep.any():
                    yield self.order[x[keep]], self.order[y[keep]]


def allowed(points: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the summed smaller counts of pairs allow a link."""
    return 7 * np.minimum(points[x], points[y]).sum(1, dtype=np.int64) >= 3 * (sizes[x] + sizes[y])


class Cell:
    """Sets of one cell, joined to components as links are found."""

    def __init__(self, sizes: np.ndarray, late: np.ndarray, part: np.ndarray, sets: list[np.ndarray], same: bool, joined: np.ndarray | None = None):
        """joined: sets that are known to be joined to each other."""
        self.sizes, self.late, self.part, self.sets, self.same = sizes, late, part, sets, same
        self.comp = np.arange(len(sizes))
        if joined is not None and joined.any():
            self.comp[joined] = np.flatnonzero(joined)[0]
        self.links: list[tuple[int, int]] = []

    def may_meet(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs whose smaller set has one of its first n / 7 shingles here; with `same` false only those of different parts."""
        a, b = self.sizes[x], self.sizes[y]
        meet = ((a <= b) & ~self.late[x]) | ((b <= a) & ~self.late[y])
        return meet & ((self.part[x] != self.part[y]) | self.same)

    def verify(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            if self.comp[x] == self.comp[y]:
                continue
            one, two = self.sets[x], self.sets[y]
            shared = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
            if 7 * shared >= 3 * int(self.sizes[x] + self.sizes[y]):
                self.comp[self.comp == self.comp[y]] = self.comp[x]
                self.links.append((x, y))

    def solve(self, centre: int | None) -> list[tuple[int, int]]:
        if centre is not None:
            others = np.delete(np.arange(len(self.sizes)), centre)
            near = (4 * self.sizes[others] >= 3 * self.sizes[centre]) & (4 * self.sizes[centre] >= 3 * self.sizes[others])
            others = others[near & self.may_meet(np.full(len(others), centre), others)]
            self.verify(np.full(len(others), centre), others)
        k = np.array([size_class(x) for x in self.sizes])
        for c in np.unique(k):
            at = np.flatnonzero((k == c) | (k == c + 1))
            if len(at) < 2 or not (k[at] == c).any() or (self.comp[at] == self.comp[at[0]]).all():
                continue
            bits = group_bits(int(self.sizes[at].min()))
            kind = np.uint16 if self.sizes[at].max() < 1 << 16 else np.uint32
            fine = np.stack([point(self.sets[i], bits).astype(kind) for i in at])
            if fine.max() < 1 << 8:
                fine = fine.astype(np.uint8)
            few = min(3, bits - 4)
            coarse = fine.reshape(len(at), -1, 1 << few).sum(2, dtype=np.uint32)
            for x, y in RTree(coarse, self.sizes[at], self.comp[at]).pairs():
                keep = ((k[at[x]] == c) | (k[at[y]] == c)) & (self.comp[at[x]] != self.comp[at[y]]) & self.may_meet(at[x], at[y])
                x, y = x[keep], y[keep]
                keep = allowed(fine, self.sizes[at], x, y)
                self.verify(at[x[keep]], at[y[keep]])
        return self.links


def _cell_links(size: int):
    """Links of each cell of rows (a, i, j, part, node, late, joined, text), sorted by (a, i, j), with packed texts. Joined sets are the centre's.

    Sets are made again from the texts, which are smaller than their hashes. Rows whose text isn't the node's (of a repeated id) are passed over.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows, found = None, {}, []

        def solve() -> None:
            if len(rows) > 1:
                part, late, joined, sets = zip(*rows.values(), strict=True)
                node = list(rows)
                cell = Cell(np.array([len(s) for s in sets], np.int64), np.array(late, bool), np.array(part), list(sets), open_[1] == open_[2], np.array(joined, bool))
                centre = node.index(open_[0]) if open_[0] in rows and not any(joined) else None
                found.extend((node[x], node[y]) for x, y in cell.solve(centre))
            rows.clear()

        def flush() -> pa.RecordBatch:
            a, b = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [c.to_pylist() for c in part.columns[:7]]
                sets = (s for _, _, words in slices(unpack(part.column(7)), lower=True) for s in shingle_sets(words, size))
                for cell, (p, node, late, joined), s in zip(zip(*cols[:3], strict=True), zip(*cols[3:], strict=True), sets, strict=True):
                    if cell != open_:
                        solve()
                        open_ = cell
                    if len(s) and digest(s) == node:
                        rows[node] = (p, late, joined, s)
                if len(found) > 1 << 14:
                    yield flush()
        solve()
        if found:
            yield flush()

    return go


def _centre_links(size: int):
    """Links (a, b) of centres with the sets of rows (a, part, role, node, late, text), sorted by (a, part, role); role 0 is the centre."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, centre = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found = batch.slice(at, 256), []
                cols = [c.to_pylist() for c in part.columns[:5]]
                sets = (s for _, _, words in slices(unpack(part.column(5)), lower=True) for s in shingle_sets(words, size))
                for a, p, role, node, late, s in zip(*cols, sets, strict=True):
                    if not len(s) or digest(s) != node:
                        continue
                    if role == 0:
                        open_, centre = (a, p), (late, s)
                    elif (a, p) == open_ and node != a:
                        cell = Cell(np.array([len(centre[1]), len(s)]), np.array([centre[0], late], bool), np.zeros(2, int), [centre[1], s], True)
                        one, two = np.array([0]), np.array([1])
                        if 4 * len(s) >= 3 * len(centre[1]) and 4 * len(centre[1]) >= 3 * len(s) and cell.may_meet(one, two).all():
                            cell.verify(one, two)
                        found += [(a, node)] * len(cell.links)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return go


def _split(cells: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(links of centres, rows (a, i, j, part, node, late, joined, text)) of cells of more than one part: cells(a, node, late, parts), texts(node, text) packed."""
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = cells.where("node <> a").select("a", part(F.col("parts")).alias("part"), F.lit(1).alias("role"), "node", "late")
    centres = cells.where("node = a").select("a", each(F.col("parts")).alias("part"), F.lit(0).alias("role"), "node", "late")
    met = members.unionByName(centres).join(texts, "node").select("a", "part", "role", "node", "late", "text")
    star = written(met.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_centre_links(size), "a long, b long"))
    linked = cells.join(star.select("a", F.col("b").alias("node"), F.lit(True).alias("joined")), ["a", "node"], "left").withColumn("joined", F.coalesce("joined", F.col("node") == F.col("a")))
    n = linked.groupBy("a").agg(F.count(F.when(~F.col("joined"), 1)).alias("open"), F.count(F.when(F.col("joined"), 1)).alias("done"), F.max("parts").alias("parts"), F.count("*").alias("n"))
    share = lambda c: F.ceil(F.col("parts") * F.col(c) / F.col("n")).cast("int")
    n = n.where("open > 0").select("a", share("open").alias("ro"), share("done").alias("rd"))
    rows = linked.drop("parts").join(n, "a")
    # parts of open sets are 0 to ro - 1, those of joined ones ro to ro + rd - 1
    open_ = rows.where("NOT joined").withColumn("part", part(F.col("ro"))).withColumn("other", each(F.col("ro") + F.col("rd")))
    open_ = open_.select("a", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "late", "joined")
    done = rows.where("joined").withColumn("part", F.col("ro") + part(F.col("rd"))).withColumn("i", each(F.col("ro")))
    done = done.select("a", "i", F.col("part").alias("j"), "part", "node", "late", "joined")
    return star, open_.unionByName(done).join(texts, "node").select("a", "i", "j", "part", "node", "late", "joined", "text")


def _cells(shared: DataFrame) -> DataFrame:
    """(a, node, late, k): the cells of centres a with their nodes, a itself too; late: none of the node's first n / 7 shingles is here."""
    members = written(shared.join(shared.groupBy("h").agg(F.count("*").alias("rows")), "h"))
    share = F.sum("rows") / F.pow(F.lit(CLASS_BASE), F.first("k"))
    best = members.join(members.groupBy("node").agg(share.alias("share")), "node").groupBy("h", "k").agg(F.max(F.struct("share", "node"))["node"].alias("a"))
    near = best.withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    cells = written(members.join(near, ["h", "k"]).groupBy("a", "node").agg(F.min("late").alias("late"), F.first("k").alias("k")))
    discard(members)
    return cells


def links(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows(doc_id, node, n) of every document, and links(a, b) between nodes.

    The links are real ones and connect what all links connect, but not every link within a component is listed.
    Rows with a null id take no part in links.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(docs.mapInArrow(_nodes(size), "doc_id long, node long, n long"))
    docs = docs.where("doc_id IS NOT NULL")
    known = rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    prefixes = docs.select("text").mapInArrow(_prefixes(size, common), "h long, node long")
    runs_ = prefixes.repartition(F.shiftright("h", 8)).sortWithinPartitions("h", "node")
    shared = written(runs_.mapInArrow(_shared_runs, "h long, k int, late int, node long"))
    cells = _cells(shared)
    parts = cells.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(CLASS_BASE), F.col("k") + 1)).alias("shingles")).where("n > 1")
    parts = parts.select("a", F.ceil(F.greatest(F.col("n") / PART, F.col("shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    cells_ = cells.join(parts, "a")
    first = known.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    zero = F.lit(0)
    sent = cells_.where("parts = 1").join(first, "node").select("doc_id", "a", zero.alias("i"), zero.alias("j"), zero.alias("part"), "node", "late", F.lit(False).alias("joined"))
    sent = packed(docs).join(sent, "doc_id").select("a", "i", "j", "part", "node", "late", "joined", "text")
    large, star = written(cells_.where("parts > 1").select("a", "node", "late", "parts")), None
    if not large.isEmpty():
        wanted = first.join(large.select("node").distinct(), "node")
        texts = packed(docs).join(wanted, "doc_id").select("node", "text")
        star, more = _split(large, written(texts.dropDuplicates()), size)
        sent = sent.unionByName(more)
    found = written(sent.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j").mapInArrow(_cell_links(size), "a long, b long"))
    if star is not None:
        found = found.unionByName(star)
    discard(shared, cells)
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same = known.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    return rows, found.unionByName(same)


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id reachable by links, itself included.

    Null, blank and empty texts have no shingles and stand alone. Equal texts are one component, and so are the texts of rows
    that share an id. A row with a null id has a null component. Empty table: no rows.
    """
    rows, found = links(docs, size)
    first = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    ends = [first.select(F.col("node").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b")]
    roots = components(found.join(ends[0], "a").join(ends[1], "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
    least = first.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("node", F.coalesce("root", "first").alias("least"))
    out = rows.join(least, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The document of each component with the smallest id, with all columns.

    Of rows that share that id the first by their columns' values stays. Rows with a null id all stay.
    """
    rows, row = fresh(docs, "rows"), fresh(docs, "row")
    ids = classes(docs, size).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias(rows))
    kept = docs.join(ids, "doc_id")
    single = kept.where(F.col(rows) == 1).select(*map(named, docs.columns))
    several = kept.where(F.col(rows) > 1).groupBy("doc_id").agg(F.min(F.struct(*(named(c) for c in docs.columns if c != "doc_id"))).alias(row))
    several = several.select(*(F.col("doc_id") if c == "doc_id" else F.col(row)[c].alias(c) for c in docs.columns))
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL"))
