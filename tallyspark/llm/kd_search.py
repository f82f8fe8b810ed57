"""Exact top-k search by integer inner product: a KD-tree per shard, best-first traversal.

Rows are dealt by a hash into shards of about SHARD rows. Each shard becomes one KD-tree: median splits along the
widest side, tight bounding boxes, points kept as integers; the trees, points in their order and boxes, are a written table. Queries travel in blocks.
A box's bound for a query is the largest inner product any point in it could have; a traversal visits
boxes in the order of their bounds and stops at the first that is below the k-th score so far. Every block first asks its home
shard; the k-th scores found there go along to all other shards. A shard's tree and the blocks that ask it come to one task in a row, the tree once, and
the blocks stream through it. So a block meets every shard once: that is the cost of an exact answer, and grows with queries times shards.

How much the boxes prune depends on the data. Where few components tell points apart, most boxes fall below the k-th score. Of
vectors that spread evenly over 64 dimensions, as the given ones do, a box of some points reaches nearly as far as all of them: there every point is scored
(README has figures), and the traversal costs what a matrix product would, plus the boxes.

Ties go to the smaller id, so a box whose bound equals the k-th score is left out only if all its ids are larger.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyspark.llm.shared import written

SHARD, BLOCK, LEAF = 4096, 256, 32
EXACT = 1 << 53


class Tree:
    """Arrays of one KD-tree. Node i holds rows span[i, 0]:span[i, 1] of points; its children are child[i], -1 at a leaf."""

    ARRAYS = ("points", "ids", "span", "child", "low", "high", "smallest")

    def __init__(self, **arrays: np.ndarray):
        self.points, self.ids, self.span, self.child, self.low, self.high, self.smallest = (arrays[a] for a in self.ARRAYS)
        self.scored = 0  # points that searches have scored

    @classmethod
    def grown(cls, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> "Tree":
        order, span, child = np.arange(len(ids)), [(0, len(ids))], []
        low, high, smallest = [], [], []
        at = 0
        while at < len(span):
            a, b = span[at]
            own = points[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            smallest.append(ids[order[a:b]].min())
            wide = high[-1].astype(np.float64) - low[-1]
            side = int(np.argmax(wide)) if points.shape[1] else 0
            if b - a <= leaf or not points.shape[1] or high[-1][side] == low[-1][side]:
                child.append((-1, -1))
            else:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
                child.append((len(span), len(span) + 1))
                span += [(a, a + mid), (a + mid, b)]
            at += 1
        return cls(points=points[order], ids=ids[order], span=np.array(span), child=np.array(child), low=np.array(low), high=np.array(high), smallest=np.array(smallest))

    def pack(self) -> dict[str, bytes]:
        return {a: getattr(self, a).astype(np.int64).tobytes() for a in self.ARRAYS}

    @classmethod
    def unpack(cls, data: dict[str, bytes], dim: int) -> "Tree":
        wide = {"points": dim, "span": 2, "child": 2, "low": dim, "high": dim}
        n = {a: len(data["ids" if a == "points" else "smallest"]) // 8 for a in cls.ARRAYS}
        return cls(**{a: np.frombuffer(data[a], np.int64).reshape((n[a], wide[a]) if a in wide else -1) for a in cls.ARRAYS})

    def of(self, kind: type) -> "Tree":
        """The same tree with coordinates of another type."""
        return Tree(**{a: getattr(self, a).astype(kind) if a in ("points", "low", "high") else getattr(self, a) for a in self.ARRAYS})

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For each query its best (score, id) pairs, k at most, of those with a score of at least floors[q]."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q, query in enumerate(queries):
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
            bound, floor = bounds[q], floors[q]
            heap = [(-bound[0], 0)]
            while heap:
                top, i = heapq.heappop(heap)
                if -top < floor:
                    break
                if len(best) == k and (-top < best[0][0] or (-top == best[0][0] and self.smallest[i] > -best[0][1])):
                    continue
                if self.child[i, 0] >= 0:
                    for child in self.child[i].tolist():
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.span[i]
                scores, ids = self.points[a:b] @ query, self.ids[a:b]
                self.scored += int(b - a)
                keep = (scores >= floor) & (ids != query_ids[q])
                scores, ids = scores[keep], ids[keep]
                if len(scores) > k:
                    some = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[some], ids[some]
                for s, x in zip(scores.tolist(), ids.tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -x))
                    elif (s, -x) > best[0]:
                        heapq.heapreplace(best, (s, -x))
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield [(int(s), -x) for s, x in sorted(best, reverse=True)]


TREES = "dim int, shard int, points binary, ids binary, span binary, child binary, low binary, high binary, smallest binary"


def _tree(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per shard: its tree."""
    dim, n = key[0].as_py(), rows.num_rows
    rows = rows.take(pa.compute.sort_indices(rows, [("vec_id", "ascending")]))
    points = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
    tree = Tree.grown(points, rows["vec_id"].to_numpy().astype(np.int64)).pack()
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), **{a: pa.array([x], pa.binary()) for a, x in tree.items()}})


def _number(points: np.ndarray, others: np.ndarray) -> type:
    """float64 where every sum is exact, else int64, else Python's integers."""
    most = int(np.abs(points.astype(object) if points.size and points.min() == np.iinfo(np.int64).min else points).max(initial=0)) * int(np.abs(others).max(initial=0)) * max(1, points.shape[1])
    return np.float64 if most < EXACT else np.int64 if most < 1 << 63 else object


def _answers(k: int):
    """Answers (query_id, vec_id, score) of rows sorted by (dim, shard, kind): a tree (kind 0), then the blocks of queries that ask it. A score beyond 64 bits raises OverflowError."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, tree, own, kind = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                dim, shard = row["dim"].as_py(), row["shard"].as_py()
                if row["kind"].as_py() == 0:
                    open_, kind, tree = (dim, shard), None, Tree.unpack({a: row[a].as_py() for a in Tree.ARRAYS}, dim)
                    continue
                if (dim, shard) != open_:  # no points of this length in the shard
                    continue
                asked = row["queries"].as_py()
                queries = np.array([q["vector"] for q in asked], np.int64).reshape(-1, dim)
                ids = np.array([q["query_id"] for q in asked], np.int64)
                floors = np.array([-np.inf if q["kth"] is None else q["kth"] for q in asked])
                want = _number(tree.points, queries)
                if want is not kind:
                    kind, own = want, tree.of(want)
                found = own.search(queries.astype(want), ids, k, floors)
                flat = [(q, x, s) for q, best in zip(ids.tolist(), found, strict=True) for s, x in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else ([], [], []))], ["query_id", "vec_id", "score"])

    return go


def top_k(queries: DataFrame, points: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids.

    queries and points: (vec_id long, vector array<long>), without nulls. A query meets points of its own
    length, but none with its own id. Ids that repeat are told apart as points, and answered once as queries if their
    vectors are equal too. Fewer than k points: all of them. No queries or no points: no rows. A score that 64 bits don't hold is an error.
    """
    queries = queries.dropDuplicates(["vec_id", "vector"])
    n, m = points.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    dealt = points.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    trees = written(dealt.groupBy("dim", "shard").applyInArrow(_tree, TREES)).withColumn("kind", F.lit(0))
    asked = queries.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), "vector")
    home_of = F.pmod(F.col("block"), F.lit(shards)).cast("int")

    def ask(asked: DataFrame, where) -> DataFrame:
        packed = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vector", "kth")).alias("queries"))
        sent = packed.select("dim", F.explode(where).alias("shard"), F.lit(1).alias("kind"), "queries")
        both = trees.unionByName(sent, allowMissingColumns=True).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return both.mapInArrow(_answers(k), "query_id long, vec_id long, score long")

    home = written(ask(asked.withColumn("kth", F.lit(None).cast("long")), F.array(home_of)))
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("query_id", "kth")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home_of)
    found = home.unionByName(ask(asked.join(kth, "query_id", "left"), others)) if shards > 1 else home
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 1024, keep: tuple = ()) -> DataFrame:
    """(vec_id, vector, *keep): floor(scale * x) of each component as double; null and non-finite vectors and null ids are left out.

    A component that 64 bits don't hold is an error.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    beyond = F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")
    fits = lambda x: F.abs(x.cast("double") * scale) < F.lit(2.0**63)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.when(fits(x), F.floor(x.cast("double") * scale)).otherwise(beyond)).alias("vector"), *keep)
