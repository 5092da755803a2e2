"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors become integers, floor(256 x).  All rows are dealt into chunks and the
queries into blocks, both of a bounded size; each (chunk, block) pair is one
task that builds a cover tree over its data and one over its queries.  A node
of level l stands for points within 2^l of its centre, one of them.  Its
children, of the next lower level that splits it, have the same centre
(nesting) or points farther than their own level's distance from each other
(separation), and cover all its points.  Where that would take more children
than ``fan``, as in many dimensions, the node stays a leaf and its points are
compared as one matrix.  For a query node Q and a data node D no inner product
exceeds

    <q, d> + |q| r_D + |d| r_Q + r_Q r_D

(centres q, d, covering radii r), so the pair is pruned if that is below the
worst kth score of Q's queries.  Pairs with the largest bounds go first.  A
bounded sample of all rows, shared with every task, gives each query a first
kth score, so chunks prune from the start.  A window over each query's few
survivors of each chunk gives the answer; its ranks are limited before the
shuffle.

Scores are exact: rows whose components are so large that products of doubles
might round ("wide") are dealt apart, and their scores are products of whole
numbers of any length.

Defined cases: null vectors and those with null or non-finite components, or
whose 256-fold is not finite, take no part; vectors of different lengths are
not compared; a query's own row is no candidate, another row with its id is;
ties go to the smaller id, and repeated rows each have their place; a null id
is a candidate, after all others in ties, but no query; a score beyond a long
is given as the nearest long, in the place of its true value; empty vectors
score 0; no vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm import storage

CHUNK, BLOCK = 32_768, 2_048
#: Rows that give every query its first kth score.
SAMPLE = 1_024
LEAF = 64
SCALE = 256
_MOST = (1 << 63) - 1


def fan(n: int) -> int:
    """Most children that a node of n points may have."""
    return max(32, 2 * int(n**0.5))


class Node:
    """Points of a cover tree: ``level`` bounds their distance from the centre by 2^level, ``radius`` is the largest one."""

    __slots__ = ("at", "centre", "children", "level", "norm", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray, at: int, distance: np.ndarray) -> None:
        self.rows, self.at, self.children = rows, at, []
        self.centre = x[at]
        self.radius, self.norm = float(distance.max(initial=0.0)), float(np.sqrt((self.centre**2).sum()))
        self.level = math.frexp(self.radius)[1] if self.radius else -1075
        if len(rows) <= LEAF or not self.radius:
            return
        apart = 2.0 ** (self.level - 1)
        if self.radius <= apart:
            return
        # The node's own centre, then always the point that is farthest from all centres, until all are covered.
        centres, nearest, owner = [at], distance.copy(), np.zeros(len(rows), np.int64)
        most = fan(len(rows))
        while (far := int(nearest.argmax())) >= 0 and nearest[far] > apart:
            if len(centres) == most:
                return
            d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(1))
            closer = d < nearest
            owner[closer], nearest[closer] = len(centres), d[closer]
            centres.append(int(rows[far]))
        self.children = [Node(x, rows[own], c, nearest[own]) for k, c in enumerate(centres) if (own := owner == k).any()]


def tree(x: np.ndarray) -> Node:
    return Node(x, np.arange(len(x)), 0, np.sqrt(((x - x[0]) ** 2).sum(1)))


def bound(q: Node, d: Node) -> float:
    most = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return most + 1e-9 * (abs(most) + 1) + 1e-6


class Search:
    """Best k of each query among one chunk's rows."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.q, self.q_rows, self.d, self.d_rows, self.ids, self.k = queries, query_rows, data, data_rows, ids, k
        #: A score that k candidates are known to reach, for each query.
        self.floor = floor
        self.best: list[list[tuple[float, int, int]]] = [[] for _ in range(len(queries))]
        self.pairs = 0

    def run(self) -> list[list[tuple[float, int, int]]]:
        if len(self.q) and len(self.d):
            self._visit(tree(self.q), [tree(self.d)])
        return self.best

    def _worst(self, q: Node) -> float:
        return float(self.floor[q.rows].min())

    def _visit(self, q: Node, nodes: list[Node]) -> None:
        if q.children:
            finer = []
            for d in nodes:
                if bound(q, d) >= self._worst(q):
                    finer += d.children if d.children and d.radius > q.radius else [d]
            for child in q.children:
                self._visit(child, finer)
            return
        heap = [(-bound(q, d), k, d) for k, d in enumerate(nodes)]
        heapq.heapify(heap)
        count = len(heap)
        while heap and -heap[0][0] >= self._worst(q):
            d = heapq.heappop(heap)[2]
            if not d.children:
                self._compare(q.rows, d.rows)
            for child in d.children:
                count += 1
                heapq.heappush(heap, (-bound(q, child), count, child))

    def _compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        self.pairs += len(rows) * len(others)
        scores = self.q[rows] @ self.d[others].T
        scores[self.q_rows[rows][:, None] == self.d_rows[others][None, :]] = -np.inf
        for i, r in enumerate(rows.tolist()):
            near = np.flatnonzero(scores[i] >= max(self.floor[r], -1e300))
            if not len(near):
                continue
            own = self.best[r] + [(-float(scores[i, j]), int(self.ids[others[j]]), int(self.d_rows[others[j]])) for j in near.tolist()]
            own.sort()
            self.best[r] = own = own[: self.k]
            if len(own) == self.k:
                self.floor[r] = max(self.floor[r], -own[-1][0])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _first_floor(queries: np.ndarray, rows: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, k: int) -> np.ndarray:
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    scores = queries @ sample.T
    scores[rows[:, None] == sample_rows[None, :]] = -np.inf
    return np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k].copy()


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


def wide_best(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
    """The best k of each query by whole numbers of any length, a query at a time: (-score, id, row)."""
    dim = queries.shape[1]
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(dim, 1)
    kind = (lambda x: x.astype(np.int64)) if size < 2.0**62 and max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)) < 2.0**62 else _whole
    others, out = kind(data), []
    for q, row in zip(kind(queries), query_rows.tolist(), strict=True):
        scores = (others * q).sum(1).tolist() if dim else [0] * len(others)
        out.append(heapq.nsmallest(k, ((-s, i, r) for s, i, r in zip(scores, ids.tolist(), data_rows.tolist(), strict=True) if r != row)))
    return out


def _task(shared, k: int):
    def run(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        dim, wide = key[0].as_py(), key[1].as_py() or key[2].as_py()
        out = {"row": [], "query_id": [], "vec_id": [], "other": [], "score": []}
        if data.num_rows and queries.num_rows:
            d, q = _matrix(data["x"], dim), _matrix(queries["query"], dim)
            d_rows, q_rows = data["row"].to_numpy(), queries["query_row"].to_numpy()
            ids = data["vec_id"].fill_null(_MOST).to_numpy()
            unknown = set(d_rows[data["vec_id"].is_null().to_numpy()].tolist())
            if wide:
                answers = wide_best(q, q_rows, d, d_rows, ids, k)
            else:
                seed, seed_rows = shared.value.get(dim, (np.zeros((0, dim)), np.zeros(0, np.int64)))
                answers = Search(q, q_rows, d, d_rows, ids, k, _first_floor(q, q_rows, seed, seed_rows, k)).run()
            names = queries["query_id"].to_numpy()
            for i, found in enumerate(answers):
                for score, vec, row in found:
                    for name, value in zip(out, (int(q_rows[i]), int(names[i]), None if row in unknown else vec, row, -int(score)), strict=True):
                        out[name].append(value)
        decimal_score = pa.array([str(v) for v in out.pop("score")], pa.string())
        return pa.table({name: pa.array(v, pa.int64()) for name, v in out.items()} | {"score": decimal_score})

    return run


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, row, dim, x, wide: the usable vectors as whole numbers, with a number for each row; written once, so numbers stay.

    ``wide`` rows have components too large for sums of their products to be exact in doubles.
    """
    x = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & F.forall("x", finite))
    # floor() of a double is a long; a double of 2^52 or more is whole as it is.
    whole = F.transform("x", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(F.when(F.abs(x) < 2.0**52, x).otherwise(0.0)).cast("double")).otherwise(x))
    most = F.coalesce(F.array_max(F.transform("x", lambda x: F.abs(x))), F.lit(0.0))
    rows = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.size("x").alias("dim"), whole.alias("x"), (most * most * F.size("x") >= 2.0**52).alias("wide"))
    return storage.materialize(rows, "vectors")[0]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``queries`` (of vec_id) holds."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, key, vector)
    asked = rows.where(queries & F.col("vec_id").isNotNull())
    chunks, blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), CHUNK), (asked.count(), BLOCK)))
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.where("not wide").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "x", "row").collect():
        sample.setdefault(r["dim"], ([], []))[0].append(r["x"])
        sample[r["dim"]][1].append(r["row"])
    shared = spark.sparkContext.broadcast({d: (np.array(x, np.float64).reshape(len(x), d), np.array(n)) for d, (x, n) in sample.items()})
    number = lambda seed, n, of="row": F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    either = F.explode(F.array(F.lit(False), F.lit(True)))
    data = rows.withColumnRenamed("wide", "wide_data").withColumn("wide_query", either).withColumn("chunk", number(1, chunks)).withColumn("block", every(blocks))
    sought = asked.select("dim", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("x").alias("query"), F.col("wide").alias("wide_query"))
    sought = sought.withColumn("wide_data", either).withColumn("block", number(2, blocks, "query_row")).withColumn("chunk", every(chunks))
    if rows.where("wide").isEmpty():
        data, sought = data.where("not wide_query"), sought.where("not wide_data")
    keys = ("dim", "wide_data", "wide_query", "chunk", "block")
    found = data.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(_task(shared, k), "row bigint, query_id bigint, vec_id bigint, other bigint, score string")
    # Whole numbers of any length by sign, length and digits: the larger first.
    digits, below = F.regexp_replace("score", "^-", ""), F.startswith("score", F.lit("-"))
    found = found.withColumns({"below": below, "digits": digits, "size": F.when(below, F.length(digits)).otherwise(-F.length(digits))})
    found = found.withColumn("worth", F.when(F.col("below"), F.translate("digits", "0123456789", "9876543210")).otherwise(F.col("digits")))
    order = Window.partitionBy("row").orderBy("below", "size", F.desc("worth"), F.asc_nulls_last("vec_id"), "other")
    edge = F.when(F.col("below"), F.lit(-_MOST - 1)).otherwise(F.lit(_MOST))
    score = F.coalesce(F.expr("try_cast(score as bigint)"), edge)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
