"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, by k-means fitted on a bounded sample of rows; a cell
is a pair of centroids, and every row is in one. A query takes the cells in order of summed inner products
of its halves with the two centroids, by a heap over the two sorted lists, until those cells hold
``budget`` rows. As that order goes by the sum, what it took is all cells down to the last sum, which is
all that a query carries to the rows. Their entries are then scored exactly.

The budget is fitted too: for a bounded sample of queries the exact neighbours are found by brute force over
all rows, and the budget is how many rows the traversal reads until it has met ``goal`` of them.

Rows lie in blocks of about ``BLOCK`` (whole groups of first centroids; larger groups are salted). A query goes
once to every block that holds a cell which it took; a task holds one block, by cell, and streams the queries
through it in batches, scoring of each cell only the queries that took it. So the rows scored are those of the
budget, nothing is copied for each batch of queries, and a meeting gives at most ``k`` rows a query.

On vectors without clusters the fitted budget is a fixed part of all rows, and cost then grows with queries times rows.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, as query or
candidate, and neither do those of another length than most (of equally frequent lengths, the larger counts). Ties
go to the smaller vec_id. Rows with a query's vec_id are its own and not its candidates; of repeated queries with
one vec_id the vector of the least hash asks. With fewer candidates than ``k`` all of them are returned; an empty
table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, tune

CENTROIDS, SAMPLE, TRIED, BLOCK = 64, 16_000, 60, 32_768


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    e = F.col("embedding")
    whole = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.where(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)


class MultiIndex:
    """Centroids of both halves, and how many rows each cell has."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts = np.zeros((len(first), len(second)), np.int64)
        self.budget = 0

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.first.shape[1]], v[:, self.first.shape[1] :]

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(v)
        return nearest(a, self.first), nearest(b, self.second)

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(q)
        return a @ self.first.T, b @ self.second.T

    def reach(self, s1: np.ndarray, s2: np.ndarray, budget: int) -> float:
        """Multi-sequence traversal of one query: the sum of the last cell that it takes."""
        o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
        a, b, counts = s1[o1].tolist(), s2[o2].tolist(), self.counts[o1][:, o2].tolist()
        heap, taken, last, done = [(-(a[0] + b[0]), 0, 0)], 0, 0.0, [0] * (len(a) + 1)
        while heap and taken < budget:
            cost, i, j = heapq.heappop(heap)
            last = -cost
            taken += counts[i][j]
            done[i] = j + 1  # cells taken in row i are its first ones
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if i + 1 < len(a) and done[i + 1] == j:
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
        return last if taken >= budget else -np.inf


class Block:
    """Rows of some cells, ordered by cell."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, c1: np.ndarray, c2: np.ndarray):
        by = np.lexsort((ids, c2, c1))
        self.ids, self.v = ids[by], v[by]
        c1, c2 = c1[by], c2[by]
        self.begins = np.flatnonzero(np.concatenate([[True], (np.diff(c1) != 0) | (np.diff(c2) != 0)])) if len(by) else np.zeros(0, np.int64)
        self.ends = np.concatenate([self.begins[1:], [len(by)]]) if len(by) else self.begins
        self.c1, self.c2 = c1[self.begins], c2[self.begins]
        self.scored = 0  # products taken so far

    def best(self, q_id: np.ndarray, q: np.ndarray, reach: np.ndarray, index: MultiIndex, k: int):
        """(query, vector, score) of the best ``k`` rows for each query, of the cells that it took."""
        out: tuple[list, list, list] = [], [], []
        s1, s2 = index.sums(q)
        for i in range(0, len(q), 64):
            part = slice(i, i + 64)
            took = s1[part][:, self.c1] + s2[part][:, self.c2] >= reach[part, None] - 1e-12
            # Of each query only the rows of the cells that it took, end to end.
            pieces: list[list[np.ndarray]] = [[] for _ in took]
            for j in np.flatnonzero(took.any(0)).tolist():
                asks = np.flatnonzero(took[:, j])
                for a, s in zip(asks.tolist(), q[part][asks] @ self.v[self.begins[j] : self.ends[j]].T, strict=True):
                    pieces[a].append(s)
            size = self.ends - self.begins
            for a, own in enumerate(pieces):
                if not own:
                    continue
                cells = np.flatnonzero(took[a])
                rough, n = np.concatenate(own), size[cells]
                self.scored += len(rough)
                rows = np.repeat(self.begins[cells] - np.cumsum(n) + n, n) + np.arange(len(rough))
                rough[self.ids[rows] == q_id[i + a]] = -np.inf
                m = min(k, len(rough))
                bound = np.partition(rough, len(rough) - m)[len(rough) - m]
                ys = rows[(rough > -np.inf) & (rough >= bound - 1e-9)]
                for j in range(0, len(ys), 1 << 17):  # scored one by one, so that equal vectors score alike
                    y = ys[j : j + (1 << 17)]
                    out[0].append(np.full(len(y), i + a)), out[1].append(y), out[2].append((q[i + a] * self.v[y]).sum(1))
        if not out[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        x, y, s = map(np.concatenate, out)
        by = np.lexsort((self.ids[y], -s, x))
        x, y, s = x[by], y[by], s[by]
        begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        turn = np.arange(len(x)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(x)]])))
        best = turn < k
        return q_id[x[best]], self.ids[y[best]], s[best]


def build(rows: DataFrame, queries: DataFrame, k: int, goal: float) -> tuple[MultiIndex, DataFrame]:
    """The fitted index, and every row with its cell: vec_id, v, c1, c2."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(SAMPLE).toArrow().combine_chunks()
    x = matrix(sample.column("v").combine_chunks()) if n else np.zeros((1, 2))
    half, size = x.shape[1] // 2, max(1, min(CENTROIDS, len(x) // 8))
    index = MultiIndex(k_means(x[:, :half], size), k_means(x[:, half:], size, seed=1))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            c1, c2 = shared.value.cells(matrix(b.column(1))) if len(b) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["vec_id", "v", "c1", "c2"])

    put = cut(rows.mapInArrow(assign, "vec_id long, v array<double>, c1 int, c2 int"))
    for r in put.groupBy("c1", "c2").count().collect():  # at most CENTROIDS squared rows
        index.counts[r["c1"], r["c2"]] = r["count"]
    tried = queries.orderBy(F.xxhash64("vec_id", F.lit(2))).limit(TRIED).toArrow()
    if not len(tried):
        return index, put
    q_id, q = tried.column("vec_id").to_numpy(), matrix(tried.column("v").combine_chunks())
    trial = rows.sparkSession.sparkContext.broadcast((q_id, q))

    def exact(batches):
        ids, qs = trial.value
        for b in batches:
            if len(b):
                own, c1, c2 = (b.column(i).to_numpy() for i in (0, 2, 3))
                who, which, score = Block(own, matrix(b.column(1)), c1, c2).best(ids, qs, np.full(len(ids), -np.inf), shared.value, k)
                by = np.argsort(own, kind="stable")
                row = by[np.searchsorted(own[by], which)]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(which), pa.array(score), pa.array(c1[row]), pa.array(c2[row])], ["q", "vec_id", "score", "c1", "c2"])

    found = put.mapInArrow(exact, "q long, vec_id long, score double, c1 int, c2 int")
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("t", turn).where(F.col("t") <= k).toArrow()
    s1, s2 = index.sums(q)
    at, need = {x: i for i, x in enumerate(q_id.tolist())}, []
    order = [np.argsort(-(a[:, None] + b).ravel(), kind="stable") for a, b in zip(s1, s2, strict=True)]
    read = [np.empty(len(o), np.int64) for o in order]
    for r, o in zip(read, order, strict=True):
        r[o] = np.cumsum(index.counts.ravel()[o])
    for who, c1, c2 in zip(*(found.column(c).to_pylist() for c in ("q", "c1", "c2")), strict=True):
        need.append(int(read[at[who]][c1 * len(index.second) + c2]))
    index.budget = int(np.quantile(need, goal, method="higher")) if need else n
    return index, put


def search(embeddings: DataFrame, every: int = 20, k: int = 20, goal: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found nearest of each row whose vec_id ``every`` divides."""
    tune(embeddings.sparkSession)
    rows = usable(embeddings)
    is_query = F.col("vec_id") % every == 0
    index, put = build(rows, rows.where(is_query), k, goal)
    groups = max(1, min(len(index.first), -(-int(index.counts.sum()) // BLOCK)))
    salts = [max(1, -(-int(index.counts[g::groups].sum()) // BLOCK)) for g in range(groups)]
    first = np.cumsum([0, *salts])  # the number of a group's first block
    shared = rows.sparkSession.sparkContext.broadcast(index)
    group = (F.col("c1") % groups + 1).cast("int")
    of = lambda xs: F.element_at(F.array(*(F.lit(int(x)) for x in xs)), group)
    block = of(first[:-1]) + F.pmod(F.xxhash64("vec_id", F.lit(3)), of(salts))
    none = F.lit(None).cast("double")
    vectors = put.select(block.cast("int").alias("block"), none.alias("reach"), "vec_id", "v", "c1", "c2")

    def reaches(batches):
        for b in batches:
            out: tuple[list, list, list] = [], [], []
            s1, s2 = shared.value.sums(matrix(b.column(1))) if len(b) else ([], [])
            for i, (x, y) in enumerate(zip(s1, s2, strict=True)):
                reach = shared.value.reach(x, y, shared.value.budget)
                most = x + y.max()
                for g in range(groups):
                    if most[g::groups].max() >= reach - 1e-12:
                        for n in range(first[g], first[g + 1]):
                            out[0].append(i), out[1].append(n), out[2].append(reach)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64()), b.column(0).take(at), b.column(1).take(at)], ["block", "reach", "vec_id", "v"])

    asked = put.where(is_query).groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v"), "v")).alias("x")).select("vec_id", "x.v").repartition(partitions(put), "vec_id")
    asked = asked.mapInArrow(reaches, "block int, reach double, vec_id long, v array<double>")
    asked = asked.select("*", F.lit(None).cast("int").alias("c1"), F.lit(None).cast("int").alias("c2"))
    # Of each block its vectors come first, then the queries.
    blocks = vectors.union(asked).repartitionById(int(first[-1]), F.col("block")).sortWithinPartitions("block", F.isnotnull("reach"))

    def score(batches):
        names = ["query_id", "vec_id", "score"]
        held, now, ready = [], None, None
        for b in batches:
            number, asks = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if now != number[i]:
                    held, now, ready = [], number[i], None
                piece = b.slice(i, j - i)
                if not asks[i]:
                    held.append((piece.column(2).to_numpy(), matrix(piece.column(3)), piece.column(4).to_numpy(), piece.column(5).to_numpy()))
                    continue
                if not held:
                    continue
                ready = ready or Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                who, which, s = ready.best(piece.column(2).to_numpy(), matrix(piece.column(3)), piece.column(1).to_numpy(), shared.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(which, pa.int64()), pa.array(s, pa.float64())], names)

    found = blocks.select("block", "reach", "vec_id", "v", "c1", "c2").mapInArrow(score, "query_id long, vec_id long, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
