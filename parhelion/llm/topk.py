"""Exact top-k inner products with M-trees.

Every integer vector x of a tree gets one more coordinate that gives all of them the
same norm R; then |q - x|^2 = |q|^2 + R^2 - 2 q.x, and the k nearest points are those
with the k largest inner products.  Rows are dealt to trees of bounded size; queries
come in blocks, each searched in every tree, and the trees' answers are merged.  The
blocks go to the trees, not the trees to the blocks: a tree is read once, by the task
that all blocks pass in turn, and nothing is sent through the driver.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 256
FANOUT = 16


class Node:
    """A page.  Routing pages hold pivots, covering radii, and children; leaves rows.

    ``to_parent`` holds each entry's distance to the pivot of the page itself.
    """

    __slots__ = ("rows", "to_parent", "radii", "children")

    def __init__(self, rows, to_parent, radii=None, children=None):
        self.rows, self.to_parent, self.radii, self.children = rows, to_parent, radii, children


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 0):
        self.ids, self.vectors = ids, vectors
        self.x = vectors.astype(np.float64)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.big = float(self.sq.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.big - self.sq, 0.0))
        self.eps = 1e-6 * (1.0 + np.sqrt(self.big))
        self.top = float(np.abs(self.x).max(initial=0.0))
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), None, rng) if len(ids) else None
        self._settle()

    def _settle(self) -> None:
        """Put the rows of each leaf next to each other, so that a page is one slice."""
        order, stack = [], [self.root] if self.root else []
        at, leaves = 0, []
        routing = []
        while stack:
            page = stack.pop()
            if page.radii is None:
                order.append(page.rows)
                leaves.append((page, at, at + len(page.rows)))
                at += len(page.rows)
            else:
                routing.append(page)
                stack += page.children
        if not order:
            return
        order = np.concatenate(order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for page in routing:
            page.rows = self.x[page.rows].copy()
        self.ids, self.vectors, self.x = self.ids[order], self.vectors[order], self.x[order]
        self.sq = self.lift = None
        for page, a, b in leaves:
            page.rows = slice(a, b)

    def __getstate__(self):
        return {a: v for a, v in vars(self).items() if a != "x"}

    def __setstate__(self, state):
        vars(self).update(state)
        self.x = self.vectors.astype(np.float64)

    def _between(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        """Distances of rows to a row, in the lifted space."""
        dot = self.x[rows] @ self.x[pivot] + self.lift[rows] * self.lift[pivot]
        return np.sqrt(np.maximum(2 * (self.big - dot), 0.0))

    def _build(self, rows: np.ndarray, pivot: int | None, rng) -> Node:
        own = self._between(rows, pivot) if pivot is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            return Node(rows, own)
        n = min(FANOUT, -(-len(rows) // PAGE) + 1)
        pivots = rng.choice(rows, n, replace=False)
        apart = np.stack([self._between(rows, p) for p in pivots])
        nearest = apart.argmin(axis=0)
        sizes = np.bincount(nearest, minlength=n)
        if sizes.max() > 0.9 * len(rows):  # nearly all points alike: deal them out
            nearest = np.arange(len(rows)) % n
            sizes = np.bincount(nearest, minlength=n)
        kept = [i for i in range(n) if sizes[i]]
        children = [self._build(rows[nearest == i], pivots[i], rng) for i in kept]
        radii = np.array([apart[i][nearest == i].max() for i in kept])
        at = pivots[kept]
        return Node(at, self._between(at, pivot) if pivot is not None else np.zeros(len(at)), radii, children)

    def search(self, q: np.ndarray, k: int, own_id) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, without own_id."""
        if self.root is None:
            return []
        qf = q.astype(np.float64)
        base = float(qf @ qf) + self.big
        # sums of products below 2**53 are exact in doubles, whose products are fast
        exact = self.top * float(np.abs(qf).max(initial=0.0)) * len(qf) < 2**53
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        tau = np.inf
        heap, turn = [(0.0, 0, self.root, None)], 0
        while heap:
            bound, _, page, to_pivot = heapq.heappop(heap)
            if bound > tau + self.eps:
                break
            rows, radii = page.rows, page.radii
            near = None  # entries whose stored distance doesn't rule them out
            if to_pivot is not None and tau < np.inf:
                reach = np.abs(to_pivot - page.to_parent) - (0 if radii is None else radii)
                near = np.flatnonzero(reach <= tau + self.eps)
                if not len(near):
                    continue
                if len(near) == len(reach):
                    near = None
            if radii is None:
                where = np.arange(rows.start, rows.stop) if near is None else rows.start + near
                if exact:
                    scores = (self.x[rows] if near is None else self.x[where]) @ qf
                    if len(best) == k:
                        good = np.flatnonzero(scores >= best[0][0])
                        where, scores = where[good], scores[good]
                else:
                    scores = [sum(a * b for a, b in zip(map(int, self.vectors[r]), map(int, q))) for r in where]
                for s, i in zip(scores, self.ids[where]):
                    if i == own_id:
                        continue
                    entry = (int(s), -int(i))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    tau = float(np.sqrt(max(base - 2 * best[0][0], 0.0)))
            else:
                if near is None:
                    near = np.arange(len(radii))
                d = np.sqrt(np.maximum(base - 2 * (rows[near] @ qf), 0.0))
                low = np.maximum(d - radii[near], bound)
                for j, at, dist in zip(near, low, d):
                    if at <= tau + self.eps:
                        turn += 1
                        heapq.heappush(heap, (float(at), turn, page.children[j], float(dist)))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


    def search_block(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores of the k best of every row of queries (own: their ids), as ``search`` finds them.

        Each query first visits the leaf of its nearest pivots, which bounds what it still
        asks for; then every page is visited by those queries whose bounds it meets.
        """
        exact = self.top * np.abs(queries.astype(np.float64)).max(axis=1, initial=0.0) * queries.shape[1] < 2**53
        out = [(o, i, s) for o, q in zip(own[~exact], queries[~exact]) for s, i in self.search(q, k, o)]
        own, qf = own[exact], queries[exact].astype(np.float64)
        best, ids = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        if self.root is not None and len(own):
            base = np.einsum("ij,ij->i", qf, qf) + self.big
            tau, seen = np.full(len(own), np.inf), {}

            def visit(page, some):
                scores, there = qf[some] @ self.x[page.rows].T, self.ids[page.rows]
                scores[own[some][:, None] == there] = -np.inf
                least = best[some, -1]
                if page not in seen and len(there) > k:
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                q, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                hit = some[np.unique(q)]
                q, s, i = (np.concatenate(x) for x in ((some[q], np.repeat(hit, k)), (scores[q, r], best[hit].ravel()), (there[r], ids[hit].ravel())))
                order = np.lexsort((i, -s, q))
                q, s, i = q[order], s[order], i[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                first = place < k
                best[q[first], place[first]], ids[q[first], place[first]] = s[first], i[first]
                tau[hit] = np.sqrt(np.maximum(base[hit] - 2 * best[hit, -1], 0.0))

            def distances(page, some):
                return np.sqrt(np.maximum(base[some][:, None] - 2 * (qf[some] @ page.rows.T), 0.0))

            def seed(page, some):
                if page.radii is None:
                    visit(page, some)
                    seen[page] = some
                    return
                nearest = distances(page, some).argmin(axis=1)
                for j in np.unique(nearest):
                    seed(page.children[j], some[nearest == j])

            def walk(page, some):
                if page.radii is None:
                    some = np.setdiff1d(some, seen.get(page, []), assume_unique=True)
                    if len(some):
                        visit(page, some)
                    return
                low = distances(page, some) - page.radii
                for j in low.mean(axis=0).argsort():
                    near = some[low[:, j] <= tau[some] + self.eps]
                    if len(near):
                        walk(page.children[j], near)

            seed(self.root, np.arange(len(own)))
            walk(self.root, np.arange(len(own)))
        q, r = np.nonzero(best > -np.inf)
        rest = np.array([x[:2] for x in out], np.int64).reshape(-1, 2)
        scores = np.concatenate([best[q, r].astype(np.int64), np.array([x[2] for x in out], np.int64)])
        return np.concatenate([own[q], rest[:, 0]]), np.concatenate([ids[q, r], rest[:, 1]]), scores


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    return narrow(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (floor(256 x) as longs), dim; rows with a null id, a null vector or a
    null or non-finite component are left out, repeated rows are one."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    good = rows.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(F.coalesce(whole, F.lit(False)))
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256)).alias("v")).distinct().withColumn("dim", F.size("v"))


def top_k(rows: DataFrame, k: int = 5, every: int = 50, tree_rows: int = 8192, block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; a query meets every row
    with another id and as many components.  Fewer rows than k give all; ties go to the
    smaller id; an empty table gives no rows.  All rows are indexed and the search is
    exact, so recall is 1.
    """
    from parhelion.llm.shared import Scratch

    scratch = Scratch(rows.sparkSession, "topk")
    good = scratch.save(integer_vectors(rows, id_col, vector_col))
    n, n_queries = good.count(), good.filter(F.col("vec_id") % every == 0).count()
    # blocks are copied to every tree: from 64 trees on, trees grow first (up to 8 x tree_rows)
    trees = max(1, -(-n // (8 * tree_rows)), min(-(-n // tree_rows), 64))
    blocks = max(1, -(-n_queries // block))
    shape = "dim int, tree int, block int, blob binary"

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim, tree = (x.as_py() for x in key)
        made = MTree(table["vec_id"].to_numpy(), _matrix(table, dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "tree": pa.array([tree], pa.int32()), "block": pa.array([-1], pa.int32()), "blob": [pickle.dumps(made, 5)]})

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        dim, at = (x.as_py() for x in key)
        asks = pickle.dumps((table["vec_id"].to_numpy(), _matrix(table, dim)), 5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "tree": pa.array([0], pa.int32()), "block": pa.array([at], pa.int32()), "blob": [asks]})

    dealt = good.withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), F.lit(trees)).cast("int"))
    index = scratch.save(dealt.groupBy("dim", "tree").applyInArrow(build, shape))
    asked = good.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = scratch.save(asked.groupBy("dim", "block").applyInArrow(gather, shape))
    asked = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def search(batches):
        at = tree = None
        for b in batches:
            for dim, number, part, blob in zip(*(b.column(c).to_pylist() for c in range(3)), b.column(3)):
                if part < 0:
                    at, tree = (dim, number), pickle.loads(blob.as_py())
                elif at == (dim, number):  # else no row of that many components is in the tree
                    q, i, s = tree.search_block(*pickle.loads(blob.as_py()), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    # a tree comes before the blocks that pass it
    work = index.unionByName(asked).repartition(min(4 * trees, 4096), "dim", "tree").sortWithinPartitions("dim", "tree", "block")
    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
