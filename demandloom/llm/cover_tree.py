"""Exact top-k by inner product with dual cover trees.

Vectors and queries are dealt by hash into blocks of a bounded size, and each pair of a query block
and a vector block is searched in a group of its own; the k best of every group meet by query. In a
group both sides are indexed by cover trees: a node is a point of the data with a covering radius,
its children are points of it that are further than the next radius apart, and the radii shrink by
``SHRINK`` from level to level. For a query node with centre c and radius s, and a data node with
point p and radius r, no inner product between them is above <c, p> + s|p| + r|c| + sr; the pair is
pruned when that is below the worst k-th score of the node's queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.components import keep

K = 5
EVERY = 50
SCALE = 256.0
#: Vectors and queries in a block, on average.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2_048
#: Points up to which a node is not split.
LEAF = 64
#: A node stays whole if its next cover needs more than one centre for so many points: then the
#: points are about equally far from each other, and smaller balls would not part them.
POINTS_PER_CENTRE = 8
SHRINK = 1.4
#: Points after which the bounds are looked at again.
PIECE = 1024
#: Candidate centres whose distances are taken at once.
BATCH = 64
#: Inner products below this are whole numbers in floating point; larger ones are taken in Python's integers.
EXACT = 2.0**53
#: What stands for no score, and the largest that is told; a score beyond 64 bits is cut to it.
NONE, MOST = -(2**63), 2**63 - 1


@dataclass
class Tree:
    """Nodes in the order in which they were made; a node's points are ``members[first:last]``.

    Children of node i are ``children[i]``; leaves have none. ``centre`` is a row of the points.
    """

    points: np.ndarray
    members: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[np.ndarray]


def build(points: np.ndarray) -> Tree:
    """The cover tree of the points; every point is in the members of one leaf."""
    members = np.arange(len(points))
    squares = np.einsum("ij,ij->i", points, points)
    centre, radius, first, last, children = [], [], [], [], []

    def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d = squares[rows][:, None] + squares[centres][None] - 2.0 * (points[rows] @ points[centres].T)
        return np.sqrt(np.maximum(d, 0))

    def node(c: int, low: int, high: int, r: float) -> int:
        centre.append(c)
        radius.append(r)
        first.append(low)
        last.append(high)
        children.append(np.zeros(0, int))
        return len(centre) - 1

    def reach(c: int, low: int, high: int) -> float:
        return float(np.sqrt(((points[members[low:high]] - points[c]) ** 2).sum(axis=1)).max())

    if not len(points):
        return Tree(points, members, *(np.zeros(0) for _ in range(4)), [])
    waiting = [node(0, 0, len(points), reach(0, 0, len(points)))]
    while waiting:
        at = waiting.pop()
        low, high, r = first[at], last[at], radius[at]
        if high - low <= LEAF or r == 0:
            continue
        limit, own = r / SHRINK, members[low:high]
        group = np.full(len(own), -1)
        centres = [centre[at]]
        group[distances(own, np.array(centres))[:, 0] <= limit] = 0
        open_ = np.flatnonzero(group < 0)
        while len(open_) and len(centres) * POINTS_PER_CENTRE <= len(own):
            tried = open_[:BATCH]
            near = distances(own[open_], own[tried]) <= limit
            near[np.arange(len(tried)), np.arange(len(tried))] = True  # the tried are the first of the open
            taken = np.zeros(len(open_), bool)
            for j in range(len(tried)):
                if not taken[j]:
                    hit = near[:, j] & ~taken
                    group[open_[hit]] = len(centres)
                    centres.append(own[tried[j]])
                    taken |= hit
            open_ = open_[~taken]
        if len(centres) * POINTS_PER_CENTRE > len(own):
            continue
        order = np.argsort(group, kind="stable")
        members[low:high] = own[order]
        bounds = low + np.r_[0, np.cumsum(np.bincount(group, minlength=len(centres)))]
        made = []
        for c, a, b in zip(centres, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a < b:
                made.append(node(c, a, b, reach(c, a, b)))
        children[at] = np.array(made)
        waiting += made
    return Tree(points, members, np.array(centre), np.array(radius), np.array(first), np.array(last), children)


def whole(points: np.ndarray) -> Tree:
    """The points without any nodes."""
    return Tree(points, np.arange(len(points)), *(np.zeros(0) for _ in range(4)), [])


class Search:
    """Best scores of all queries of a block against a block of vectors."""

    def __init__(self, queries: Tree, data: Tree, query_ids: np.ndarray, data_ids: np.ndarray, k: int, exact: bool = True):
        self.queries, self.data, self.k = queries, data, k
        self.query_ids, self.data_ids = query_ids, data_ids
        self.repeated = len(np.unique(data_ids)) < len(data_ids)
        n = len(query_ids)
        self.exact = exact
        self.none = -np.inf if self.exact else NONE
        self.scores = np.full((n, k), self.none, dtype=np.float64 if self.exact else np.int64)
        self.found = np.zeros((n, k), np.int64)
        if not exact:
            return
        self.query_norm = np.sqrt((queries.points[queries.centre] ** 2).sum(axis=1))
        self.data_norm = np.sqrt((data.points[data.centre] ** 2).sum(axis=1))
        # floating-point error of a bound; scores are whole numbers and exact
        self.slack = 1e-9 * (1 + float(np.abs(queries.points).max()) * float(np.abs(data.points).max()) * queries.points.shape[1])

    def offer(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Put the scores of the rows into the best of the queries; equal scores go to smaller ids.

        An id with several vectors takes one place, by its best score.
        """
        scores = self.products(queries, rows)
        ids = np.broadcast_to(self.data_ids[rows], scores.shape)
        scores = np.where(ids == self.query_ids[queries][:, None], self.none, scores)
        scores = np.concatenate([self.scores[queries], scores], axis=1)
        ids = np.concatenate([self.found[queries], ids], axis=1)
        if self.repeated:
            order = np.lexsort((self.falling(scores), ids), axis=1)
            scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
            scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = self.none
        if scores.shape[1] > 4 * self.k:
            falling = self.falling(scores)
            worst = np.partition(falling, self.k - 1, axis=1)[:, self.k - 1]
            wide = int((falling <= worst[:, None]).sum(axis=1).max())
            pick = np.argpartition(falling, min(wide, scores.shape[1]) - 1, axis=1)[:, :wide]
            scores, ids = np.take_along_axis(scores, pick, axis=1), np.take_along_axis(ids, pick, axis=1)
        order = np.lexsort((ids, self.falling(scores)), axis=1)[:, : self.k]
        self.scores[queries] = np.take_along_axis(scores, order, axis=1)
        self.found[queries] = np.take_along_axis(ids, order, axis=1)

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.queries.points[queries] @ self.data.points[rows].T
        whole = [np.array([list(map(int, v)) for v in points.tolist()], dtype=object) for points in (self.queries.points[queries], self.data.points[rows])]
        return np.clip(whole[0] @ whole[1].T, NONE + 1, MOST).astype(np.int64)

    def falling(self, scores: np.ndarray) -> np.ndarray:
        """Numbers that order the scores from the highest on."""
        return -scores if self.exact else ~scores

    def prune(self, q: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The data nodes that may improve some query of node q, with their bounds, best first."""
        t, d = self.queries, self.data
        worst = float(self.scores[t.members[t.first[q] : t.last[q]], -1].min())
        bound = t.points[t.centre[q]] @ d.points[d.centre[nodes]].T
        bound = bound + t.radius[q] * self.data_norm[nodes] + d.radius[nodes] * self.query_norm[q] + t.radius[q] * d.radius[nodes] + self.slack
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= worst]
        return nodes[order], bound[order]

    def all_pairs(self) -> None:
        """Every query against every vector, some at a time; for the few too large for floating point, trees included."""
        for a in range(0, len(self.query_ids), LEAF):
            for b in range(0, len(self.data_ids), PIECE):
                self.offer(np.arange(a, min(a + LEAF, len(self.query_ids))), np.arange(b, min(b + PIECE, len(self.data_ids))))

    def run(self) -> None:
        """Down both trees at once: what a query node prunes, none of its children looks at."""
        t, d = self.queries, self.data
        waiting = [(0, np.array([0]))]
        while waiting:
            q, nodes = waiting.pop()
            nodes, _ = self.prune(q, nodes)
            if not len(nodes):
                continue
            if len(t.children[q]):
                split = [d.children[i] if len(d.children[i]) else np.array([i]) for i in nodes]
                waiting += [(int(c), np.concatenate(split)) for c in t.children[q]]
            else:
                self.leaf(q, nodes)

    def leaf(self, q: int, nodes: np.ndarray) -> None:
        """Queries of a leaf against the data nodes left: the best bounds first, until none is good enough."""
        t, d = self.queries, self.data
        queries = t.members[t.first[q] : t.last[q]]
        while len(nodes):
            nodes, _ = self.prune(q, nodes)
            inner = np.array([len(d.children[i]) > 0 for i in nodes], bool)
            leaves, step = nodes[~inner], nodes[inner]
            rows, used = [], 0
            for i in leaves[: 4 * BATCH]:
                rows.append(d.members[d.first[i] : d.last[i]])
                used += 1
                if sum(map(len, rows)) >= PIECE:
                    break
            if rows:
                self.offer(queries, np.concatenate(rows))
            opened = step[:BATCH]
            nodes = np.concatenate([leaves[used:], step[BATCH:], *[d.children[i] for i in opened]])


def search(query_ids: np.ndarray, queries: np.ndarray, data_ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best vectors of each query, other than those of its own id."""
    if not len(query_ids) or not len(data_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1]
    if largest < EXACT:
        found = Search(build(queries), build(data), query_ids, data_ids, k)
        found.run()
    else:
        found = Search(whole(queries), whole(data), query_ids, data_ids, k, exact=False)
        found.all_pairs()
    row, place = np.nonzero(found.scores != found.none)
    return query_ids[row], found.found[row, place], found.scores[row, place].astype(np.int64)


def vectors_of(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product of each query.

    Components x become floor(256 x). Queries are the rows whose id is divisible by ``every``;
    candidates are all rows of the same length and another id. Equal scores go to smaller ids. Rows
    whose id or vector is null, or whose vector is empty or holds null or non-finite components,
    take no part. Of several vectors with one id all are candidates, and the best score counts, also
    where that id asks. Scores are exact; beyond 64 bits they are cut to the largest or least long.
    Vectors with such large components are searched apart from the others, in Python's integers.
    Fewer candidates give fewer rows; an empty table gives none.
    """
    kept = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.when(F.abs(x * SCALE) < EXACT, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    rows = vectors.filter(F.col(id_col).isNotNull() & kept & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    rows = rows.filter(F.forall("v", lambda x: F.abs(x) < float("inf"))).distinct().withColumn("dim", F.size("v"))
    limit = F.sqrt(F.lit(EXACT) / F.col("dim"))
    rows = keep(rows.withColumn("large", F.exists("v", lambda x: F.abs(x) >= limit)))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), F.max("large").alias("large")).first()
    data_blocks, query_blocks = max(1, math.ceil(counts["n"] / block_vectors)), max(1, math.ceil(counts["q"] / block_queries))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sizes = F.explode(F.array(*map(F.lit, [False, True] if counts["large"] else [False])))  # that of the other side
    data = rows.select("dim", F.col("large").alias("data_large"), sizes.alias("query_large"), block(data_blocks).alias("data_block"), "vec_id", "v").withColumn("query_block", copies(query_blocks))
    asking = rows.filter(F.col("vec_id") % every == 0)
    queries = asking.select("dim", sizes.alias("data_large"), F.col("large").alias("query_large"), block(query_blocks).alias("query_block"), "vec_id", "v").withColumn("data_block", copies(data_blocks))

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if asked.num_rows and given.num_rows:
            dim = asked.column("dim")[0].as_py()
            ids = [t.column("vec_id").to_numpy() for t in (asked, given)]
            out = search(ids[0], vectors_of(asked.column("v"), dim), ids[1], vectors_of(given.column("v"), dim), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    keys = ["dim", "data_large", "query_large", "data_block", "query_block"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
