"""Approximate nearest neighbours by largest inner product, over low-dimensional stable projections.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the nearest point.
A few Gaussian projections index them. For a point at squared distance d, projected distance over d follows a chi-square
law: the search takes points in the order of their projected distance, verifies each on the original vectors, and ends
when a point nearer than the present k-th would by that law, with CONFIDENCE, have come by now.

A first kd-tree over the projections, fitted on a bounded sample, deals all rows into blocks of near points; its cells are
cut by id where they hold more than BLOCK_BYTES, so a task holds one block. A query first searches the block that it lies
in. The k-th score found there bounds all other searches: whole cells whose box is beyond the stopping distance are
skipped, and the others start with that bound. Inside a block a second kd-tree gives the next points in order of projected
distance: leaves in the order of their boxes, and of what they hold only points nearer than the next box. Queries stream
past a block's index, which is built once. Equal vectors of a block are one point with its ids in order, so copies cost
nothing.

Vectors that are null, zero, or hold a null or a component that is not finite take no part, nor do rows without vec_id;
vectors of different lengths do not meet. Rows that repeat a vec_id count as one neighbour, with the best score, and
are never their own. Equal scores go by vec_id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

K = 20
#: The test is against the k-th point found; recall is tested against brute force.
PROJECTIONS, CONFIDENCE = 24, 0.92
#: Bytes of vectors in a block, and the least number of queries that a block's index is built again for.
BLOCK_BYTES, LOT, LEAF = 8 << 20, 4096, 32
#: Rows that the cells are fitted on, and the most cells. Every row is indexed.
SAMPLE_ROWS, CELLS = 16_384, 1024
#: What single precision may lose of a projected distance; equal points at distance 0 must not fall behind it.
ROUNDING = 1e-5
#: Points that are looked at between two stopping tests, at the least.
STEP = 256
SEED = 11


def chi_square_quantile(share: float, freedom: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, freedom // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 20.0 * freedom
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < share else (lo, mid)
    return hi


def projections(size: int, number: int = PROJECTIONS) -> np.ndarray:
    """A row for each component and one for the component that makes lengths equal."""
    return np.random.default_rng(SEED).standard_normal((size + 1, number))


def project(x: np.ndarray, top: float, matrix: np.ndarray) -> np.ndarray:
    """The projections of points whose squared lengths are at most top."""
    return x @ matrix[:-1] + np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None] * matrix[-1]


def split(p: np.ndarray, most: int) -> tuple[list[np.ndarray], list[tuple[int, float, int, int]]]:
    """Halves along the widest axis until no part has over most points: the parts, and the tree (axis, value, left, right)
    from node 0 on, in which a part is -1 - its place."""
    leaves, tree, todo = [], [], [(np.arange(len(p)), None)]
    while todo:
        part, parent = todo.pop()
        if len(part) <= most:
            at = -1 - len(leaves)
            leaves.append(part)
        else:
            values = p[part]
            axis = int(np.ptp(values, axis=0).argmax())
            half = len(part) // 2
            order = np.argpartition(values[:, axis], half)
            at = len(tree)
            tree.append([axis, float(values[order[half], axis]), 0, 0])
            todo += [(part[order[:half]], (at, 2)), (part[order[half:]], (at, 3))]
        if parent:
            tree[parent[0]][parent[1]] = at
    return leaves, [tuple(t) for t in tree]


@dataclass
class Cells:
    """The first kd-tree of the vectors of one size."""

    top: float
    matrix: np.ndarray
    tree: list[tuple[int, float, int, int]]

    def of(self, p: np.ndarray) -> np.ndarray:
        """The cell of each projected point."""
        at = np.full(len(p), 0 if self.tree else -1)
        if self.tree:
            axis, value, left, right = (np.array(c) for c in zip(*self.tree, strict=True))
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                at[inner] = np.where(p[inner, axis[node]] < value[node], left[node], right[node])
        return -1 - at


class Index:
    """The kd-tree of one block's projections, leaf by leaf, and its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float | None = None, number: int = PROJECTIONS, confidence: float = CONFIDENCE):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0
        rows = vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        _, first, same = np.unique(rows, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same, ids], axis=1), axis=0)  # repeats of an id at a point are one
        self.ids, starts = pairs[:, 1], np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0]))])
        x = vectors[first]
        self.top = float((x**2).sum(axis=1).max()) if top is None else top
        matrix = projections(x.shape[1], number)
        self.matrix, p = matrix[:-1], project(x, self.top, matrix)
        self.limit = chi_square_quantile(confidence, number)
        leaves, _ = split(p, LEAF)
        self.order = np.concatenate(leaves)
        self.low, self.high = (np.array([f(p[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        self.leaf_sizes = np.array([len(leaf) for leaf in leaves])
        self.x, self.p = x[self.order], p[self.order].astype(np.float32)
        self.scale = np.abs(self.x).max()
        self.rough = (self.x / self.scale).astype(np.float32)  # for the search; what it finds is scored on self.x
        self.id_from, self.id_to = starts[:-1][self.order], starts[1:][self.order]
        self.leaf_at = np.concatenate([[0], np.cumsum(self.leaf_sizes)])
        self.p_square = (self.p.astype(np.float64) ** 2).sum(axis=1)
        self.verified = self.asked = 0

    def search(self, query: np.ndarray, own: int, k: int = K, kth: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best found, best first; of what can only fall behind the score kth some may be missing."""
        q = query @ self.matrix
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        box = (gap**2).sum(axis=1)
        by_box = np.argsort(box, kind="stable")
        reach, base = np.append(box[by_box], np.inf), self.top + query @ query
        sizes = self.leaf_sizes[by_box].cumsum()
        peak = max(np.abs(query).max(), 1e-300)
        rough_query, unit = (query / peak).astype(np.float32), self.scale * peak
        q_rough, q_square = q.astype(np.float32), q @ q
        slack = ROUNDING * (q_square + self.p_square.max())
        wait_rows, wait_far = np.empty(0, np.int64), np.empty(0)
        rows, scores, best, at, done, stop = [], [], np.empty(0, np.float32), 0, 0, np.inf
        while True:
            if np.isfinite(kth):  # a score of kth is a squared distance of base - 2 kth
                stop = self.limit * max(base - 2 * kth, 0.0) + slack
            # no point of a leaf still to come is nearer than its box
            ready = np.flatnonzero(wait_far <= min(reach[at] + slack, stop))
            if len(ready):
                most = max(STEP, sum(map(len, rows)) // 2)
                mine = ready if len(ready) <= most else ready[np.argpartition(wait_far[ready], most)[:most]]
                rows.append(wait_rows[mine])
                scores.append(self.rough[rows[-1]] @ rough_query)
                left = np.ones(len(wait_rows), bool)
                left[mine] = False
                wait_rows, wait_far = wait_rows[left], wait_far[left]
                best = np.concatenate([best, scores[-1]])
                if len(best) > k:  # one more than k: the query's own point may be among them
                    best = np.partition(best, len(best) - k - 1)[len(best) - k - 1 :]
                    kth = max(kth, float(best[0]) * unit)
                continue
            if at == len(by_box) or reach[at] > stop:
                break
            to = max(at + 1, int(np.searchsorted(sizes, done + max(STEP, done // 2), side="right")))
            chosen = np.zeros(len(by_box), bool)
            chosen[by_box[at:to]] = True
            new = np.flatnonzero(np.repeat(chosen, self.leaf_sizes))
            far = self.p_square[new] + q_square - 2.0 * (self.p[new] @ q_rough)
            near = far <= stop  # those beyond can never be verified
            wait_rows, wait_far = np.concatenate([wait_rows, new[near]]), np.concatenate([wait_far, far[near]])
            at, done = to, int(sizes[to - 1])
        if not rows:
            return np.empty(0, np.int64), np.empty(0)
        rows, rough = np.concatenate(rows), np.concatenate(scores)
        self.verified, self.asked = self.verified + len(rows), self.asked + 1
        if len(rows) > k + 1:  # all that single precision cannot tell from the best k + 1
            least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            rows = rows[rough >= least - 1e-5 * query.size]
        exact = (self.x[rows] * query).sum(axis=1)
        ids, values = [], []
        for row, score in zip(rows, exact, strict=True):
            mine = self.ids[self.id_from[row] : min(self.id_to[row], self.id_from[row] + k + 1)]
            mine = mine[mine != own][:k]
            ids.append(mine)
            values.append(np.full(len(mine), score))
        ids, values = np.concatenate(ids), np.concatenate(values)
        best = np.lexsort((ids, -values))
        best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]  # an id of several vectors counts once
        return ids[best], values[best]


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v and its length for the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.filter(F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).filter(F.col("v").isNotNull()).filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0.0)).withColumn("size", F.size("v"))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, rows and vectors of a batch, one size after the other."""
    sizes, flat = batch.column("size").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]


def _projected(df: DataFrame, tops: dict[int, float], schema: str, make, asks: bool = False) -> DataFrame:
    """make(batch's ids, their rows, size, projections) -> columns, over the vectors of each size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _vectors(batch):
                matrix = projections(size)
                yield make(batch.take(pa.array(rows)), size, x @ matrix[:-1] if asks else project(x, tops[size], matrix))

    return df.mapInArrow(run, schema)


def _cells(vectors: DataFrame, block_bytes: int) -> dict[int, Cells]:
    """The first kd-tree for each size, from the longest vector of all and at most SAMPLE_ROWS projections."""
    about = {r["size"]: r for r in vectors.groupBy("size").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).collect()}
    tops = {size: r["top"] for size, r in about.items()}

    def make(batch: pa.RecordBatch, size: int, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("h"), pa.array(np.full(len(p), size), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], ["h", "size", "p"])

    some = _projected(vectors.withColumn("h", F.xxhash64("vec_id", F.lit(SEED))), tops, "h long, size int, p array<double>", make).orderBy("h").limit(SAMPLE_ROWS).collect()
    out = {}
    for size, r in about.items():
        p = np.array([x["p"] for x in some if x["size"] == size])
        number = min(CELLS, max(1, -(-r["n"] * size * 8 // block_bytes)))
        out[size] = Cells(r["top"], projections(size), split(p, max(LEAF, -(-len(p) // number)))[1] if len(p) else [])
    return out


def _boxes(placed: DataFrame, tops: dict[int, float], block_bytes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size its cells, their boxes' corners over all rows, and in how many blocks each is cut; CELLS rows at most."""
    names = [f"{end}{i}" for end in ("l", "h") for i in range(PROJECTIONS)]

    def make(batch: pa.RecordBatch, size: int, p: np.ndarray) -> pa.RecordBatch:
        cells, at = np.unique(batch.column("cell").to_numpy(), return_inverse=True)
        low, high = np.full((len(cells), PROJECTIONS), np.inf), np.full((len(cells), PROJECTIONS), -np.inf)
        np.minimum.at(low, at, p)
        np.maximum.at(high, at, p)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), size), pa.int32()), pa.array(cells, pa.int32()), pa.array(np.bincount(at), pa.int64()), *map(pa.array, low.T), *map(pa.array, high.T)], ["size", "cell", "n", *names])

    parts = _projected(placed, tops, "size int, cell int, n long, " + ", ".join(f"{n} double" for n in names), make)
    rows = parts.groupBy("size", "cell").agg(F.sum("n").alias("n"), *(F.min(n).alias(n) if n[0] == "l" else F.max(n).alias(n) for n in names)).collect()
    out = {}
    for size in {r["size"] for r in rows}:
        mine = sorted((r for r in rows if r["size"] == size), key=lambda r: r["cell"])
        corner = lambda end: np.array([[r[f"{end}{i}"] for i in range(PROJECTIONS)] for r in mine])  # noqa: B023, E731
        out[size] = np.array([r["cell"] for r in mine]), corner("l"), corner("h"), np.array([max(1, -(-r["n"] * size * 8 // block_bytes)) for r in mine])
    return out


_BLOCK = "size int, cell int, part int, lot int, asks boolean, vec_id long, v array<double>, kth double"


def _asked(queries: DataFrame, cells: dict[int, Cells], boxes: dict, home: bool) -> DataFrame:
    """A row for each query and block that it has to search: that of its own place (home), or all others that can hold a
    nearer point than the k-th found there (queries then have kth)."""
    limit = chi_square_quantile(CONFIDENCE, PROJECTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _vectors(batch):
                if size not in boxes:
                    continue
                number, low, high, parts = boxes[size]
                p, mine = x @ cells[size].matrix[:-1], batch.take(pa.array(rows))
                gap = [np.maximum(np.maximum(low - q, q - high), 0) for q in p]
                box = np.array([(g**2).sum(axis=1) for g in gap])
                ids = mine.column("vec_id").to_numpy()
                nearest, first = box.argmin(axis=1), ids % parts[box.argmin(axis=1)]
                kth = None if home else mine.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                at, cell, part = [], [], []
                for i in range(len(ids)):
                    if home:
                        found = [(nearest[i], first[i])]
                    else:
                        stop = np.inf if np.isnan(kth[i]) else limit * max(cells[size].top + x[i] @ x[i] - 2 * kth[i], 0.0) + ROUNDING * (p[i] @ p[i] + 1)
                        found = [(c, j) for c in np.flatnonzero(box[i] <= stop) for j in range(parts[c]) if (c, j) != (nearest[i], first[i])]
                    at += [i] * len(found)
                    cell += [number[c] for c, _ in found]
                    part += [j for _, j in found]
                for a in range(0, len(at), 4096):
                    some = mine.take(pa.array(at[a : a + 4096], pa.int64()))
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size), pa.int32()), pa.array(cell[a : a + 4096], pa.int32()), pa.array(part[a : a + 4096], pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.array(np.ones(n, bool)), some.column("vec_id").cast(pa.int64()), some.column("v"), pa.nulls(n, pa.float64()) if home else some.column("kth")], _BLOCK_NAMES)

    return queries.mapInArrow(run, _BLOCK)


_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _searched(points: DataFrame, asked: DataFrame, tops: dict[int, float], k: int, lots: int) -> DataFrame:
    """query_id, vec_id and score from each block; a block's points come first, its queries stream past their index."""
    each = points.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))) if lots > 1 else points.withColumn("lot", F.lit(0))
    each = each.select("size", "cell", "part", "lot", F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("kth"))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.lit(lots)).cast("int"))
    keys = ["size", "cell", "part", "lot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in keys])
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for rows in np.split(np.arange(batch.num_rows), 1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1]))):
                if not len(rows):
                    continue
                if (now := tuple(key[:, rows[0]].tolist())) != block:
                    block, held, index = now, [], None
                part = batch.slice(int(rows[0]), len(rows))
                _, _, x = next(_vectors(part))
                ids = part.column("vec_id").to_numpy()
                if not asks[rows[0]]:
                    held.append((ids, x))
                    continue
                if index is None and held:
                    index, held = Index(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), tops[block[0]]), []
                if index is None:
                    continue
                kth = part.column("kth").to_pylist()
                for at in range(0, len(ids), 512):
                    found = [index.search(x[i], int(ids[i]), k, -np.inf if kth[i] is None else kth[i]) for i in range(at, min(at + 512, len(ids)))]
                    query = np.repeat(ids[at : at + 512], [len(f) for f, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate([f for f, _ in found]), pa.int64()), pa.array(np.concatenate([v for _, v in found]), pa.float64())], ["query_id", "vec_id", "score"])

    return each.unionByName(asked.select(*each.columns)).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of vectors for each of queries (both as usable() gives them)."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    vectors, queries = (d.withColumn("vec_id", F.col("vec_id").cast("long")) for d in (vectors, queries))
    cells = _cells(vectors, block_bytes)
    tops = {size: c.top for size, c in cells.items()}

    def make(batch: pa.RecordBatch, size: int, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), batch.column("size"), pa.array(cells[size].of(p), pa.int32())], ["vec_id", "v", "size", "cell"])

    placed = scratch.cut(_projected(vectors.select("vec_id", "v", "size"), tops, "vec_id long, v array<double>, size int, cell int", make), "placed").df
    boxes = _boxes(placed, tops, block_bytes)
    parts = vectors.sparkSession.createDataFrame([(s, int(c), int(n)) for s, (number, _, _, cut) in boxes.items() for c, n in zip(number, cut, strict=True)], "size int, cell int, parts int")
    points = placed.join(F.broadcast(parts), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")  # CELLS rows at most
    longest, total = max(cells, default=1), queries.count()
    lots = max(1, -(-total * longest * 8 // block_bytes))
    at_home = scratch.cut(_searched(points, _asked(queries.select("vec_id", "v", "size"), cells, boxes, True), tops, k, lots), "home").df
    first = at_home.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    first = first.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
    bound = queries.select("vec_id", "v", "size").join(first, "vec_id", "left")
    rest = _searched(points, _asked(bound, cells, boxes, False), tops, k, lots)
    return _best(at_home.unionByName(rest), k)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
