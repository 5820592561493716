"""Centroid clustering by dual-tree Lloyd rounds in exact integers.

Vectors lie in blocks of neighbours, and every block has a cover tree: a node's children are points of its own,
its first child is itself, each child holds the points within half of the node's scale, and chosen children are
farther apart than that. A node keeps the number and the sum of its vectors. Each round a small tree over the
centroids is built, and pairs of a node of either tree are pruned by bounds of their distances, from the roots
down. A node with one centroid left goes to it whole; where several are left at a leaf, they are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._shared import Scratch, map_arrow, ship

ship(__name__)

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components are refused from this value on, so that every squared distance is a long.
LARGEST = 1 << 17
#: Vectors of a block, of a leaf, and pivots by which blocks are chosen, at most.
BLOCK, LEAF, PIVOTS = 2048, 16, 64
#: Up to this value of a component, squared distances are exact in doubles.
EXACT = 1 << 22
#: What rounding may add to a bound.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, SIZE)


def _list(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * SIZE), pa.array(matrix.ravel().astype(np.int32)))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of a, rows of b)."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def cover_tree(v: np.ndarray) -> tuple[np.ndarray, dict]:
    """(order, nodes) of a block: nodes own runs of the reordered rows, parents come before children.

    A node has begin, end, the row of its point, the greatest distance to it, and its children as a run of
    nodes; it is a leaf if that is empty.
    """
    order = np.arange(len(v))
    begin, end, radius, kids, kids_end = [0], [len(v)], [0.0], [0], [0]
    at = 0
    while at < len(begin):
        lo, hi = begin[at], end[at]
        own = order[lo:hi]
        d = np.sqrt(squared(v[own], v[own[:1]])[:, 0].astype(float))
        radius[at] = float(d.max(initial=0.0))
        kids[at] = kids_end[at] = len(begin)
        if hi - lo > LEAF and radius[at] > 0:
            half = 2.0 ** (math.ceil(math.log2(radius[at])) - 1)
            groups = []
            left, gap = own, d  # the node's own point is the first child
            while len(left):
                near = gap <= half
                groups.append(left[near])
                left = left[~near]
                if len(left):
                    gap = np.sqrt(squared(v[left], v[left[:1]])[:, 0].astype(float))
            if len(groups) * 2 <= hi - lo:  # else the points are too far apart for this scale to tell them apart
                order[lo:hi] = np.concatenate(groups)
                for g in groups:
                    begin.append(lo)
                    lo += len(g)
                    end.append(lo)
                    radius.append(0.0), kids.append(0), kids_end.append(0)
                kids_end[at] = len(begin)
        at += 1
    nodes = {"begin": begin, "end": end, "kids": kids, "kids_end": kids_end}
    return order, {k: np.array(x, np.int64) for k, x in nodes.items()} | {"radius": np.array(radius)}


class CentroidTree:
    """A binary tree over the centroids: node 0 has all, each node's group is split between its two points farthest apart."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.groups, self.kids = [np.arange(len(centroids))], []
        at = 0
        while at < len(self.groups):
            g = self.groups[at]
            if len(g) == 1:
                self.kids.append(())
            else:
                d = squared(centroids[g], centroids[g])
                a, b = np.unravel_index(np.argmax(d), d.shape)
                left = d[:, a] <= d[:, b] if a != b else np.arange(len(g)) == 0
                self.kids.append((len(self.groups), len(self.groups) + 1))
                self.groups += [g[left], g[~left]]
            at += 1
        self.center = np.array([centroids[g].mean(0) for g in self.groups])
        self.radius = np.array([np.sqrt(((centroids[g] - c) ** 2).sum(1).max()) for g, c in zip(self.groups, self.center)])

    def candidates(self, points: np.ndarray, radius: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to some vector within ``radius`` of each point; ``among`` (points, centroids) are those not yet ruled out."""
        p = points.astype(float)
        apart = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (self.center**2).sum(1)[None] - 2 * p @ self.center.T))
        slack = SLACK * (np.abs(p).max(initial=0) + np.abs(self.center).max(initial=0) + 1) * SIZE + 1e-6 + np.sqrt(apart.max(initial=0)) * 1e-3
        alive = np.stack([among[:, g].any(1) for g in self.groups], 1)
        low = apart - radius[:, None] - self.radius - slack
        high = np.where(alive, apart + radius[:, None] + self.radius + slack, np.inf)
        reach = high.min(1)
        out = np.zeros_like(among)
        stack = [(0, np.arange(len(points)))]
        while stack:  # a pair of nodes is pruned where even the nearest vectors are farther than the best bound
            node, rows = stack.pop()
            rows = rows[alive[rows, node] & (low[rows, node] <= reach[rows])]
            if len(rows) and self.kids[node]:
                stack += [(kid, rows) for kid in self.kids[node]]
            elif len(rows):
                out[rows, self.groups[node][0]] = True
        return out


def assign(v: np.ndarray, nodes: dict, tree: CentroidTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cluster) until every row of a block is assigned: first whole nodes, then rows of leaves.

    The pairs of nodes that may hold the nearest centroid are followed level by level.
    """
    front, among = np.zeros(min(1, len(v)), np.int64), np.ones((min(1, len(v)), len(tree.centroids)), bool)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(front):
        among = tree.candidates(v[nodes["begin"][front]], nodes["radius"][front], among)
        one, leaf = among.sum(1) == 1, nodes["kids"][front] == nodes["kids_end"][front]
        for n, c in zip(front[one], among[one].argmax(1)):
            yield np.arange(nodes["begin"][n], nodes["end"][n]), np.full(nodes["end"][n] - nodes["begin"][n], c)
        ends = ~one & leaf
        if ends.any():
            leaves.append((front[ends], among[ends]))
        inner = ~one & ~leaf
        kids = nodes["kids_end"][front[inner]] - nodes["kids"][front[inner]]
        first = np.repeat(nodes["kids"][front[inner]] - np.cumsum(kids) + kids, kids)
        front, among = first + np.arange(len(first)), np.repeat(among[inner], kids, 0)
    for n, few in leaves:
        size = nodes["end"][n] - nodes["begin"][n]
        rows = np.repeat(nodes["begin"][n] - np.cumsum(size) + size, size) + np.arange(size.sum())
        d = np.where(np.repeat(few, size, 0), squared(v[rows], tree.centroids), np.iinfo(np.int64).max)
        yield rows, d.argmin(1)  # the first of equals is the smaller number


def _near(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = _matrix(b.column(1))
        d = squared(v, pivots) if len(v) else np.zeros((0, 1), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1, initial=np.iinfo(np.int64).max))], names=["vec_id", "v", "pivot", "gap"])


_BLOCK = "vec_id array<bigint>, v binary, " + ", ".join(f"{n} array<{t}>" for n, t in (("begin", "bigint"), ("end", "bigint"), ("kids", "bigint"), ("kids_end", "bigint"), ("radius", "double")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK vectors with their cover trees; a block has its vectors in the order of its tree."""
    ids, held, n = [], [], 0

    def block() -> pa.RecordBatch:
        v, who = np.concatenate(held), [i for part in ids for i in part]
        order, nodes = cover_tree(v)
        cols = [pa.array([[who[i] for i in order]], pa.list_(pa.int64())), pa.array([v[order].astype(np.int32).tobytes()])]
        cols += [pa.array([nodes[k].tolist()]) for k in ("begin", "end", "kids", "kids_end", "radius")]
        return pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "begin", "end", "kids", "kids_end", "radius"])

    for b in batches:
        v, who = _matrix(b.column(1)), b.column(0).to_pylist()
        at = 0
        while at < len(v):
            take = min(BLOCK - n, len(v) - at)
            held.append(v[at : at + take]), ids.append(who[at : at + take])
            n, at = n + take, at + take
            if n == BLOCK:
                yield block()
                ids, held, n = [], [], 0
    if n:
        yield block()


def _opened(b: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, dict]]:
    for i in range(b.num_rows):
        v = np.frombuffer(b.column(1)[i].as_buffer(), np.int32).reshape(-1, SIZE).astype(np.int64)
        yield b.column(0)[i].values, v, {n: np.asarray(b.column(k)[i].values) for k, n in enumerate(("begin", "end", "kids", "kids_end", "radius"), 2)}


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's number and sum of vectors of each cluster, as rows (cluster, dim, n, total)."""
    tree = CentroidTree(centroids)
    k = len(centroids)
    n, total, seen = np.zeros(k, np.int64), np.zeros((k, SIZE), np.int64), False
    for b in batches:
        for _, v, nodes in _opened(b):
            seen = True
            upto = np.concatenate([np.zeros((1, SIZE), np.int64), np.cumsum(v, 0)])  # a node's sum is a difference of two
            for rows, c in assign(v, nodes, tree):
                if c[0] == c[-1] and (c == c[0]).all() and rows[-1] - rows[0] + 1 == len(rows):
                    n[c[0]] += len(rows)
                    total[c[0]] += upto[rows[-1] + 1] - upto[rows[0]]
                else:
                    n += np.bincount(c, minlength=k)
                    np.add.at(total, c, v[rows])
    if seen:
        cluster, dim = np.divmod(np.arange(k * SIZE), SIZE)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(np.repeat(n, SIZE)), pa.array(total.ravel())], names=["cluster", "dim", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    tree = CentroidTree(centroids)
    for b in batches:
        for ids, v, nodes in _opened(b):
            cluster = np.zeros(len(v), np.int64)
            for rows, c in assign(v, nodes, tree):
                cluster[rows] = c
            d = ((v - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<int>): vectors of exactly 64 components, none null or non-finite, in steps of 1/1024."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == SIZE)
    fine = F.forall("e", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity
    whole = lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more, so that distances are no longs")).cast("int"))
    return x.where(fine).select("vec_id", F.transform("e", whole).alias("v"))


def _start(rows: DataFrame) -> np.ndarray:
    """The first centroids: vectors of the smallest hashes of their ids, of equal ids in the order of components."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)).orderBy("h", "v").limit(CENTROIDS)
    return np.array([r.v for r in first.collect()], np.int64).reshape(-1, SIZE)


def _grown(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks with their trees: rows lie by their nearest pivot and the distance to it, in ranges of rows and not of pivots."""
    picked = rows.select("v").orderBy(F.xxhash64("vec_id", F.lit(SEED)), "v").limit(PIVOTS).collect()
    pivots = np.unique(np.array([r.v for r in picked], np.int64).reshape(-1, SIZE), axis=0)
    near = map_arrow(rows, partial(_near, pivots=pivots), "vec_id long, v array<int>, pivot int, gap long")
    near = scratch.write(near.withColumns({"_spread": F.xxhash64("vec_id", "v"), "_row": F.monotonically_increasing_id()}), "near")
    parts = max(1, near.count() // (4 * BLOCK))
    order = ["pivot", "gap", "_spread", "_row"]
    dealt = near.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = scratch.write(map_arrow(dealt.select("vec_id", "v"), _blocks, _BLOCK), "blocks")
    scratch.drop("near")
    return blocks


def moved(totals: list, centroids: np.ndarray) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean; ``totals`` has (cluster, dim, n, total)."""
    out = centroids.copy()
    for r in totals:
        if r[2]:
            out[r[0], r[1]] = int(r[3]) // int(r[2])
    return out


def cluster(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Vectors that are null, of another length, or hold null or non-finite components are left out; a finite component of
    2^17 or more is an error, as distances would be no longs. Rows with one vec_id are vectors of their own, a null id hashes as ''.
    Fewer than eight vectors give as many centroids; an empty table gives no rows. Ties go to the smaller number.
    The driver sees 64 pivots, and 8 x 64 sums a round, which add up as rows with map-side combine.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "dualtree")
    rows = kept(vectors)
    centroids = _start(rows)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = _grown(rows, scratch)
    for _ in range(rounds):
        sums = map_arrow(blocks, partial(_sums, centroids=centroids), "cluster int, dim int, n long, total long")
        totals = sums.groupBy("cluster", "dim").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect()
        after = moved(totals, centroids)
        if (after == centroids).all():
            break  # every further round is the same
        centroids = after
    out = scratch.write(map_arrow(blocks, partial(_assigned, centroids=centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
