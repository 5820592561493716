"""Near-duplicate vectors by spherical-cap filters.

After a random rotation a vector is cut into two halves, and each half has its own random code of
unit vectors; every pair of code words is a filter direction (a product code), so a few dozen code
words stand for thousands of filters. Several rotations with codes of their own are used. A vector is decoded to the list of all filters whose
cap holds it: code words of one half are sorted, and for each of the other half a binary search finds
how far the list goes. Vectors that share a filter are compared exactly. The height of the caps and the
number of filters follow from the number of vectors, so that a filter holds a fixed number of
unrelated vectors and a pair at the threshold shares one with a set probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._shared import Scratch, connected_components, map_arrow, ship

ship(__name__)

COSINE = 0.9
#: Unrelated vectors that a filter holds on average, and shared filters expected for a pair at the threshold.
OCCUPANCY, SHARED = 200.0, 6.0
#: Independent rotations with codes of their own; filters of one code rise and fall together.
CODES = 12
#: A filter with more vectors is dealt into blocks of this size, and pairs of blocks are compared in separate tasks.
BLOCK = 1024
#: So many numbers of such filters are broadcast; if there are more, they are joined.
BROADCAST_FILTERS = 100_000
SEED = 20


def _cap(d: int, height: np.ndarray | float) -> np.ndarray:
    """The share of the unit sphere in d dimensions with a first coordinate of at least ``height``."""
    x = np.linspace(-1, 1, 20_001)
    density = np.maximum(1 - x * x, 0) ** max(0.0, (d - 3) / 2)
    tail = np.concatenate([[0], np.cumsum((density[1:] + density[:-1])[::-1])])[::-1]
    return np.interp(height, x, tail / tail[0])


def parameters(n: int, d: int) -> tuple[float, int]:
    """(height of the caps, code words of each half of each code) for n vectors of d dimensions."""
    want = min(0.05, OCCUPANCY / max(1, n))
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(_cap(d, mid)) > want else (lo, mid)
    height = lo
    s = np.linspace(height, 1, 4001)[:-1]
    weight = (1 - s * s) ** max(0.0, (d - 3) / 2)
    other = (height - COSINE * s) / np.sqrt((1 - COSINE**2) * (1 - s * s))
    shared = float((weight * _cap(max(2, d - 1), np.clip(other, -1, 1))).sum() / weight.sum())
    return height, max(2, math.ceil(math.sqrt(SHARED / shared / want / CODES)))


class Decoder:
    """List-decodes vectors of one dimension."""

    def __init__(self, n: int, d: int):
        self.height, self.words = parameters(n, d)
        self.cut = d - d // 2
        self.codes = []
        for r in range(CODES):
            rng = np.random.default_rng([SEED, d, r])
            rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
            halves = []
            for k in (self.cut, d // 2):
                c = rng.normal(size=(self.words, k))
                halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * math.sqrt(k / d))
            self.codes.append((rotation, *halves))

    def __call__(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each row, ascending."""
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for r, (rotation, left, right) in enumerate(self.codes):
            turned = unit @ rotation
            first, second = turned[:, : self.cut] @ left.T, turned[:, self.cut :] @ right.T
            order = np.argsort(-second, axis=1)
            ranked = -np.take_along_axis(second, order, 1)
            for own, a, b, o in zip(out, first, ranked, order):
                sure = np.flatnonzero(a - b[0] >= self.height)
                if len(sure):
                    far = np.searchsorted(b, a[sure] - self.height, side="right")
                    got = np.repeat(sure, far) * self.words + o[np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)]
                    own.append(np.sort(got) + r * self.words**2)
        return [np.concatenate(own) if own else np.zeros(0, np.int64) for own in out]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _decode(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    known: dict[int, Decoder] = {}
    for b in batches:
        dims = b.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == d))
            x = _matrix(part.column(1), d)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            decoder = known.setdefault(d, Decoder(n, d))
            for at in range(0, len(unit), 512):
                lists = [v + (d << 44) for v in decoder(unit[at : at + 512])]
                yield pa.RecordBatch.from_arrays([part.column(0)[at : at + 512], pa.array(lists, pa.list_(pa.int64()))], names=["rep", "filters"])


def _compare(rows: pa.Table) -> list[tuple[int, int, int]]:
    """(rep, links, root) of one group: links counts pairs whose first common filter this is; root joins the linked."""
    n = rows.num_rows
    if n < 2:
        return []
    key, i, j = (rows.column(k)[0].as_py() for k in ("filter", "i", "j"))
    d = key >> 44
    vec = rows.column("vec").combine_chunks()
    x = _matrix(vec, d)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= COSINE
    np.fill_diagonal(near, False)
    block = rows.column("b").to_numpy()
    if i != j:
        near &= block[:, None] != block[None, :]
    hit = near.any(1)
    if not hit.any():
        return []
    near = near[np.ix_(hit, hit)]
    rep, times = rows.column("rep").to_numpy()[hit], rows.column("times").to_numpy()[hit]
    lists = [f for f, h in zip(rows.column("filters").to_pylist(), hit) if h]
    lower = [[f for f in own if f < key] for own in lists]
    names = {f: c for c, f in enumerate(sorted({f for own in lower for f in own}))}
    if names:
        m = np.zeros((len(lower), len(names)), np.float32)
        for r, own in enumerate(lower):
            m[r, [names[f] for f in own]] = 1
        counted = near & (m @ m.T < 0.5)
    else:
        counted = near
    links = counted @ times
    root, todo = np.full(len(rep), -1), list(range(len(rep)))
    for s in todo:
        if root[s] < 0:
            root[s], front = s, np.array([s])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (root < 0))
                root[front] = s
    return list(zip(rep.tolist(), links.tolist(), rep[root].tolist()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (filter, i, j) in sorted rows, at most two blocks each; a run may cross batches."""
    kept: pa.Table | None = None

    def out(found: list) -> pa.RecordBatch:
        cols = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "root"])

    for b in batches:
        table = pa.Table.from_batches([b])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        k = np.stack([table.column(c).to_numpy() for c in ("filter", "i", "j")])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        edges = [0, *cuts.tolist()]
        found = []
        for s, e in zip(edges, edges[1:]):
            if e - s > 1:
                found += _compare(table.slice(s, e - s))
        kept = table.slice(edges[-1]).combine_chunks()
        if found:
            yield out(found)
    if kept is not None and kept.num_rows > 1:
        yield out(_compare(kept))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean), one row per row of ``vectors``.

    Vectors with a cosine of at least 0.9, in double precision, are linked if they share a filter;
    none below is. Null, empty and zero vectors and those with null or non-finite components link
    with nothing, and vectors of different lengths never link. Identical vectors are compared once and
    counted as often as they occur, so repeated rows link each other. A null vec_id takes part; its
    row is kept if its component has no id. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "capfilters")
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = scratch.write(rows.withColumn("usable", usable).withColumn("vec", F.expr(f"if(usable, transform(vec, x -> cast(x + 0D as {kind})), null)")), "rows")
    reps = rows.where("usable").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"))
    # a vector whose rows have no id gets a negative number that no other has
    reps = scratch.write(reps.select(F.coalesce("low", -F.monotonically_increasing_id() - (1 << 62)).alias("rep"), "low", "times", "vec", F.size("vec").alias("d")), "reps")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = map_arrow(reps.select("rep", "vec", "d").repartition(parts, "rep"), partial(_decode, n=reps.count()), "rep long, filters array<long>")
    lists = scratch.write(lists, "lists")
    # only numbers are counted; a vector travels once for each of its filters
    large = lists.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = scratch.write(large.select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "large")
    if large.count() <= BROADCAST_FILTERS:
        large = F.broadcast(large)
    each = lists.join(reps, "rep").select(F.explode("filters").alias("filter"), "rep", "times", "vec", "filters").join(large, "filter", "left")
    each = each.withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = each.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("filter", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "rep", "times", "vec", "filters")
    # rows of block pairs (i, j) with i < j hold both blocks, those with i = j one
    dealt = dealt.repartition(parts, "filter", "i", "j").sortWithinPartitions("filter", "i", "j", "rep")
    found = scratch.write(map_arrow(dealt, _groups, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    named = reps.join(links, "rep", "left").join(comp, reps.rep == comp.node, "left")
    named = scratch.write(named.select(reps.vec, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id")), "named")
    linked = rows.where("usable").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
