"""Content-defined chunking, dedup statistics, parity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.workers import by_value

by_value(__name__)

# The seed of the gear table, and the usual least, mean and most bytes of a chunk.
GEAR_SEED = 0x853C49E6748FEA9B
PROFILES = {"media": (1 << 20, 1 << 22, 1 << 24), "fine": (1 << 16, 1 << 18, 1 << 20), "text": (256, 1024, 4096)}


def gear_table() -> np.ndarray:
    """256 words of splitmix64 from a fixed seed."""
    out, state, full = [], GEAR_SEED, (1 << 64) - 1
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


_GEAR = gear_table()


#: Bytes whose hashes are held together.
BLOCK = 1 << 20


def gears(data: bytes | np.ndarray, dtype=np.uint64) -> np.ndarray:
    """The rolling gear hash after each byte, in the low bits that ``dtype`` holds.

    The hash shifts by one bit a byte, so its low n bits are a sum over the last n bytes, built by doubling.
    """
    g = _GEAR.astype(dtype)[np.frombuffer(data, np.uint8)]
    n = 1
    while n < 8 * np.dtype(dtype).itemsize:
        if len(g) > n:
            more = g[:-n] << dtype(n)
            g[n:] += more
        n *= 2
    return g


def cut_points(data: bytes, least: int, mean: int, most: int) -> list[int]:
    """The ends of the chunks: at the first hash with zero low bits once a chunk has its least size, or at its most.

    Only as many low bits are computed as the mean size looks at, block by block with an overlap of the bytes that reach into it.
    """
    dtype = np.uint16 if mean <= 1 << 16 else np.uint32 if mean <= 1 << 32 else np.uint64
    reach = 8 * np.dtype(dtype).itemsize
    raw, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(raw), BLOCK):
        begin = max(0, at - reach)
        low = gears(raw[begin : at + BLOCK], dtype)[at - begin :]
        found.append(np.flatnonzero((low & dtype(mean - 1)) == 0) + at + 1)
    hits = np.concatenate([*found, np.zeros(0, np.int64)])
    ends, at = [], 0
    while at < len(raw):
        i = np.searchsorted(hits, at + least)
        end = int(hits[i]) if i < len(hits) else len(raw)
        at = min(end, at + most, len(raw))
        ends.append(at)
    return ends


def _chunk(batches: Iterator[pa.RecordBatch], profile: str) -> Iterator[pa.RecordBatch]:
    import hashlib

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "idx", "offset", "len", "hash"])

    for b in batches:
        rows = []
        for key, cell in zip(b.column(0).to_pylist(), b.column(1)):
            data = memoryview(cell.as_buffer() or b"")
            start = 0
            for i, end in enumerate(cut_points(data, *PROFILES[profile])):
                rows.append((key, i, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                start = end
        if rows:
            yield out(rows)


def cdc_chunks(blobs: DataFrame, profile: str = "text") -> DataFrame:
    """(id, idx, offset, len, hash) of every chunk of blobs (id, data binary); chunks cover the data without gaps.

    A blob is a value of a row, so it fits in a task; hashes take two or four bytes for each byte of a block.
    """
    return blobs.select("id", "data").mapInArrow(partial(_chunk, profile=profile), "id long, idx long, offset long, len long, hash string")


def line_stats(texts: DataFrame, group: str) -> DataFrame:
    """Per group: lines, different lines, share repeated and bytes, with a line as a chunk; digests are counted, not lines."""
    lines = texts.select(group, F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    by = lines.groupBy(group, F.sha2("line", 256).alias("hash")).agg(F.count("*").alias("n"), F.first(F.octet_length("line")).alias("size"))
    return by.groupBy(group).agg(F.sum("n").alias("total"), F.count("*").alias("unique"), F.round((F.sum("n") - F.count("*")) * 100.0 / F.sum("n"), 9).cast("double").alias("dedup_pct"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum(F.col("size").cast("long")).alias("stored"))


def _xor(cells: list) -> np.ndarray:
    """The exclusive or of byte strings, shorter ones padded with zeros."""
    out = np.zeros(max((len(c) for c in cells), default=0), np.uint8)
    for c in cells:
        out[: len(c)] ^= np.frombuffer(c, np.uint8)
    return out


def xor_parity(shards: DataFrame) -> DataFrame:
    """(stripe, parity hex): the exclusive or of a stripe's shards (stripe, data binary) byte by byte, shorter ones padded with zeros.

    A stripe has few shards; one without bytes has no parity.
    """

    def one(rows: pa.Table) -> pa.Table:
        parity = _xor([x.as_buffer() for x in rows.column("data") if x.as_py()])
        return pa.table({"stripe": rows.column("stripe")[: min(1, len(parity))], "parity": pa.array([parity.tobytes().hex()][: min(1, len(parity))], pa.string())})

    return shards.select("stripe", "data").groupBy("stripe").applyInArrow(one, "stripe long, parity string")


def recover(shards: DataFrame, parity: DataFrame, sizes: DataFrame) -> DataFrame:
    """(stripe, shard, data): the one lost shard of each stripe from those left (stripe, shard, data), the parity and the sizes (stripe, shard, size) of all.

    A stripe that lost more than one shard, or none, gives nothing.
    """
    lost = sizes.join(shards.select("stripe", "shard"), ["stripe", "shard"], "left_anti")
    one = lost.groupBy("stripe").agg(F.count("*").alias("n"), F.min("shard").alias("shard"), F.min("size").alias("size")).where("n = 1").drop("n")
    left = shards.join(one.select("stripe"), "stripe", "left_semi").select("stripe", "data")
    every = left.unionByName(parity.join(one.select("stripe"), "stripe", "left_semi").select("stripe", F.unhex("parity").alias("data")))

    def back(rows: pa.Table) -> pa.Table:
        return pa.table({"stripe": rows.column("stripe")[:1], "data": pa.array([_xor([x.as_buffer() for x in rows.column("data") if x.as_py()]).tobytes()], pa.binary())})

    whole = every.groupBy("stripe").applyInArrow(back, "stripe long, data binary")
    return whole.join(one, "stripe").select("stripe", "shard", F.substring("data", F.lit(1), F.col("size")).alias("data"))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the deepest root (root) that is it or an ancestor of it; '' is the root of all if listed."""
    parts = F.split("path", "/", -1)
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("root"))))
    hit = paths.distinct().select("path", above.alias("a")).select("path", "a.*").join(roots.distinct(), "root")
    return hit.groupBy("path").agg(F.max_by("root", "depth").alias("root"))
