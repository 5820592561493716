"""Manifests, trees and commits as binary objects: built from rows, and parsed back into rows.

All begin with a magic and a version. A manifest leaf holds (offset, length, digest) of up to FAN chunks in
order; a node holds (digest, total length, number of chunks) of up to FAN manifests. A tree holds names with
the digests of manifests, a commit a tree, a parent (32 zero bytes for none), an author, a label and a
sequence number. An object's name is its SHA-256. What does not parse is a row of kind 'error'.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.scratch import saved
from tesserae.workers import by_value

by_value(__name__)

# Magics, version and the most entries of one object.
LEAF, NODE, TREE, COMMIT, VERSION, FAN = b"TMAN", b"TMND", b"TTRE", b"TCMT", b"\x01", 8192
_ENTRY = np.dtype([("offset", "<u8"), ("len", "<u4"), ("hash", "V32")])
_CHILD = np.dtype([("hash", "V32"), ("total", "<u8"), ("count", "<u4")])


def _table(magic: bytes, rows: np.ndarray) -> bytes:
    return magic + VERSION + struct.pack("<I", len(rows)) + rows.tobytes()


def _read(data: bytes, magic: bytes, dtype: np.dtype) -> np.ndarray:
    if data[:5] != magic + VERSION or len(data) < 9:
        raise ValueError("another kind of object")
    (n,) = struct.unpack_from("<I", data, 5)
    if len(data) != 9 + n * dtype.itemsize:
        raise ValueError("cut off, or bytes after the end")
    return np.frombuffer(data, dtype, n, 9)


def tree_bytes(entries: list[tuple[str, str]]) -> bytes:
    """A tree of (name, manifest digest) in the order of names."""
    body = b"".join(struct.pack("<H", len(n.encode())) + n.encode() + bytes.fromhex(h) for n, h in sorted(entries))
    return TREE + VERSION + struct.pack("<I", len(entries)) + body


def parse_tree(data: bytes) -> list[tuple[str, str]]:
    if data[:5] != TREE + VERSION or len(data) < 9:
        raise ValueError("not a tree")
    (n,), at, out = struct.unpack_from("<I", data, 5), 9, []
    for _ in range(n):
        if at + 2 > len(data):
            raise ValueError("cut off")
        end = at + 2 + struct.unpack_from("<H", data, at)[0]
        if end + 32 > len(data):
            raise ValueError("cut off")
        out.append((data[at + 2 : end].decode("utf-8", "replace"), data[end : end + 32].hex()))
        at = end + 32
    if at != len(data):
        raise ValueError("bytes after the end")
    return out


def commit_bytes(tree: str, parent: str | None, author: str, label: str, seq: int) -> bytes:
    text = lambda t: struct.pack("<H", len(t.encode())) + t.encode()
    return COMMIT + VERSION + bytes.fromhex(tree) + bytes.fromhex(parent or "00" * 32) + text(author) + text(label) + struct.pack("<Q", seq)


def parse_commit(data: bytes) -> tuple[str, str | None, str, str, int]:
    if data[:5] != COMMIT + VERSION:
        raise ValueError("not a commit")
    try:
        at, words = 69, []
        for _ in range(2):
            (n,) = struct.unpack_from("<H", data, at)
            words.append(data[at + 2 : at + 2 + n].decode("utf-8", "replace"))
            at += 2 + n
        (seq,) = struct.unpack_from("<Q", data, at)
    except struct.error as e:
        raise ValueError("cut off") from e
    if at + 8 != len(data):
        raise ValueError("bytes after the end")
    parent = data[37:69].hex()
    return data[5:37].hex(), parent if parent.strip("0") else None, *words, seq


def _hashes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(h.as_py()) for h in column), "V32")


def _object(rows: pa.Table, data: bytes, total: int, count: int) -> pa.Table:
    first = lambda c: rows.column(c)[:1]
    return pa.table({"manifest": first("manifest"), "part": first("part"), "hash": [hashlib.sha256(data).hexdigest()], "total": pa.array([total], pa.int64()), "count": pa.array([count], pa.int64()), "content": pa.array([data], pa.binary())})


_OBJECT = "manifest long, part long, hash string, total long, count long, content binary"


def manifests(entries: DataFrame, fan: int = FAN) -> DataFrame:
    """(manifest, level, hash, total, count, content): the objects of manifests with entries (manifest, idx, offset, len, hash).

    Every object is built of at most ``fan`` rows, level by level, until each manifest has one on top.
    """

    def leaf(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        out = np.zeros(rows.num_rows, _ENTRY)
        out["offset"], out["len"], out["hash"] = rows.column("offset").to_numpy(), rows.column("len").to_numpy(), _hashes(rows.column("hash"))
        return _object(rows, _table(LEAF, out), int(out["len"].sum()), len(out))

    def node(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        out = np.zeros(rows.num_rows, _CHILD)
        out["hash"], out["total"], out["count"] = _hashes(rows.column("hash")), rows.column("total").to_numpy(), rows.column("count").to_numpy()
        return _object(rows, _table(NODE, out), int(out["total"].sum()), int(out["count"].sum()))

    part = F.floor(F.col("idx") / fan).alias("part")
    level = saved(entries.select("manifest", "idx", "offset", "len", "hash", part).groupBy("manifest", "part").applyInArrow(leaf, _OBJECT))
    out = level.withColumn("level", F.lit(0))
    for depth in range(1, 9):
        level = level.drop("content")
        open_ = level.join(level.where("part > 0").select("manifest").distinct(), "manifest", "left_semi")
        if not open_.take(1):
            break
        rows = open_.select("manifest", F.col("part").alias("idx"), "hash", "total", "count", F.floor(F.col("part") / fan).alias("part"))
        level = saved(rows.groupBy("manifest", "part").applyInArrow(node, _OBJECT))
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.drop("part")


def _opened(name: str, data: bytes) -> tuple[str, np.ndarray]:
    """The kind and the rows of a manifest object; an error for what does not parse or has another digest."""
    if hashlib.sha256(data or b"").hexdigest() != name:
        raise ValueError("another digest")
    kind = "leaf" if data[:4] == LEAF else "node"
    rows = _read(data, LEAF, _ENTRY) if kind == "leaf" else _read(data, NODE, _CHILD)
    if kind == "leaf" and (np.diff(rows["offset"].astype(np.int64)) <= 0).any():
        raise ValueError("not in order")
    return kind, rows


def _digests(rows: np.ndarray) -> pa.Array:
    return pa.array([h.tobytes().hex() for h in rows["hash"]], pa.string())


_ROW = "hash string, kind string, idx long, offset long, len long, child string, count long"


def parsed(objects: DataFrame) -> DataFrame:
    """The rows of manifest objects (hash, content): a leaf's chunks, a node's children; one row of kind 'error' for what does not parse or has another digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for b in batches:
            for name, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    kind, rows = _opened(name, cell)
                    n, none = len(rows), pa.nulls(len(rows), pa.int64())
                    child = _digests(rows)
                    offset = pa.array(rows["offset"].astype(np.int64)) if kind == "leaf" else none
                    size = pa.array(rows["len" if kind == "leaf" else "total"].astype(np.int64))
                    count = none if kind == "leaf" else pa.array(rows["count"].astype(np.int64))
                    columns = [pa.array([name] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(np.arange(n)), offset, size, child, count]
                except ValueError:
                    columns = [pa.array([name], pa.string()), pa.array(["error"]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return objects.select("hash", "content").mapInArrow(run, _ROW)


def flattened(roots: DataFrame, objects: DataFrame) -> DataFrame:
    """(root, ..., offset, len, hash): the chunks of each root (root: a digest, and any other columns), through as many levels of nodes as there are.

    ``objects`` (hash, content) may hold an object several times. Nodes, few beside their leaves, tell which leaves a root
    has; a leaf moves once, to meet those that want it, and is parsed there.
    """
    node = F.substring("content", 1, len(NODE)) == F.lit(bytearray(NODE))
    kept = roots.columns
    nodes = saved(parsed(objects.where(node).dropDuplicates(["hash"])).where("kind = 'node'").select(F.col("hash").alias("_object"), "child"))
    level = roots.select(*kept, F.col("root").alias("_object"))
    wanted = level
    for _ in range(9):
        level = saved(level.join(nodes, "_object").select(*kept, F.col("child").alias("_object")))
        if not level.take(1):
            break
        wanted = wanted.unionByName(level)
    leaves = objects.where(~node).dropDuplicates(["hash"]).select(F.col("hash").alias("_object"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (name, cell) in enumerate(zip(b.column("_object").to_pylist(), b.column("content"))):
                try:
                    kind, rows = _opened(name, cell.as_py())
                except ValueError:
                    continue
                if kind == "leaf":
                    own = b.select(kept).take(pa.array(np.full(len(rows), at)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rows["offset"].astype(np.int64)), pa.array(rows["len"].astype(np.int64)), _digests(rows)], names=[*kept, "offset", "len", "hash"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in roots.schema), "offset long, len long, hash string"])
    return wanted.join(leaves, "_object").select(*kept, "_object", "content").mapInArrow(run, schema)
