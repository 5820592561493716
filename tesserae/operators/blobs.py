"""Content-defined chunks of blobs that are larger than a task: a blob is many rows, its blocks.

Where a cut may fall depends on the last few bytes alone, so blocks look for candidates by themselves, and the
ends of neighbours are brought to each other as rows of a few bytes. Which candidates are cuts depends on the cut
before, so the candidates, not the bytes, stream through a fold in the order of their blob; its state is one
number. Blocks then slice their own bytes, and only chunks that reach over the end of a block travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.chunking import PROFILES, gears
from tesserae.scratch import saved
from tesserae.workers import by_value

by_value(__name__)


def _width(mean: int) -> type:
    return np.uint16 if mean <= 1 << 16 else np.uint32 if mean <= 1 << 32 else np.uint64


def reach(mean: int) -> int:
    """The bytes on which a hash depends, as far as the mean size looks at it."""
    return 8 * np.dtype(_width(mean)).itemsize


def hits(data: np.ndarray, before: int, mean: int) -> np.ndarray:
    """The places in ``data`` behind which a chunk may end, after its first ``before`` bytes, which only lead in."""
    low = gears(data, _width(mean))[before:]
    return np.flatnonzero((low & _width(mean)(mean - 1)) == 0) + 1


def _inside(batches: Iterator[pa.RecordBatch], mean: int) -> Iterator[pa.RecordBatch]:
    """Of each block (id, block, offset, data): its size, candidates behind its first bytes, and its first and last bytes."""
    n = reach(mean)
    for b in batches:
        out = []
        for cell in b.column(3):
            raw = np.frombuffer(cell.as_buffer() or b"", np.uint8)
            out.append((len(raw), (hits(raw, n, mean) + n).tolist() if len(raw) > n else [], raw[:n].tobytes(), raw[-n:].tobytes()))
        size, found, head, tail = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(head, pa.binary()), pa.array(tail, pa.binary())],
            names=["id", "block", "offset", "size", "found", "head", "tail"],
        )


def _edges(batches: Iterator[pa.RecordBatch], mean: int) -> Iterator[pa.RecordBatch]:
    """Absolute candidates of each block, those of its first bytes with the bytes before them."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            lead = r["lead"] or b""
            first = hits(np.frombuffer(lead + r["head"], np.uint8), len(lead), mean)
            out.append([r["offset"] + int(x) for x in (*first, *r["found"])])
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.list_(pa.int64()))], names=["id", "block", "offset", "size", "hits"])


def _resolve(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """The ends of chunks in each block, in the order of the blob, with the number and begin of the chunk open at its begin."""
    who, begin, number = object(), 0, 0
    for b in batches:
        out = []
        for r in b.select(["id", "block", "offset", "size", "hits", "last"]).to_pylist():
            if r["id"] != who:
                who, begin, number = r["id"], 0, 0
            entry, ends = (number, begin), []
            end, found = r["offset"] + r["size"], np.array(r["hits"], np.int64)
            while True:
                i = np.searchsorted(found, begin + least)
                to = min(int(found[i]) if i < len(found) else begin + most, begin + most)
                if to > end:
                    break
                ends.append(to)
                begin, number = to, number + 1
            if r["last"] and begin < end:
                ends.append(end)
            out.append((*entry, ends))
        number_, begin_, ends_ = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number_, pa.int64()), pa.array(begin_, pa.int64()), pa.array(ends_, pa.list_(pa.int64()))], names=["id", "block", "number", "begin", "ends"])


_PIECE = "id {0}, idx long, offset long, at long, whole boolean, len long, hash string, data binary"


def _slice(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Chunks that lie in a block, with their digests, and pieces of those that don't, with their bytes."""
    names = ["id", "idx", "offset", "at", "whole", "len", "hash", "data"]
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            offset, number, begin, ends = (row.column(c)[0].as_py() for c in (1, 3, 4, 5))
            data = memoryview(row.column(2)[0].as_buffer() or b"")
            edge, out = offset + len(data), []
            for n, end in enumerate([*ends, None]):
                lo, hi = max(begin, offset), edge if end is None else end
                if lo < hi:
                    whole, part = begin >= offset and end is not None, data[lo - offset : hi - offset]
                    out.append((row.column(0)[0].as_py(), number + n, begin, lo, whole, len(part), hashlib.sha256(part).hexdigest() if whole else None, bytes(part) if keep or not whole else None))
                begin = end
            kinds = [row.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def chunk_blocks(blocks: DataFrame, profile: str = "text", keep: bool = False) -> DataFrame:
    """(id, idx, offset, len, hash, data) of every chunk of blobs given as blocks (id, block, offset, data binary).

    Blocks cover a blob in order without gaps from offset 0; all but the first and the last hold at least 64 bytes, which is checked.
    Cuts are those of the blob as one value. ``data`` is null unless ``keep``. A chunk is one value, of the profile's most
    bytes. A null id is a blob of its own; blobs without bytes have no chunks.
    """
    least, mean, most = PROFILES[profile]
    kind = blocks.schema["id"].dataType.simpleString()
    own = blocks.select("id", "block", F.col("offset").cast("long").alias("offset"), "data")
    block = own.schema["block"].dataType.simpleString()
    found = saved(own.mapInArrow(partial(_inside, mean=mean), f"id {kind}, block {block}, offset long, size long, found array<long>, head binary, tail binary"))
    by = Window.partitionBy("id").orderBy("block")  # a row a block, a few bytes each
    short = (F.col("size") < 64) & F.col("_behind").isNotNull() & F.col("lead").isNotNull()
    lined = found.withColumns({"lead": F.lag("tail").over(by), "_behind": F.lead("block").over(by)})
    lined = lined.withColumn("size", F.when(short, F.raise_error(F.lit("a block inside a blob holds fewer than 64 bytes")).cast("long")).otherwise(F.col("size")))
    some = lined.select("id", "block", "offset", "size", "found", "head", "lead")
    all_hits = some.mapInArrow(partial(_edges, mean=mean), f"id {kind}, block {block}, offset long, size long, hits array<long>")
    last = found.groupBy(F.col("id").alias("_id")).agg(F.max("block").alias("_last"))
    all_hits = all_hits.join(last, F.col("id").eqNullSafe(F.col("_id"))).withColumn("last", F.col("block") == F.col("_last")).drop("_last", "_id")
    spread = all_hits.repartition("id").sortWithinPartitions("id", "block")
    cuts = saved(spread.mapInArrow(partial(_resolve, least=least, most=most), f"id {kind}, block {block}, number long, begin long, ends array<long>"))
    named = cuts.withColumnsRenamed({"id": "_id", "block": "_block"})
    with_cuts = own.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block"))).select("id", "offset", "data", "number", "begin", "ends")
    pieces = saved(with_cuts.mapInArrow(partial(_slice, keep=keep), _PIECE.format(kind)))
    whole = pieces.where("whole").select("id", "idx", "offset", "len", "hash", "data")
    parts = F.array_sort(F.collect_list(F.struct("at", "data")))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    over = pieces.where("not whole").groupBy("id", "idx", "offset").agg(F.sum("len").alias("len"), parts.alias("p")).withColumn("data", joined)
    return whole.unionByName(over.select("id", "idx", "offset", "len", F.sha2("data", 256).alias("hash"), F.col("data") if keep else F.lit(None).cast("binary").alias("data")))


def verified(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, idx, offset, data, fault): the bytes of files of any size as rows in the order of ``idx``.

    ``entries`` are (file, idx, offset, len, hash), ``chunks`` the store's (hash, data binary). ``fault`` is null where a row is sound,
    else missing, digest, length or gap: an entry that doesn't begin where the one before it ends. A file is sound if all of its rows are.
    """
    good = chunks.select("hash", "data", (F.sha2("data", 256) == F.col("hash")).alias("_sound"))
    begin = F.coalesce(F.lag(F.col("offset") + F.col("len")).over(Window.partitionBy("file").orderBy("idx")), F.lit(0))
    e = entries.withColumn("_begin", begin).join(good, "hash", "left")
    fault = F.when(F.col("data").isNull(), "missing").when(~F.col("_sound"), "digest").when(F.octet_length("data") != F.col("len"), "length").when(F.col("offset") != F.col("_begin"), "gap")
    return e.select("file", "idx", "offset", "data", fault.alias("fault"))
