"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three
bits have a segment that differs in at most one, so each fingerprint is indexed under both segments
exactly and with each single bit struck out (66 keys). Equal keys are joined and the pair is verified
on all 64 bits. A struck-out key joins only rows whose struck bit differs, so a pair meets once for
each segment and not once for each of its variants. Keys with many rows are cut again the same way on
the other segment (two halves of 16 bits, then two quarters of 8), until at most 256 rows can share a
side of a key; no key is capped and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from xxhash import xxh64_digest

from tesserae.llm._shared import Scratch, connected_components, fresh, has_rows, map_arrow, ship

ship(__name__)

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: A key with more rows than this is cut again on the rest of the fingerprint.
HOT_KEY = 64
#: Shingles hashed at once, so that a very long text needs bounded memory.
BLOCK = 60_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        total, counts = 1, _bits([xxh64_digest(words[0], SEED)])
    else:
        total, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
        for at in range(0, total, BLOCK):
            w = words[at : min(at + BLOCK, total) + SHINGLE - 1]
            counts += _bits([xxh64_digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(SHINGLE)))])
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _bits(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint16).astype(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "hash"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, hash long) of every row; fp holds the 64 bits as a signed long, hash is that of the whole text."""
    text = F.col(text_col).cast("string")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _hash(text).alias("hash")), _fingerprints, "doc_id long, fp long, hash long")


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _indexed(fps: DataFrame) -> DataFrame:
    """First level: (key, side, fp, rep, rest): both segments, exact or with one bit struck out."""
    c = F.col("code")
    bit = (c % 33 - 1).cast("int")
    seg = F.when(c < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    rest = F.when(c < 33, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    return _cut(fps.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("code")).select("fp", "rep", "code", seg.alias("seg"), rest.alias("rest"), bit.alias("bit"), F.lit(0).cast("long").alias("key"), F.lit(-1).alias("side")))


def _cut(rows: DataFrame) -> DataFrame:
    """Extend the key by a segment with at most one bit struck out; side tells the struck bit, and -1 that none is."""
    struck = F.expr("(shiftright(seg, bit) & 1)").cast("int")
    masked = F.expr("if(bit < 0, seg, seg & ~shiftleft(1L, bit))")
    apart = F.expr("if(bit < 0 or side < 0, 0, ((shiftright(seg, bit) & 1) ^ side))").cast("int")
    side = F.when(F.col("side") >= 0, F.col("side")).when(F.col("bit") >= 0, struck).otherwise(F.lit(-1))
    return rows.select("fp", "rep", "rest", F.xxhash64("key", "code", masked, apart).alias("key"), side.alias("side"))


def _recut(rows: DataFrame, width: int) -> DataFrame:
    """Cut the rest of each fingerprint (2 * width bits) into two segments of that width."""
    c = F.col("code")
    half, mask = width + 1, (1 << width) - 1
    high = F.shiftrightunsigned("rest", width)
    low = F.col("rest").bitwiseAND(F.lit(mask).cast("long"))
    seg, other = F.when(c < half, high).otherwise(low), F.when(c < half, low).otherwise(high)
    return _cut(rows.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1)))).select("fp", "rep", "key", "side", "code", seg.alias("seg"), other.alias("rest"), (c % half - 1).cast("int").alias("bit")))


def _pairs(rows: DataFrame) -> DataFrame:
    a = rows.where("side <= 0").select("key", "side", F.col("fp").alias("fa"), F.col("rep").alias("u"))
    b = rows.where("side <> 0").select("key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS
    return a.join(b, "key").where(near & ((F.col("side") == 0) | (F.col("fa") < F.col("fb")))).select("u", "v")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): the representatives of different fingerprints (fp, rep) that differ in at most three bits.

    Every linked pair appears at least once. At each level only keys with at least two rows go on.
    """
    parts = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, rows = None, _indexed(fps.repartition(parts, "fp"))  # each row becomes 66: they start on all cores
    for level, width in ((1, 16), (2, 8), (3, None)):
        n = rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2")
        rows = scratch.write(rows.join(n, "key"), f"keys-{level}")
        cold = rows if width is None else rows.where(F.col("n") <= HOT_KEY)
        found = scratch.write(_pairs(cold.drop("n")), f"links-{level}")
        out = found if out is None else out.unionByName(found)
        if width is None:
            break
        rows = _recut(rows.where(F.col("n") > HOT_KEY).drop("n"), width)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), one row per input row.

    Documents whose fingerprints differ in at most three bits are linked; component_id is the smallest
    doc_id reachable. Null and blank texts have the fingerprint zero and link like any other. Repeated
    rows are reported once each. A null doc_id is reported with the component of its fingerprint (null
    if nothing else has an id). An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.write(fingerprints(docs, id_col, text_col).select("doc_id", "fp"), "each")
    reps = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    comp = connected_components(links(reps.where("rep is not null"), scratch), scratch)
    named = reps.join(comp, reps.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.write(named, "named")
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs`` whose fingerprints link, with all its columns: that of the smallest id.

    Rows with the same id are told apart by their texts; of rows with both the same one stays. Rows
    without an id link like any other and go where their group has an id; of a group without any id the
    text with the smallest hash stays. Null and blank texts are one group. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    each = scratch.write(fingerprints(docs, id_col, text_col), "each")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "hash").alias("first")
    reps = scratch.write(each.groupBy("fp").agg(F.min(first).alias("first")), "reps")
    comp = connected_components(links(reps.select("fp", F.col("fp").alias("rep")), scratch), scratch)
    a, b, c = (fresh(n, docs.columns) for n in ("won_id", "won_hash", "times"))
    won = reps.join(comp, reps.fp == comp.node, "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    won = scratch.write(won.select(F.col("first.id").alias(a), F.col("first.hash").alias(b)), "won")
    times = each.groupBy("doc_id", "hash").agg(F.count("*").alias(c)).where(F.col(c) > 1)
    won = scratch.write(won.join(times, F.col(a).eqNullSafe(F.col("doc_id")) & (F.col(b) == F.col("hash")), "left").select(a, b, c), "once")
    text = F.col(text_col).cast("string")
    rows = docs.join(won, F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (_hash(text) == F.col(b)))
    kept = rows.where(F.col(c).isNull()).select(*docs.columns)
    if not has_rows(won.where(F.col(c).isNotNull())):
        return kept
    return kept.unionByName(rows.where(F.col(c).isNotNull()).dropDuplicates([a, b]).select(*docs.columns))
