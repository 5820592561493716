"""Sinks: notes, change lists, canonical JSON, packs and audit rows."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalar import timecode
from tesserae.operators.store import prefix_until
from tesserae.scratch import saved
from tesserae.sources.readers import PACK_MAGIC, packs
from tesserae.workers import by_value

by_value(__name__)

NOTE_COLUMNS = ["id", "frame", "rate", "timecode", "clip", "author", "status", "body", "kind", "range_end", "pin_x", "pin_y", "attachment", "visibility"]


def visible(notes: DataFrame, visibility: str | None) -> DataFrame:
    return notes if visibility is None else notes.where(F.col("visibility") == visibility)


def notes_csv(notes: DataFrame, path: str, visibility: str | None = None) -> None:
    """Write notes as CSV in the order of frame, rate and id; fields are quoted only where they need it."""
    n = visible(notes, visibility).withColumn("timecode", timecode("frame", "rate"))
    pin = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c)))
    rows = n.select(*(pin(c).alias(c) if c.startswith("pin_") else F.col(c).cast("string").alias(c) for c in NOTE_COLUMNS), F.col("frame").alias("_f"), F.col("rate").alias("_r"))
    rows.orderBy("_f", "_r", "id").drop("_f", "_r").write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def edl_events(clips: DataFrame, rate: int) -> DataFrame:
    """(doc, line_no, line): CMX-style lines of clips (doc, idx, name, pos, dur) in frames."""
    tc = lambda f: timecode(f, F.lit(rate))
    line = F.format_string("%03d  %-8s V     C        %s %s %s %s", F.col("idx").cast("int") + 1, F.substring(F.upper("name"), 1, 8), tc(F.lit(0)), tc(F.col("dur")), tc(F.col("pos")), tc(F.col("pos") + F.col("dur")))
    return clips.select("doc", F.col("idx").alias("line_no"), line.alias("line"))


def canonical(columns: list[str]) -> Column:
    """One JSON object with its keys in order and without nulls."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "true"})


def fcpxml_markers(notes: DataFrame) -> DataFrame:
    """(doc, frame, line): a marker element for each note (doc, frame, rate, body), with exact times and escaped text."""
    text = F.col("body")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return notes.select("doc", "frame", F.format_string('<marker start="%d/%ds" duration="1/%ds" value="%s"/>', F.col("frame").cast("long"), F.col("rate").cast("long"), F.col("rate").cast("long"), text).alias("line"))


def pack_objects(objects: DataFrame, target: int = 64 << 20, level: int = 3) -> DataFrame:
    """(pack, n, raw_bytes, content) of objects (hash hex, data), in order of their hashes, each pack of about ``target`` bytes.

    Packs are cut by a running sum of sizes, so each is built in a group of bounded size; contents are compressed with zstandard.
    """

    def build(rows: pa.Table) -> pa.Table:
        import zstandard

        rows = rows.sort_by("hash")
        body = b"".join(bytes.fromhex(h.as_py()) + struct.pack("<I", len(d.as_buffer())) + d.as_py() for h, d in zip(rows.column("hash"), rows.column("data")))
        raw = PACK_MAGIC + struct.pack("<I", rows.num_rows) + body
        return pa.table({"pack": rows.column("pack")[:1], "n": pa.array([rows.num_rows], pa.int64()), "raw_bytes": pa.array([len(raw)], pa.int64()), "content": pa.array([zstandard.ZstdCompressor(level=level).compress(raw)], pa.binary())})

    # sizes alone are placed; data moves once to lose its copies and once to its pack
    sizes = objects.groupBy("hash").agg(F.max(F.octet_length("data").cast("long") + 36).alias("_size"))
    placed = prefix_until(sizes, ["hash"], "_size", []).select("hash", F.floor(F.col("before") / target).alias("pack"))
    one = objects.select("hash", "data").dropDuplicates(["hash"])
    return one.join(placed, "hash").groupBy("pack").applyInArrow(build, "pack long, n long, raw_bytes long, content binary")


def write_packs(objects: DataFrame, path: str, target: int = 64 << 20) -> DataFrame:
    """Write packs and, once every object was read back and its digest held, the index (hash, pack, offset) that readers use.

    Until the index is there nothing points to the packs, so a failed write leaves the store as it was.
    """
    spark = objects.sparkSession
    pack_objects(objects, target).write.parquet(f"{path}/packs")
    back = packs(spark.read.parquet(f"{path}/packs").select(F.col("pack").cast("string").alias("path"), "content"))
    index = saved(back.select("hash", F.col("path").cast("long").alias("pack"), "offset", "valid"))
    if index.where("not valid").take(1) or index.count() != objects.select("hash").distinct().count():
        raise RuntimeError("a pack does not hold what was put in it")
    index.drop("valid").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def audit(rows: DataFrame, path: str) -> None:
    """Append audit rows (tenant, actor, action, resource, detail, ts_ms) to a table partitioned by tenant."""
    rows.select("tenant", "actor", "action", "resource", "detail", "ts_ms").write.mode("append").partitionBy("tenant").parquet(path)


