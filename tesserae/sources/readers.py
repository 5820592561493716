"""Sources: timelines, notes, ledgers, files and packed objects as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.scalar import STATUS_WORDS, ignored, synonym
from tesserae.workers import by_value

by_value(__name__)

# Spellings of the columns of a notes table.
ALIASES = {"frame": ("frame", "frame number", "frames"), "rate": ("rate", "fps"), "body": ("body", "comment", "note", "notes", "text"), "author": ("author", "user", "by"), "status": ("status", "state"), "id": ("id",), "clip": ("clip", "clip name")}


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content) of every file below a folder that a scan does not ignore; paths are relative."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].split(":")[-1].rstrip("/")
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    return f.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content").where(~ignored("path"))


def notes_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, rejected) of CSV files with any of the known column spellings.

    A row needs a whole frame, a positive rate and a body (or a pin); an unknown status is OPEN and a missing id is derived.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    low = {c.strip().lower(): c for c in raw.columns}
    cols = {k: next((F.col(f"`{low[n]}`") for n in names if n in low), F.lit(None).cast("string")) for k, names in ALIASES.items()}
    pin = [F.expr(f"try_cast(`{low[n]}` as float)") if n in low else F.lit(None).cast("float") for n in ("pin_x", "pin_y")]
    n = raw.select(*(c.alias(k) for k, c in cols.items()), pin[0].alias("pin_x"), pin[1].alias("pin_y"))
    n = n.withColumns({"frame": F.expr("try_cast(trim(frame) as bigint)"), "rate": F.expr("try_cast(trim(rate) as bigint)"), "body": F.trim(F.coalesce("body", F.lit("")))})
    bad = F.when(F.col("frame").isNull(), "frame").when(~F.coalesce(F.col("rate") > 0, F.lit(False)), "rate").when((F.col("body") == "") & F.col("pin_x").isNull(), "body")
    n = n.withColumn("problem", bad)
    derived = F.substring(F.sha2(F.concat_ws("\x1f", F.col("clip"), F.col("frame").cast("string"), F.col("rate").cast("string"), "body", "author"), 256), 1, 16)
    good = n.where("problem is null").withColumns({"status": F.coalesce(synonym("status", STATUS_WORDS, True), F.lit("OPEN")), "id": F.coalesce(F.when(F.trim("id") != "", F.col("id")), derived)})
    return good.drop("problem"), n.where("problem is not null").select("frame", "rate", "body", "problem")


def ledger(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """JSON ledger files (one document each, with a ``schema`` tag); documents with another tag are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"schema string, entries array<{schema}>").alias("j"))
    return rows.where(F.col("j.schema") == tag).select(F.explode("j.entries").alias("e")).select("e.*")


# Packed objects: a magic, the number of objects, then (32-byte digest, length, bytes) each.

PACK_MAGIC = b"TPAK\x01"


def parse_pack(data: bytes) -> list[tuple[str, int, bytes]]:
    """(digest hex, offset of the bytes, bytes) of every object of a pack, plain or compressed; damaged packs raise ValueError."""
    if data.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        try:
            data = zstandard.ZstdDecompressor().decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError("damaged") from e
    if not data.startswith(PACK_MAGIC):
        raise ValueError("not a pack")
    (count,) = struct.unpack_from("<I", data, len(PACK_MAGIC))
    at, out = len(PACK_MAGIC) + 4, []
    for _ in range(count):
        if at + 36 > len(data):
            raise ValueError("cut off")
        digest, n = data[at : at + 32].hex(), struct.unpack_from("<I", data, at + 32)[0]
        if at + 36 + n > len(data):
            raise ValueError("cut off")
        out.append((digest, at + 36, data[at + 36 : at + 36 + n]))
        at += 36 + n
    if at != len(data):
        raise ValueError("bytes after the last object")
    return out


def packs(blobs: DataFrame) -> DataFrame:
    """(path, hash, offset, data, valid) of the objects in packs (path, content); valid compares the digest with the bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, h, at, d, hashlib.sha256(d).hexdigest() == h) for h, at, d in parse_pack(bytes(content))]
                except ValueError:
                    rows.append((path, None, None, None, False))
            yield pd.DataFrame(rows, columns=["path", "hash", "offset", "data", "valid"]).astype({"offset": "Int64"})

    return blobs.select("path", "content").mapInPandas(run, "path string, hash string, offset long, data binary, valid boolean")
