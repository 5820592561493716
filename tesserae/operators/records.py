"""State records: last-writer-wins registers and append-only unions (family, key, ts_ms, device_id, payload, tombstone, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lww(records: DataFrame) -> DataFrame:
    """The winner of each register: greater (ts_ms, device_id), then a tombstone, then the first arrival."""
    rank = F.struct("ts_ms", "device_id", "tombstone", -F.col("seq"))
    return records.groupBy("family", "key").agg(F.max_by(F.struct("ts_ms", "device_id", "payload", "tombstone"), rank).alias("r")).select("family", "key", "r.*")


def content_id(family: str, key: str, payload: str) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("|", F.col(family), F.col(key).cast("string"), F.col(payload)), 256), 1, 32)


def union(records: DataFrame) -> DataFrame:
    """One row per content id; the first arrival stays."""
    r = records.withColumn("record_id", content_id("family", "key", "payload"))
    return r.groupBy("record_id").agg(F.min_by(F.struct("family", "key", "payload", "ts_ms", "device_id"), "seq").alias("r")).select("record_id", "r.*")


def revoked(records: DataFrame) -> DataFrame:
    """Keys whose winning record is a tombstone."""
    return lww(records).where("tombstone").select("family", "key")
