"""Several caches kept from one stream of records: members, links, comments, audit rows and numbered versions.

The records (family, key, ts_ms, device_id, payload, tombstone, seq) are the truth; a cache is what they and the local
rows say together. Each is a table of buckets that a batch writes under its number, so batches may come late, again or in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.store import numbered
from tesserae.streaming.streams import REGISTERS, Merge, state, to_tables

#: Families whose latest record counts, and those whose first does.
LATEST, FIRST = {"members": "member", "links": "review_link", "comments": "review_comment"}, {"audit": "audit", "versions": "review_version"}
_COLUMNS = ["family", "key", "ts_ms", "device_id", "payload", "tombstone", "seq"]


def _of(family: str):
    return lambda batch: batch.where(F.col("family") == family).select(*_COLUMNS)


def _first(rows: DataFrame) -> DataFrame:
    """The first record of a key stays, whatever comes later."""
    rest = [c for c in _COLUMNS if c not in ("family", "key")]
    return rows.groupBy("family", "key").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("family", "key", "r.*")


CACHES = {n: Merge(_of(f), REGISTERS.combine, ("family", "key")) for n, f in LATEST.items()} | {n: Merge(_of(f), _first, ("family", "key")) for n, f in FIRST.items()}


def keep(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """All caches from one stream of records; records of other families are left out."""
    return to_tables(stream.select(*_COLUMNS), CACHES, path, checkpoint, buckets)


def _records(spark: SparkSession, path: str, name: str) -> DataFrame:
    kept = state(spark, f"{path}/{name}")
    kinds = "key string, ts_ms long, payload string, tombstone boolean, seq long"
    return spark.createDataFrame([], kinds) if kept is None else kept.select("key", "ts_ms", "payload", "tombstone", "seq")


def current(spark: SparkSession, path: str, name: str, local: DataFrame) -> DataFrame:
    """(key, at_ms, payload) of a cache whose latest records count, with the rows (key, at_ms, payload) that the machine has itself.

    A tombstone removes the row always. A live record takes its place unless it is older than the local row, whose own record is still on its way.
    """
    r = _records(spark, path, name).select("key", F.struct("ts_ms", "payload", "tombstone").alias("r"))
    j = local.select("key", F.struct("at_ms", "payload").alias("l")).join(r, "key", "full")
    gone = F.coalesce(F.col("r.tombstone"), F.lit(False))
    own = F.col("r").isNull() | (F.col("l").isNotNull() & (F.col("r.ts_ms") < F.col("l.at_ms")))
    return j.where(~gone).select("key", F.when(own, F.col("l.at_ms")).otherwise(F.col("r.ts_ms")).alias("at_ms"), F.when(own, F.col("l.payload")).otherwise(F.col("r.payload")).alias("payload"))


def versions(spark: SparkSession, path: str, local: DataFrame) -> DataFrame:
    """(number, payload, enters): the stack of numbered versions; a number that the machine has itself (number, payload) is never rewritten.

    A version ``enters`` once all before it, from 1 on, are there; those behind a gap wait. Keys that are no number are left out.
    """
    r = _records(spark, path, "versions").select(F.expr("try_cast(key as bigint)").alias("number"), "payload").where("number > 0")
    both = local.select("number", "payload").unionByName(r.join(local.select("number"), "number", "left_anti")).dropDuplicates(["number"])
    return numbered(both, ["number"], [], "_at").select("number", "payload", (F.col("number") == F.col("_at") + 1).alias("enters"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """(key, ts_ms, payload): each decision once, as first written."""
    return _records(spark, path, "audit").select("key", "ts_ms", "payload")
