"""Structured Streaming twins of the batch operators; each gives its batch twin's rows on the same input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import records as R
from tesserae.operators.journal import fold


def replay(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """A journal folder as a stream; the checkpoint is the cursor, so every entry is handed on at least once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@dataclass(frozen=True)
class Merge:
    """How batches become state rows, which rows belong together, and how those of one key are combined."""

    prepare: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]
    key: tuple[str, ...]


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _children(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name``=number below a path."""
    p, fs = _folder(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(name + "="))


def _latest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """The finished versions of each bucket, oldest first, of those below a number."""
    out: dict[int, list[int]] = {}
    for v in _children(spark, path, "v"):
        done, fs = _folder(spark, f"{path}/v={v}/_SUCCESS")
        if (below is None or v < below) and fs.exists(done):
            for b in _children(spark, f"{path}/v={v}", "bucket"):
                out.setdefault(b, []).append(v)
    return out


def state(spark: SparkSession, path: str, buckets: set[int] | None = None, below: int | None = None) -> DataFrame | None:
    """The newest rows of all buckets of a table written by :func:`to_table`, or None if there are none."""
    paths = [f"{path}/v={vs[-1]}/bucket={b}" for b, vs in _latest(spark, path, below).items() if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def _fold_batch(batch: DataFrame, n: int, merge: Merge, path: str, buckets: int) -> None:
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*merge.key), F.lit(buckets)).cast("int")
    new = merge.prepare(batch).withColumn("bucket", bucket).persist()
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
    before = state(spark, path, touched, n)
    rows = new.drop("bucket") if before is None else new.drop("bucket").unionByName(before)
    merge.combine(rows).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={n}")
    new.unpersist()
    for b, versions in _latest(spark, path).items():
        for v in versions[:-2]:
            old, fs = _folder(spark, f"{path}/v={v}/bucket={b}")
            fs.delete(old, True)


def to_table(stream: DataFrame, merge: Merge, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold each micro-batch into a table of buckets by key: only those that it touches are read and written again.

    A batch writes a version of its buckets from versions before it, and a batch that is repeated writes its
    own again, so the result is exactly once. Of each bucket the two newest versions stay.
    """

    def step(batch: DataFrame, n: int) -> None:
        _fold_batch(batch, n, merge, path, buckets)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_tables(stream: DataFrame, merges: dict[str, Merge], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """As :func:`to_table` into several tables below ``path``, all of them from one batch under its number.

    A batch that fails between two tables is repeated for all; those that it had written are written again the same.
    """

    def step(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, merge in merges.items():
            _fold_batch(batch, n, merge, f"{path}/{name}", buckets)
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _registers(rows: DataFrame) -> DataFrame:
    """The arrival number stays in the state as the last tie-break."""
    rank = F.struct("ts_ms", "device_id", "tombstone", -F.col("seq"))
    return rows.groupBy("family", "key").agg(F.max_by(F.struct("ts_ms", "device_id", "payload", "tombstone", "seq"), rank).alias("r")).select("family", "key", "r.*")


def _union(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record_id").agg(F.min_by(F.struct("family", "key", "payload", "ts_ms", "device_id", "seq"), "seq").alias("r")).select("record_id", "r.*")


def _paths(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("project_id", "path")]
    return rows.groupBy("project_id", "path").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("project_id", "path", "r.*")


#: Last-writer-wins registers; an echo older than what is there changes nothing.
REGISTERS = Merge(lambda b: b.select("family", "key", "ts_ms", "device_id", "payload", "tombstone", "seq"), _registers, ("family", "key"))
#: Append-only union by content id.
UNION = Merge(lambda b: b.withColumn("record_id", R.content_id("family", "key", "payload")).select("record_id", "family", "key", "payload", "ts_ms", "device_id", "seq"), _union, ("record_id",))
#: Current path states of journal entries.
PATHS = Merge(fold, _paths, ("project_id", "path"))


def deduplicate(stream: DataFrame, delay: str) -> DataFrame:
    """Appends without repeats of a request id within the watermark (ts)."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["project_id", "request_id"])


def debounce(stream: DataFrame, quiet: str, delay: str) -> DataFrame:
    """(path, settled, events): one row per burst of a path (ts), given out once the watermark has passed it.

    Events exactly ``quiet`` apart belong to one burst, as in the batch form.
    """
    s = stream.withWatermark("ts", delay).groupBy("path", F.session_window("ts", quiet)).agg(F.count("*").alias("events"))
    return s.select("path", F.col("session_window.end").alias("settled"), "events")


def uploaded(stream: DataFrame, delay: str) -> DataFrame:
    """Bytes per tenant and day of (tenant, ts, bytes); an updating aggregate."""
    return stream.withWatermark("ts", delay).groupBy("tenant", F.window("ts", "1 day").alias("w")).agg(F.sum("bytes").alias("bytes_uploaded"))
