"""Each stream gives its batch twin's rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserae.operators import activity as A
from tesserae.operators import journal as J
from tesserae.operators import records as R
from tesserae.plans.derived import journal
from tesserae.plans.journal import _records
from tesserae.streaming import streams as St


def _parts(df, path, n=3, key="seq"):
    """The rows in n files, oldest first."""
    cuts = df.approxQuantile(key, [i / n for i in range(1, n)], 0.01)
    lo = None
    for hi in [*cuts, None]:
        part = df if lo is None else df.where(F.col(key) > lo)
        (part if hi is None else part.where(F.col(key) <= hi)).coalesce(1).write.mode("append").parquet(path)
        lo = hi


def _rows(df, cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("what", ["registers", "union", "paths"])
def test_incremental_merge(what, spark, sf_dir, tmp_path):
    src = journal(spark, sf_dir) if what == "paths" else _records(spark, sf_dir)
    _parts(src, str(tmp_path / "in"))
    merge = {"registers": St.REGISTERS, "union": St.UNION, "paths": St.PATHS}[what]
    out = str(tmp_path / "out")
    q = St.to_table(St.replay(spark, str(tmp_path / "in"), src.schema), merge, out, str(tmp_path / "cp"), buckets=8)
    q.awaitTermination(120)
    assert q.exception() is None
    want = {"registers": R.lww, "union": R.union, "paths": J.fold}[what](src)
    assert _rows(St.state(spark, out), want.columns) == _rows(want, want.columns)
    assert all(len(v) <= 2 for v in St._latest(spark, out).values())


def test_a_repeated_batch_changes_nothing_and_others_buckets_stay(spark, sf_dir, tmp_path):
    src = _records(spark, sf_dir)
    _parts(src, str(tmp_path / "in"), 2)
    out = str(tmp_path / "out")
    for checkpoint in ("a", "b"):  # the second run repeats both batches
        St.to_table(St.replay(spark, str(tmp_path / "in"), src.schema), St.REGISTERS, out, str(tmp_path / checkpoint), buckets=4).awaitTermination(120)
    want = R.lww(src)
    assert _rows(St.state(spark, out), want.columns) == _rows(want, want.columns)
    one = src.where("family = 'click' and key = 1").withColumn("ts_ms", F.col("ts_ms") + 10**6)
    before = St._latest(spark, out)
    one.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    St.to_table(St.replay(spark, str(tmp_path / "in"), src.schema), St.REGISTERS, out, str(tmp_path / "b"), buckets=4).awaitTermination(120)
    after = St._latest(spark, out)
    assert sum(before[b][-1] != after[b][-1] for b in after) == 1


def _collect(stream, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName("t" + str(abs(hash(str(tmp_path))))).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q.name


def test_debounce(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("path"), (F.col("event_id") * 700).alias("ms"), "event_id")
    e = e.withColumn("ts", F.timestamp_millis("ms"))
    far = spark.createDataFrame([(99, 10**12, 10**9)], "path long, ms long, event_id long").withColumn("ts", F.timestamp_millis("ms"))
    _parts(e.unionByName(far), str(tmp_path / "in"), key="event_id")
    name = _collect(St.debounce(St.replay(spark, str(tmp_path / "in"), e.schema, per_batch=9), "2 seconds", "1 second"), tmp_path, "append")
    want = A.debounce(e.select("path", "ms", "event_id"), 2000)
    got = spark.table(name).where("path <> 99").select("path", F.unix_millis("settled").alias("settled_ms"), "events")
    assert _rows(got, ["path", "settled_ms", "events"]) == _rows(want, ["path", "settled_ms", "events"])


def test_deduplicate_and_uploaded(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3).alias("project_id"), F.col("event_id"), (F.floor(F.col("event_id") / 2)).cast("string").alias("request_id"), F.timestamp_millis(F.col("event_id") * 60_000 + 10**9).alias("ts"))
    _parts(e, str(tmp_path / "in"), key="event_id")
    name = _collect(St.deduplicate(St.replay(spark, str(tmp_path / "in"), e.schema), "1 day"), tmp_path, "append")
    want = e.groupBy("project_id", "request_id").count()
    assert _rows(spark.table(name), ["project_id", "request_id"]) == _rows(want, ["project_id", "request_id"])
    up = e.select((F.col("project_id")).alias("tenant"), "ts", F.col("event_id").alias("bytes"))
    (tmp_path / "b").mkdir()
    _parts(up, str(tmp_path / "b" / "in"), key="bytes")
    name = _collect(St.uploaded(St.replay(spark, str(tmp_path / "b" / "in"), up.schema), "1 day"), tmp_path / "b", "update")
    last = spark.table(name).groupBy("tenant", F.col("w.start").alias("day")).agg(F.max("bytes_uploaded").alias("n"))
    plain = up.groupBy("tenant", F.date_trunc("day", "ts").alias("day")).agg(F.sum("bytes").alias("n"))
    assert _rows(last, ["tenant", "day", "n"]) == _rows(plain, ["tenant", "day", "n"])
