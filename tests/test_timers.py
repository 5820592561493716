"""Streams with timers give their batch twins' rows however their micro-batches were dealt, and keep no state for ever."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import activity as A
from tesserae.streaming import timers as T

SCHEMA = "user_id long, path long, event_id long, ms long, event_type string"
#: How far events are shuffled, and the watermark that waits for them.
LATE, DELAY = 4_000, "4 seconds"


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(T.STORE[0])
    T.use_rocksdb(spark)
    yield spark
    spark.conf.set(T.STORE[0], before)


def events():
    rng = random.Random(9)
    at = [0] * 6
    out = []
    for i in range(400):
        u = rng.randrange(6)
        at[u] += rng.choice([0, 100, 500, 1999, 2000, 2001, 7000])
        out.append((u, u, i, 10_000 + at[u], f"t{i % 3}"))
    return out


def dealt(rows, seed):
    """The rows in files, of which each event comes at most LATE after later ones; the last file only moves time on."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[3] + rng.randrange(LATE))
    cuts = sorted(rng.sample(range(1, len(order)), 5))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, None])] + [[(99, 99, 10**6, 10**9, "end")], [(99, 99, 10**6 + 1, 10**9 + 10**7, "end")]]


def run(spark, stream_of, files, path, restart=None):
    """All results but those of the key that only moves time on."""
    for n, rows in enumerate(files):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.parquet(f"{path}/staged/{n}")
    got = []
    (path / "in").mkdir()

    def keep(batch, n):
        got.extend(batch.collect())

    for n in range(len(files)):
        if n in (restart or [len(files) - 1]):
            pass
        for f in (path / "staged" / str(n)).glob("part-*"):
            f.rename(path / "in" / f"{n}-{f.name}")
        if n in (restart or []) or n == len(files) - 1:  # a query of its own goes on from the checkpoint
            s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
            q = stream_of(s).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
    return [r for r in got if r[0] != 99], q


@pytest.mark.parametrize("seed, restart", [(1, None), (2, [2, 4])])
def test_rate_limit(rocks, tmp_path, seed, restart):
    rows = events()
    got, q = run(rocks, lambda s: T.rate_limit(s, 2, 3_000, DELAY), dealt(rows, seed), tmp_path, restart)
    want = A.rate_limit(rocks.createDataFrame(rows, SCHEMA), 2, 3_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.allowed for r in got} == {True, False}


def test_debounce(rocks, tmp_path):
    rows = events()
    got, _ = run(rocks, lambda s: T.debounce(s, 2_000, DELAY), dealt(rows, 3), tmp_path)
    want = A.debounce(rocks.createDataFrame(rows, SCHEMA).select("path", "ms", "event_id"), 2_000).collect()
    assert sorted((r.path, r.settled_ms, r.events) for r in got) == sorted((r.path, r.settled_ms, r.events) for r in want)


def test_presence_ends_by_event_time(rocks, tmp_path):
    rows, ttl = events(), 5_000
    got, _ = run(rocks, lambda s: T.presence(s, ttl, DELAY), dealt(rows, 4), tmp_path)
    want = []
    for u in range(6):
        mine = sorted((r[3], r[2], r[4]) for r in rows if r[0] == u)
        for (ms, _, what), after in zip(mine, [*mine[1:], (10**9, 0, "")]):
            want.append((u, ms, what, True))
            if after[0] >= ms + ttl:
                want.append((u, ms + ttl, what, False))
    assert sorted(map(tuple, got)) == sorted(want)


def test_state_ends(rocks, tmp_path):
    """After time has moved on, no key but the last is left in any state."""
    _, q = run(rocks, lambda s: T.rate_limit(s, 2, 3_000, DELAY), dealt(events(), 5), tmp_path)
    for name in ("held", "armed"):
        left = rocks.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp"))
        assert {r.u for r in left.select(F.col("key.user_id").alias("u")).collect()} <= {99}
