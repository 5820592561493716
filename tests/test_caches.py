"""Caches kept by a stream against a plain pass over all records."""

from __future__ import annotations

import random

import pytest

from tesserae.streaming import caches as K
from tesserae.streaming import streams as St

SCHEMA = "family string, key string, ts_ms long, device_id string, payload string, tombstone boolean, seq long"


def records():
    rng = random.Random(12)
    out = []
    for seq in range(500):
        family = rng.choice(["member", "review_link", "review_comment", "audit", "review_version", "unknown"])
        key = str(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, "x"])) if family == "review_version" else f"k{rng.randrange(8)}"
        out.append((family, key, rng.randrange(40), f"d{rng.randrange(3)}", f"p{seq}", rng.random() < 0.2 and family in K.LATEST.values(), seq))
    return out


LOCAL = {"k1": (38, "mine"), "k2": (5, "mine"), "k9": (1, "mine")}


def plain(rows):
    out = {}
    for name, family in K.LATEST.items():
        best = {}
        for r in rows:
            rank = (r[2], r[3], r[5], -r[6])
            if r[0] == family and (r[1] not in best or rank > best[r[1]][0]):
                best[r[1]] = rank, r
        have = {k: (at, p) for k, (at, p) in LOCAL.items()}
        for k, (_, r) in best.items():
            if r[5]:
                have.pop(k, None)
            elif k not in have or r[2] >= have[k][0]:
                have[k] = r[2], r[4]
        out[name] = have
    stack = {2: "mine"}
    for r in sorted(rows, key=lambda r: r[6]):
        if r[0] == "review_version" and r[1].isdigit():
            stack.setdefault(int(r[1]), r[4])
    out["versions"] = {n: (p, all(i in stack for i in range(1, n))) for n, p in stack.items()}
    first = {}
    for r in sorted(rows, key=lambda r: r[6]):
        if r[0] == "audit":
            first.setdefault(r[1], (r[2], r[4]))
    out["audit"] = first
    return out


def read(spark, path):
    local = spark.createDataFrame([(k, *v) for k, v in LOCAL.items()], "key string, at_ms long, payload string")
    out = {n: {r.key: (r.at_ms, r.payload) for r in K.current(spark, path, n, local).collect()} for n in K.LATEST}
    stack = K.versions(spark, path, spark.createDataFrame([(2, "mine")], "number long, payload string"))
    return out | {"versions": {r.number: (r.payload, r.enters) for r in stack.collect()}, "audit": {r.key: (r.ts_ms, r.payload) for r in K.audit(spark, path).collect()}}


def deal(spark, files, folder):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("order", ["as they came", "out of order", "some twice"])
def test_caches_equal_a_plain_pass(spark, tmp_path, order):
    rows = records()
    files = [rows[i::4] if order != "as they came" else rows[i * 125 : (i + 1) * 125] for i in range(4)]
    if order == "out of order":
        files.reverse()
    if order == "some twice":
        files.append(files[1])
    deal(spark, files, tmp_path / "in")
    src = St.replay(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    K.keep(src, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=3).awaitTermination(300)
    got = read(spark, str(tmp_path / "out"))
    assert got == plain(rows)
    assert {e for _, e in got["versions"].values()} == {True, False}  # 8 and 9 wait for 7


def test_a_batch_that_fails_between_tables_is_made_whole(spark, tmp_path, monkeypatch):
    rows = records()
    deal(spark, [rows[:250], rows[250:]], tmp_path / "in")
    out, cp, schema = str(tmp_path / "out"), str(tmp_path / "cp"), spark.createDataFrame([], SCHEMA).schema
    real, calls = St._fold_batch, []

    def fails_once(batch, n, merge, path, buckets):
        calls.append(path)
        if len(calls) == 8:
            raise OSError("a lost disk")
        real(batch, n, merge, path, buckets)

    monkeypatch.setattr(St, "_fold_batch", fails_once)
    q = K.keep(St.replay(spark, str(tmp_path / "in"), schema), out, cp, buckets=2)
    with pytest.raises(Exception, match="a lost disk"):
        q.awaitTermination(300)
    K.keep(St.replay(spark, str(tmp_path / "in"), schema), out, cp, buckets=2).awaitTermination(300)
    assert read(spark, out) == plain(rows)


def test_no_records(spark, tmp_path):
    local = spark.createDataFrame([("a", 1, "p")], "key string, at_ms long, payload string")
    assert [tuple(r) for r in K.current(spark, str(tmp_path), "members", local).collect()] == [("a", 1, "p")]
    assert K.versions(spark, str(tmp_path), spark.createDataFrame([], "number long, payload string")).count() == 0 == K.audit(spark, str(tmp_path)).count()
