"""Blobs as blocks against the byte loop over the whole, and files put together again."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesserae import plans
from tesserae.operators import blobs as B
from tesserae.operators import chunking as K
from tesserae.operators import views as V
from tesserae.operators.chunking import PROFILES, gear_table


def plain_cuts(data, least, mean, most):
    """Ends of chunks, byte by byte."""
    table, gear, begin, out = [int(x) for x in gear_table()], 0, 0, []
    for i, byte in enumerate(data):
        gear = ((gear << 1) + table[byte]) & ((1 << 64) - 1)
        n = i + 1 - begin
        if n >= most or (n >= least and gear & (mean - 1) == 0):
            out.append(i + 1)
            begin = i + 1
    return out + ([len(data)] if begin < len(data) else [])


def plain_chunks(data):
    out, begin = [], 0
    for i, end in enumerate(plain_cuts(data, *PROFILES["text"])):
        out.append((i, begin, end - begin, hashlib.sha256(data[begin:end]).hexdigest()))
        begin = end
    return out


def cut_up(data, rng, least, most):
    at, out = 0, []
    while at < len(data):
        n = rng.randint(least, most)
        out.append((at, data[at : at + n]))
        at += n
    return out


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    return {
        "random, 70 blocks": (rng.randbytes(70_000), 800, 1200), "short blocks": (rng.randbytes(9_000), 64, 70), "one block": (rng.randbytes(5_000), 5_000, 5_000),
        "zeros: only forced cuts": (bytes(30_000), 100, 3_000), "repeats": (b"abc\xff" * 6_000, 500, 900), "one byte": (b"x", 1, 1), "none": (b"", 1, 1),
    }


def as_rows(some, rng):
    rows = []
    for name, (data, least, most) in some.items():
        blocks = cut_up(data, rng, least, most) or [(0, b"")]
        rows += [(name, n, at, bytearray(part)) for n, (at, part) in enumerate(blocks)]
    rng.shuffle(rows)
    return rows


def test_blocks_give_the_cuts_of_the_whole(spark, some):
    rows = as_rows(some, random.Random(5))
    assert sum(r[0] == "random, 70 blocks" for r in rows) > 64
    df = spark.createDataFrame(rows, "id string, block int, offset long, data binary").repartition(7)
    got = B.chunk_blocks(df, keep=True).collect()
    for name, (data, _, _) in some.items():
        mine = sorted((r.idx, r.offset, r.len, r.hash) for r in got if r.id == name)
        assert mine == plain_chunks(data), name
        assert b"".join(bytes(r.data) for r in sorted((r for r in got if r.id == name), key=lambda r: r.idx)) == data
    assert all(r.data is None for r in B.chunk_blocks(df).collect())


def test_queries_equal_the_byte_loop(spark, sf_dir):
    """Over all rows of the tables: documents alone, and the blob of all documents of a source."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    alone = {}
    for r in plans.queries()["cdc_chunks"](spark, sf_dir).collect():
        alone.setdefault(r.id, []).append((r.idx, r.offset, r.len, r.hash))
    assert {k: sorted(v) for k, v in alone.items()} == {r.doc_id: c for r in rows if (c := plain_chunks((r.text or "").encode()))}
    blobs, got = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        blobs[r.source] = blobs.get(r.source, b"") + (r.text or "").encode() + hashlib.sha256(str(r.doc_id).encode()).hexdigest().encode()
    for r in plans.queries()["blob_chunks"](spark, sf_dir).collect():
        got.setdefault(r.id, []).append((r.idx, r.offset, r.len, r.hash))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_chunks(v) for k, v in blobs.items()}


def test_blocks_edges(spark):
    schema = "id string, block int, offset long, data binary"
    assert B.chunk_blocks(spark.createDataFrame([], schema)).count() == 0
    null = spark.createDataFrame([(None, 0, 0, bytearray(b"ab"))], schema)
    assert [(r.id, r.idx, r.len) for r in B.chunk_blocks(null).collect()] == [(None, 0, 2)]
    short = [("a", n, 100 * n if n < 2 else 110, bytearray(100 if n != 1 else 10)) for n in range(3)]
    with pytest.raises(Exception, match="fewer than 64 bytes"):
        B.chunk_blocks(spark.createDataFrame(short, schema)).count()


def test_reassembly_is_byte_exact_and_finds_faults(spark, some):
    rows = as_rows(some, random.Random(6))
    chunks = B.chunk_blocks(spark.createDataFrame(rows, "id string, block int, offset long, data binary"), keep=True).persist()
    store = chunks.select("hash", "data").dropDuplicates(["hash"])
    entries = chunks.select(F.col("id").alias("file"), "idx", "offset", "len", "hash")
    out = B.verified(entries, store).collect()
    assert all(r.fault is None for r in out)
    whole = {r.file: (bytes(r.content), r.valid) for r in V.assembled(entries.select("file", "idx", "hash"), store).collect()}
    for name, (data, _, _) in some.items():
        assert b"".join(bytes(r.data) for r in sorted((r for r in out if r.file == name), key=lambda r: r.idx)) == data
        assert not data or whole[name] == (data, True)
    name = "random, 70 blocks"
    first = next(r.hash for r in chunks.where(F.col("id") == name).where("idx = 0").collect())
    broken = store.withColumn("data", F.when(F.col("hash") == first, F.lit(b"other")).otherwise(F.col("data")))
    faults = {(r.file, r.idx): r.fault for r in B.verified(entries.where("idx <> 2"), broken).collect() if r.fault}
    assert faults[name, 0] == "digest" and faults[name, 3] == "gap"
    assert {r.fault for r in B.verified(entries, store.where(F.col("hash") != first)).where("fault is not null").collect()} == {"missing"}


def test_characters_cut_in_two(spark):
    text = "é€😀\n" * 50
    raw = text.encode() + b"\xff\xfe"
    parts = [raw[i : i + 7] for i in range(0, len(raw), 7)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    entries = spark.createDataFrame([("f", i, sha(p)) for i, p in enumerate(parts)], "file string, idx int, hash string")
    store = spark.createDataFrame([(sha(p), bytearray(p)) for p in set(parts)], "hash string, data binary")
    r = V.assembled(entries, store).first()
    assert bytes(r.content) == raw and r.valid


def test_a_lost_binary_shard_comes_back(spark):
    rng = random.Random(8)
    shards = [(s, i, bytearray(rng.randbytes(rng.randrange(1, 90)))) for s in range(6) for i in range(4)]
    every = spark.createDataFrame(shards, "stripe long, shard long, data binary")
    sizes = every.select("stripe", "shard", F.octet_length("data").alias("size"))
    parity = K.xor_parity(every)
    left = every.where("not (shard = stripe % 4) and not (stripe = 5 and shard = 3)")
    got = {(r.stripe, r.shard): bytes(r.data) for r in K.recover(left, parity, sizes).collect()}
    assert got == {(s, i): bytes(d) for s, i, d in shards if i == s % 4 and s < 5}


def test_zstd_functions_share_a_worker(spark):
    """Packing and unpacking, plain and with words, are one evaluation of Python, not one process for each."""
    from conftest import DATA
    from pyspark.sql import functions as F

    from tesserae.functions import exact as X
    from tesserae.plans import queries

    d = spark.createDataFrame([(b"",), (None,), (b"ab" * 9000,)], "x binary")
    words = b"ab" * 300
    out = d.select("x", X.unzstd(X.zstd("x")).alias("a"), X.unzstd(X.zstd("x", words=words), words=words).alias("b"), X.zstd_size("x").alias("n"), X.unzstd(F.lit(b"no")).alias("bad"))
    plan = queries()["zstd_round_trip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = out.collect()
    assert all(r.x == r.a == r.b and r.bad is None for r in got) and [r.n is None for r in got] == [False, True, False]
