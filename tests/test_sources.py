from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import exact as X
from tesserae.sources import objects as O
from tesserae.sources import readers as Rd
from tesserae.sources import writers as W

def test_notes_round_trip(spark, tmp_path):
    schema = "id string, frame long, rate long, clip string, author string, status string, body string, kind string, range_end long, pin_x float, pin_y float, attachment string, visibility string"
    notes = spark.createDataFrame([("n1", 5, 24, "c,1", "ann", "OPEN", 'say "hi", twice\nplease', "comment", None, None, None, None, "public"), ("n2", 1, 24, None, "bo", "RESOLVED", "x", "comment", None, 0.5, 0.25, None, "internal")], schema)
    W.notes_csv(notes, str(tmp_path / "out"))
    good, bad = Rd.notes_csv(spark, str(tmp_path / "out"))
    got = {r.id: (r.frame, r.rate, r.status, r.body) for r in good.collect()}
    assert got == {"n1": (5, 24, "OPEN", 'say "hi", twice\nplease'), "n2": (1, 24, "RESOLVED", "x")} and bad.count() == 0
    W.notes_csv(notes, str(tmp_path / "pub"), "public")
    assert Rd.notes_csv(spark, str(tmp_path / "pub"))[0].count() == 1


def test_notes_with_other_headers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Frame Number,FPS,Comment,Status\n10,24,hello,done\nx,24,a,\n3,0,a,\n4,24,,\n5,24,b,whatever\n")
    good, bad = Rd.notes_csv(spark, str(tmp_path / "n.csv"))
    assert {(r.frame, r.status) for r in good.collect()} == {(10, "RESOLVED"), (5, "OPEN")}
    assert {r.problem for r in bad.collect()} == {"frame", "rate", "body"}
    assert all(len(r.id) == 16 for r in good.collect())


def test_files_and_gzip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.gz").write_bytes(gzip.compress(b"inner"))
    (tmp_path / "y.txt").write_bytes(b"plain")
    (tmp_path / "Thumbs.db").write_bytes(b"-")
    rows = {r.path: bytes(r.data) for r in Rd.files(spark, str(tmp_path)).select("path", X.unwrap_gzip("content").alias("data")).collect()}
    assert rows == {"a/x.gz": b"inner", "y.txt": b"plain"}


def test_packs(spark, tmp_path):
    data = [bytes([i]) * (i + 1) for i in range(20)]
    objects = spark.createDataFrame([(hashlib.sha256(d).hexdigest(), d) for d in data], "hash string, data binary")
    made = W.pack_objects(objects.unionByName(objects), 300)
    assert made.agg(F.sum("n")).first()[0] == 20 and made.count() > 2 and made.agg(F.max("raw_bytes")).first()[0] < 300 + 100
    back = Rd.packs(made.select(F.col("pack").cast("string").alias("path"), "content")).collect()
    assert all(r.valid for r in back) and {bytes(r.data) for r in back} == set(data)
    cut = Rd.packs(made.select(F.col("pack").cast("string").alias("path"), F.expr("substring(content, 1, octet_length(content) - 1)").alias("content")))
    assert not any(r.valid for r in cut.collect())
    index = W.write_packs(objects, str(tmp_path / "store"), 300)
    assert {r.hash for r in index.collect()} == {hashlib.sha256(d).hexdigest() for d in data}
    wrong = objects.unionByName(spark.createDataFrame([("ab" * 32, b"x")], "hash string, data binary"))
    with pytest.raises(RuntimeError):
        W.write_packs(wrong, str(tmp_path / "bad"), 300)
    assert not (tmp_path / "bad/index").exists()


def test_note_markers_as_xml(spark):
    notes = spark.createDataFrame([(1, 12, 24, 'a <b> & "c"')], "doc long, frame long, rate long, body string")
    assert W.fcpxml_markers(notes).first().line == '<marker start="12/24s" duration="1/24s" value="a &lt;b&gt; &amp; &quot;c&quot;"/>'


def test_ledger_and_audit(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"schema": "audit/1", "entries": [{"ts_ms": 1, "role": "owner"}]}))
    (tmp_path / "m.json").write_text(json.dumps({"schema": "other", "entries": [{"ts_ms": 2, "role": "owner"}]}))
    rows = Rd.ledger(spark, str(tmp_path / "*.json"), "audit/1", "struct<ts_ms: bigint, role: string>").collect()
    assert [(r.ts_ms, r.role) for r in rows] == [(1, "owner")]
    a = spark.createDataFrame([("t", "me", "read", "r", "d", 1)], "tenant string, actor string, action string, resource string, detail string, ts_ms long")
    W.audit(a, str(tmp_path / "audit"))
    W.audit(a, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_canonical_and_edl(spark):
    df = spark.createDataFrame([(2, None, "x")], "b long, c string, a string")
    assert df.select(W.canonical(["b", "c", "a"]).alias("j")).first().j == '{"a":"x","b":2}'
    clips = spark.createDataFrame([(1, 0, "clip one", 0, 48)], "doc long, idx long, name string, pos long, dur long")
    assert W.edl_events(clips, 24).first().line.endswith("00:00:00:00 00:00:02:00 00:00:00:00 00:00:02:00")


def test_objects_round_trip_and_refuse_damage(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tree = O.tree_bytes([("b/é", digest("2")), ("a", digest("1"))])
    assert O.parse_tree(tree) == [("a", digest("1")), ("b/é", digest("2"))]
    commit = O.commit_bytes(digest("t"), None, "ann", "first", 7)
    assert O.parse_commit(commit) == (digest("t"), None, "ann", "first", 7)
    assert O.parse_commit(O.commit_bytes(digest("t"), digest("p"), "", "", 0))[1] == digest("p")
    for parse, data in ((O.parse_tree, tree), (O.parse_commit, commit)):
        for cut in range(len(data)):
            with pytest.raises(ValueError):
                parse(data[:cut])
        with pytest.raises(ValueError):
            parse(data + b"x")
    entries = spark.createDataFrame([(m, i, i * 10, 10, digest(f"{m}{i}")) for m in (1, 2) for i in range(70 * m)], "manifest long, idx long, offset long, len long, hash string")
    built = O.manifests(entries, fan=8)
    top = {r.manifest: (r.hash, r.total, r["count"], r.level) for r in sorted(built.collect(), key=lambda r: r.level)}
    assert [top[m][1:] for m in (1, 2)] == [(700, 70, 2), (1400, 140, 2)]
    got = O.flattened(spark.createDataFrame([(top[1][0],)], "root string"), built.select("hash", "content")).collect()
    assert {(r.offset, r.hash) for r in got} == {(i * 10, digest(f"1{i}")) for i in range(70)}
    hurt = built.select("hash", F.expr("substring(content, 1, octet_length(content) - 1)").alias("content"))
    assert {r.kind for r in O.parsed(hurt).collect()} == {"error"}


def test_leaves_move_once_however_often_they_are_stored(spark):
    import hashlib
    import re

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    entries = spark.createDataFrame([(m, i, i * 10, 10, digest(f"{i}")) for m in (1, 2, 3) for i in range(40 * (1 + m // 3))], "manifest long, idx long, offset long, len long, hash string")
    built = O.manifests(entries, fan=8)
    top = built.groupBy("manifest").agg(F.max_by("hash", "level").alias("root"))
    got = O.flattened(top, built.unionByName(built).select("hash", "content"))  # 1 and 2 are the same object, and each is held twice and more
    text = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput(?: \[\d+\])?: \[(.*?)\]", text)
    assert sum("content#" in cols or "first" in cols for cols in moved) == 1
    want = sorted((m, i * 10, 10, digest(f"{i}")) for m in (1, 2, 3) for i in range(40 * (1 + m // 3)))
    assert sorted((r.manifest, r.offset, r.len, r.hash) for r in got.collect()) == want


def test_packs_move_data_twice(spark):
    """Sizes are placed without their data, which no window sorts."""
    import re

    objects = spark.createDataFrame([("aa", b"x"), ("aa", b"x"), ("bb", b"yy")], "hash string, data binary")
    q = W.pack_objects(objects, 300)._jdf.queryExecution()
    text = q.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    seen = re.findall(r"\) (Exchange|Window)\nInput(?: \[\d+\])?: \[(.*?)\]", text)
    assert "Window" in {k for k, _ in seen} and {k for k, cols in seen if "data#" in cols} == {"Exchange"}
    assert sum("data#" in cols for _, cols in seen) <= 2
