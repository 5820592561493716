"""The journal and a directory as sources."""

from __future__ import annotations

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserae.plans.derived import journal
from tesserae.sources import segments as G
from tesserae.sources import tree as R

SCHEMA = "project_id long, seq long, path string"


def some(spark, spans):
    return spark.createDataFrame([(p, s, f"f{s}") for p, lo, hi in spans for s in range(lo, hi + 1)], SCHEMA)


def run(spark, path, checkpoint, per_batch, project=None, stop_after=None):
    """The batches of a stream that goes on until nothing is left, or until so many batches are done."""
    got = []

    class Enough(Exception):
        pass

    def keep(batch, n):
        got.append([(r.project_id, r.seq) for r in batch.collect()])
        if stop_after and len(got) >= stop_after:
            raise Enough

    q = G.entries(spark, path, some(spark, []).schema, per_batch, project).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    except Exception:
        if not stop_after:
            raise
    q.stop()
    return got


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    path, cp = f"file://{tmp_path}/j", str(tmp_path / "cp")
    G.write(some(spark, [(1, 1, 40), (2, 1, 5)]), path)
    first = run(spark, path, cp, 7)
    assert sorted(sum(first, [])) == [(1, s) for s in range(1, 41)] + [(2, s) for s in range(1, 6)]
    assert max(sum(r[0] == 1 for r in b) for b in first) == 7  # what a batch admits of a project
    assert all([s for p, s in b if p == 1] == sorted(s for p, s in b if p == 1) for b in first)
    G.write(some(spark, [(1, 41, 60), (3, 1, 3)]), path)
    G.write(some(spark, [(1, 81, 90)]), path)  # 61 to 80 are not there yet, so these wait
    second = run(spark, path, cp, 512)
    assert sorted(sum(second, [])) == [(1, s) for s in range(41, 61)] + [(3, s) for s in range(1, 4)]
    G.write(some(spark, [(1, 61, 80)]), path)
    assert sorted(sum(run(spark, path, cp, 8), [])) == [(1, s) for s in range(61, 91)]
    assert run(spark, path, cp, 8) == []


def test_a_batch_that_failed_comes_again_whole(spark, tmp_path):
    path, cp = f"file://{tmp_path}/j", str(tmp_path / "cp")
    G.write(some(spark, [(1, 1, 30)]), path)
    failed = run(spark, path, cp, 4, stop_after=3)
    again = run(spark, path, cp, 4)
    assert again[0] == failed[-1]
    assert sorted(sum(failed[:-1] + again, [])) == [(1, s) for s in range(1, 31)]


def test_one_project_and_what_is_admitted(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/j"
    j = journal(spark, sf_dir).select("project_id", "seq", "path")
    G.write(j, path)
    assert G._Runs({"path": path, "entries": "9999"}).entries == 512 and G._Runs({"path": path, "entries": "0"}).entries == 1
    got = run(spark, path, str(tmp_path / "cp"), 512, project=3)
    assert sorted(sum(got, [])) == sorted((r.project_id, r.seq) for r in j.where("project_id = 3").collect())
    behind = {r.project_id: r.behind for r in G.lag(j, spark.createDataFrame([(3, max(s for _, s in got[-1]))], "project_id long, seq long")).collect()}
    assert behind[3] == 0 and behind[1] == j.where("project_id = 1").count()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for d in ("a/b/c", "a/x", "empty", unicodedata.normalize("NFD", "é")):
        (root / d).mkdir(parents=True)
    for name, size in (("top.txt", 3), ("a/one.mov", 10), ("a/b/two.mov", 2000), ("a/b/c/three", 0), ("a/.DS_Store", 5), ("a/b/._two.mov", 5), (unicodedata.normalize("NFD", "é/ü.txt"), 7)):
        (root / name).write_bytes(b"x" * size)
    (root / "a/b/two.mov").chmod(0o640)
    (root / "a/link").symlink_to("one.mov")
    (root / "dangling").symlink_to("nowhere")
    (root / "a/folder link").symlink_to("b")
    return root


def walked(root):
    out = set()
    for at, dirs, names in os.walk(root):
        for n in dirs + names:
            p = os.path.join(at, n)
            s = os.lstat(p)
            if n in R.IGNORED or n.startswith(R.IGNORED_BEGINS):
                continue
            kind = "symlink" if os.path.islink(p) else "folder" if os.path.isdir(p) else "file"
            out.add((unicodedata.normalize("NFC", os.path.relpath(p, root)), kind, s.st_mode & 0o7777, s.st_size if kind == "file" else 0, s.st_mtime_ns // 10**6, os.readlink(p) if kind == "symlink" else None))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_tree_equals_a_walk(spark, folder, depth):
    got = R.tree(spark, f"file://{folder}", depth).collect()
    assert {tuple(r) for r in got} == walked(folder) and len(got) == len(walked(folder))


def test_filters_reach_the_walk(spark, folder, monkeypatch):
    t = R.tree(spark, str(folder), 1)
    for cond in ("path like 'a/b/%'", "kind = 'file' and size > 5", "kind in ('symlink', 'folder') and path like 'a/%'", "size >= 7 and size < 100", "path like 'a%' and path like 'a/b%'"):
        want = spark.createDataFrame(sorted(walked(folder), key=str), R._SCHEMA).where(cond).collect()
        assert sorted(map(str, t.where(cond).collect())) == sorted(map(str, want)), cond
    walk = R._Walk({"path": str(folder), "depth": "1"})
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    assert list(walk.pushFilters([EqualTo(("kind",), "file"), StringStartsWith(("path",), "a/b")])) == [StringStartsWith(("path",), "a/b")]
    assert [p.path for p in walk.partitions()] == ["", "a"]  # no other folder can hold such paths
