"""Properties of the operators that SQL cannot state, and small cases worked by hand."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import exact as X
from tesserae.functions import note_grammar as N
from tesserae.functions import scalar as C
from tesserae.operators import activity as A
from tesserae.operators import chunking as K
from tesserae.operators import journal as J
from tesserae.operators import records as R
from tesserae.operators import store as S
from tesserae.operators import search as Q
from tesserae.operators import threeway as Y
from tesserae.operators import timeline as T


@given(st.binary(max_size=6000))
@settings(max_examples=40, deadline=None)
def test_chunks_cover_the_data(data):
    ends = K.cut_points(data, 64, 256, 1024)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(0 < s <= 1024 for s in sizes) and all(s >= 64 for s in sizes[:-1])


def test_gear_hash_is_the_byte_loop():
    data = random.Random(1).randbytes(3000)
    g, want = 0, []
    for b in data:
        g = ((g << 1) + int(K.gear_table()[b])) % (1 << 64)
        want.append(g)
    assert K.gears(data).tolist() == want


def test_chunks_survive_an_insertion():
    data = random.Random(2).randbytes(200_000)
    parts = lambda d: {d[a:b] for e in [K.cut_points(d, 256, 1024, 4096)] for a, b in zip([0, *e], e)}
    old, new = parts(data), parts(data[:100_000] + b"some new bytes" + data[100_000:])
    assert len(old & new) > 0.9 * len(old)


@pytest.mark.parametrize("text, ops", [
    ("Cut 2.5 seconds off the end. Love it!", [("trim_out", "5/2")]),
    ("trim half a second off the start", [("trim_in", "1/2")]),
    ("delete this", [("delete", "")]),
    ("replace it with the wide shot please", [("replace", "the wide shot")]),
    ("make it louder by 4 db; turn down the music", [("gain", "4"), ("gain", "-3")]),
    ("a beautiful moment", []),
    (None, []),
])
def test_note_grammar(text, ops):
    assert N.parse_note(text) == ops


def test_frames_need_a_rate():
    assert N.parse_note("cut 12 frames off the end", rate=24) == [("trim_out", "1/2")]


def _entries(spark, rows):
    return spark.createDataFrame(rows, "project_id long, seq long, device_id long, path string, new_path string, kind string, manifest string, size long, base_seq long")


def test_fold_of_a_prefix_then_the_rest_is_the_fold_of_all(spark):
    rng = random.Random(3)
    rows = [(0, i, i % 3, f"p{rng.randint(0, 5)}", f"p{rng.randint(0, 5)}", rng.choice(["file_upsert", "file_delete", "rename", "lease_event"]), f"m{i}", i, 0) for i in range(1, 80)]
    j = _entries(spark, rows)
    whole = {r.path: tuple(r) for r in J.fold(j).collect()}
    first, rest = J.fold(j.where("seq <= 40")), J.fold(j, since=40)
    joined = {r.path: tuple(r[c] for c in J.fold(j).columns) for r in S.upsert(first, rest, ["project_id", "path"], "seq").collect()}
    assert whole == joined


def test_rename_onto_itself_is_present(spark):
    j = _entries(spark, [(0, 1, 1, "a", "a", "rename", "m1", 5, 0)])
    assert [(r.path, r.state) for r in J.fold(j).collect()] == [("a", "present")]


@pytest.mark.parametrize("other, base, conflict", [(2, 0, True), (2, 1, False), (1, 0, False)])
def test_conflict_truth_table(spark, other, base, conflict):
    j = _entries(spark, [(0, 1, 1, "a", "", "file_upsert", "m", 1, 0), (0, 2, other, "a", "", "file_upsert", "m", 1, base)])
    got = {r.seq: r.conflict for r in J.conflicts(j).collect()}
    assert got == {1: False, 2: conflict}
    accepted = {r.seq: r.accepted for r in J.online_accept(j).collect()}
    assert accepted == {1: True, 2: not conflict}


def test_registers_do_not_depend_on_order(spark):
    rows = [("f", 1, 5, 1, "a", False, 1), ("f", 1, 5, 1, "b", True, 2), ("f", 1, 4, 9, "c", False, 3), ("f", 1, 5, 1, "d", True, 4)]
    schema = "family string, key long, ts_ms long, device_id long, payload string, tombstone boolean, seq long"
    won = {R.lww(spark.createDataFrame(list(p), schema)).first().payload for p in itertools.islice(itertools.permutations(rows), 0, 24, 7)}
    assert won == {"b"}


def test_merge_of_notes_is_symmetric_where_it_must_be(spark):
    schema = "id long, author long, anchor long, status string, pin long, attachment string, created_ms long"
    base = spark.createDataFrame([(i, 1, i, "OPEN", 0, "x", 1) for i in range(6)], schema)
    ours = spark.createDataFrame([(0, 1, 0, "RESOLVED", 0, "x", 2), (1, 1, 1, "OPEN", 5, "x", 1), (2, 1, 2, "OPEN", 0, "x", 1), (4, 1, 4, "RESOLVED", 0, "x", 1), (9, 2, 9, "OPEN", 0, "x", 1)], schema)
    theirs = spark.createDataFrame([(0, 1, 0, "OPEN", 0, "x", 3), (1, 1, 1, "OPEN", 7, "x", 1), (3, 1, 3, "OPEN", 0, "x", 1), (4, 1, 4, "REJECTED", 0, "x", 1)], schema)
    got = {r.id: (r.status, r.pin, r.created_ms, r.conflict) for r in T.merge_notes(base, ours, theirs).collect()}
    assert got == {0: ("RESOLVED", 0, 3, None), 1: ("OPEN", 5, 1, "pin"), 4: ("RESOLVED", 0, 1, "status"), 9: ("OPEN", 0, 1, None)}
    swapped = {r.id: r.conflict for r in T.merge_notes(base, theirs, ours).collect()}
    assert swapped == {k: v[3] for k, v in got.items()}


def test_changelist_moves_no_target(spark):
    clips = [("a", 0, 0, 0, 10, "ma"), ("b", 0, 1, 0, 10, "mb"), ("c", 0, 2, 0, 10, None), ("same", 0, 3, 0, 10, "m1"), ("same", 0, 4, 0, 10, "m2"), ("bare", 0, 5, None, None, "m")]
    clips = spark.createDataFrame([(1, e, t, i, s, d, e, u) for e, t, i, s, d, u in clips], "doc long, element string, track long, idx long, start long, dur long, name string, url string")
    ops = [
        (1, 3, "trim_in", 4, None), (2, 12, "delete", 0, None), (3, 13, "trim_out", 1, None), (4, 25, "trim_out", 12, None), (5, 99, "delete", 0, None), (6, 4, "gain", 50, None), (7, 4, "replace", 0, "new"), (8, 4, "gain", -3, None),
        (9, 26, "replace", 0, "x"), (10, 45, "replace", 0, "first"), (11, 45, "delete", 0, None), (12, 45, "replace", 0, "second"), (13, 46, "trim_out", 3, None),
    ]
    items = spark.createDataFrame([(1, n, 0, f, op, a, t) for n, f, op, a, t in ops], "doc long, note long, n int, frame long, op string, amount long, target string")
    after, ledger = T.apply_changelist(clips, items)
    said = {r.note: r.status for r in ledger.collect()}
    assert said == {1: "applied", 2: "applied", 3: "removed", 4: "refused", 5: "no clip", 6: "applied", 7: "applied", 8: "applied", 9: "no media", 10: "applied", 11: "applied", 12: "applied", 13: "applied"}
    got = sorted((r.idx, r.element, r.start, r.dur, r.url, r.gains) for r in after.collect())
    # the clip at frame 45 is the second of its name; the first of it takes what comes until it is deleted
    assert got == [(0, "a", 4, 6, "new", [50, -3]), (1, "c", 0, 10, None, []), (2, "same", 0, 7, "second", []), (3, "bare", None, None, "m", [])]


def test_changelist_moves_each_table_once(spark):
    # names that no item leads to, no name at all, and a frame that two tracks hold
    clips = [("a", 0, 0, 10), ("same", 1, 0, 20), ("same", 1, 1, 20), (None, 0, 1, 5), (None, 0, 2, 5)]
    clips = spark.createDataFrame([(d, e, t, i, 0, n, e, "m") for d in (1, 2) for e, t, i, n in clips], "doc long, element string, track long, idx long, start long, dur long, name string, url string")
    ops = [(1, 9, "trim_in", 3), (2, 12, "gain", 7), (3, 19, "delete", 0), (4, 25, "trim_out", 1), (5, None, "gain", 1)]
    items = spark.createDataFrame([(1, n, 0, f, op, a, None) for n, f, op, a in ops], "doc long, note long, n int, frame long, op string, amount long, target string")
    after, ledger = T.apply_changelist(clips, items, 3)
    assert {r.note: r.status for r in ledger.collect()} == {1: "applied", 2: "no clip", 3: "no clip", 4: "applied", 5: "no clip"}
    got = sorted(((r.doc, r.track, r.idx, r.element, r.start, r.dur) for r in after.collect()), key=str)
    assert got == [
        (1, 0, 0, "a", 3, 7), (1, 0, 1, None, 0, 5), (1, 0, 2, None, 0, 5), (1, 1, 0, "same", 0, 19), (1, 1, 1, "same", 0, 20),
        (2, 0, 0, "a", 0, 10), (2, 0, 1, None, 0, 5), (2, 0, 2, None, 0, 5), (2, 1, 0, "same", 0, 20), (2, 1, 1, "same", 0, 20),
    ]
    for df in (after, ledger):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(doc" in plan and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


def test_empty_tables(spark):
    j = _entries(spark, [])
    for df in (J.fold(j), J.snapshot(j), J.conflicts(j), J.online_accept(j)):
        assert df.count() == 0
    e = spark.createDataFrame([], "hash long, size long, last_touched long, pinned boolean")
    assert S.lru_evict(e, 10).count() == 0 and S.pack_prefix(e, 100).count() == 0


def test_prefix_sums_match_a_window(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 40)
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 50), rng.randint(0, 20), False) for i in range(300)]
    df = spark.createDataFrame(rows, "hash long, size long, last_touched long, pinned boolean")
    got = {r.hash: r.before for r in S.prefix_until(df, ["last_touched", "hash"], "size", []).collect()}
    at, want = 0, {}
    for h, s, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[h], at = at, at + s
    assert got == want


def test_rate_limit_opens_its_window_at_the_first_event(spark):
    e = spark.createDataFrame([(1, i, ms) for i, ms in enumerate([0, 10, 20, 59, 60, 61, 62])], "user_id long, event_id long, ms long")
    assert [r.allowed for r in A.rate_limit(e, 2, 60).orderBy("event_id").collect()] == [True, True, False, False, True, True, False]


def test_rationals_are_exact_or_refused(spark):
    df = spark.createDataFrame([("1/3", "1/6"), ("1/2", "0/1"), (f"{1 << 94}/1", "4/1")], "a string, b string")
    got = df.select(X.rational("add", "a", "b").alias("s"), X.rational("div", "a", "b").alias("q"), X.rational("mul", "a", "b").alias("m")).collect()
    assert tuple(got[0]) == ("1/2", "2/1", "1/18") and got[1].q is None and got[2].m is None


def test_moves_follow_the_piles(spark):
    rows = [(d, n, x) for d, seq in enumerate([[1, 2, 0], [0, 1, 2], [3, 0, 4, 1, 2]]) for n, x in enumerate(seq)]
    got = Y.moved_in_track(spark.createDataFrame(rows, "doc long, n long, x long"), ["doc"], "n", "x")
    at = {(d, n): x for d, n, x in rows}
    assert {(r.doc, at[r.doc, r.n]) for r in got.where("not stays").collect()} == {(0, 1), (2, 3), (2, 4)}


def test_search_over_projects_files_and_reviews(spark):
    projects = spark.createDataFrame([("a", "Alpha cut"), ("b", "Beta"), ("c", "Gamma"), ("d", "cut of D")], "project string, display string")
    paths = [("a", i, 30) for i in range(30)] + [("b", i, 30) for i in range(30)] + [("c", i, 5) for i in range(5)] + [("d", i, 3) for i in range(3)]
    files = spark.createDataFrame([(p, f"{p}/Cut{i:02}.mov", "file") for p, i, _ in paths] + [("a", "a/cut", "dir")], "project string, path string, mode string")
    reviews = spark.createDataFrame([("a", "CUT one"), ("b", "other")], "project string, title string")
    got = [(r.kind, r.project, r.label) for r in Q.find(projects, files, reviews, "cUt").orderBy("rank").collect()]
    want = [("project", "a", "Alpha cut"), ("project", "d", "cut of D")] + [("file", "a", f"a/Cut{i:02}.mov") for i in range(30)] + [("file", "b", f"b/Cut{i:02}.mov") for i in range(10)]
    assert got == want + [("file", "c", "c/Cut00.mov"), ("file", "d", "d/Cut00.mov"), ("review", "a", "CUT one")]
    assert Q.find(projects, files, reviews, "  ").count() == 0


def test_ranked_clips_and_files(spark):
    files = spark.createDataFrame([("x/red.mov",), ("y/blue.mov",)], "path string")
    clips = [("cut.otio", 0, 0, True, "intro", "m/a.mov", 48, 24), ("cut.otio", 0, 1, True, "red car", "m/b.mov", 24, 24), ("cut.otio", 1, 0, False, "red car", "m/red.wav", 24, None), ("cut.otio", 0, 2, True, "", "m/red.mov", 24, 24)]
    clips = spark.createDataFrame(clips, "path string, track long, idx long, video boolean, name string, media string, dur long, rate long")
    got = [(r.kind, r.path, r.clip, r.timecode, r.score) for r in Q.ranked(files, clips, Q.words("RED a", spark), 9).collect()]
    assert got == [("clip", "cut.otio", "red car", "00:00:02:00", 17), ("clip", "cut.otio", "red car", "00:00:00:00", 15), ("file", "x/red.mov", None, None, 15)]


def test_icons_are_written_when_they_change(spark):
    files = spark.createDataFrame([("p", "a", "synced"), ("p", "b", "dirty"), ("q", "c", "placeholder")], "project_id string, path string, local_state string")
    none = spark.createDataFrame([], "project_id string, digest string, at_ms long")
    first = {r.project_id: r for r in Q.overlays(files, none, 1, 1000).collect()}
    assert all(r.write for r in first.values()) and {p: r.entries for p, r in first.items()} == {"p": 1, "q": 1}
    seen = spark.createDataFrame([(p, r.digest, 1000) for p, r in first.items()], "project_id string, digest string, at_ms long")
    write = lambda f, g, now: {r.project_id: r.write for r in Q.overlays(f, seen, g, now).collect()}
    assert write(files.orderBy(F.desc("path")), 1, 60_999) == {"p": False, "q": False}
    assert write(files, 1, 61_000) == {"p": True, "q": True} == write(files, 2, 1001)
    changed = files.withColumn("local_state", F.when(F.col("path") == "b", "synced").otherwise(F.col("local_state")))
    assert write(changed, 1, 1001) == {"p": True, "q": False}
    assert Q.in_states(files, []).count() == 0 and Q.in_states(files, ["synced", "dirty"]).count() == 2


def test_young_chunks_are_not_evicted(spark):
    blobs = spark.createDataFrame([(i, 10, i, False) for i in range(10)], "hash long, size long, last_touched long, pinned boolean")
    assert sorted(r.hash for r in S.lru_evict(blobs, 20).collect()) == list(range(8))
    assert sorted(r.hash for r in S.lru_evict(blobs, 20, untouched_since=4).collect()) == [0, 1, 2, 3, 4]


def test_eviction_has_no_least_age(spark, tmp_path):
    from tesserae import plans

    when = "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int))"
    spark.range(10).selectExpr("id + 1 as p_partkey", "1 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(10).selectExpr("id + 1 as l_partkey", f"{when} as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    # ten chunks of 1,000 bytes within ten days; the oldest five bring them to half
    assert sorted(r.hash for r in plans.queries()["lru_evict"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]


def test_peaks_of_long_recordings(spark):
    got = A.peaks(spark.createDataFrame([(7, 0.5), (2_999_999, -1.0)], "frame long, v double"), 10, 300_000)
    assert got.count() == 300_000
    assert {(r.bin, r.lo, r.hi) for r in got.where("bin in (0, 1, 299999)").collect()} == {(0, 0.5, 0.5), (1, 0.0, 0.0), (299_999, -1.0, -1.0)}


@pytest.mark.parametrize("frame, rate, text", [(0, 24, "00:00:00:00"), (-49, 24, "-00:00:02:01"), (90_000, 25, "01:00:00:00"), (7, 0, "7")])
def test_timecode(spark, frame, rate, text):
    assert spark.range(1).select(C.timecode(F.lit(frame).cast("long"), F.lit(rate)).alias("t")).first().t == text


def test_floor_before_the_epoch(spark):
    df = spark.createDataFrame([(-1, 5)], "mtime long, size long")
    assert S.daily_activity(df, -10, 0).first().day_start_ms == -86_400_000
    assert spark.range(1).select(C.day(F.lit(-1)).alias("d")).first().d == "1969-12-31"


def test_audit_counts_tracks_without_sending_items_thrice(spark):
    from tesserae.operators import timeline as T

    cols = "doc int, track int, track_kind string, kind string, effects int, params int, markers int, link int"
    items = spark.createDataFrame([(1, 0, "Video", "clip", 1, 0, 2, None), (1, 0, "Video", "gap", 0, 0, 0, 7), (1, 1, "Video", "clip", 0, 0, 0, None), (1, 0, "Audio", "clip", 0, 3, 0, None), (1, None, "Audio", "clip", 0, 0, 0, None), (2, 0, None, None, None, None, None, None)], cols)
    got = T.audit(items, items.where("track = 0 and doc = 1"))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    one, two = sorted(got.collect(), key=lambda r: r.doc)
    assert (one.before_clips, one.before_video_tracks, one.before_audio_tracks, one.before_effects, one.before_markers, one.differs) == (4, 2, 1, 1, 2, "clips,audio,video_tracks")
    assert (two.before_clips, two.before_effects, two.before_video_tracks, two.after_clips, two.differs) == (0, 0, 0, 0, "")


def test_rollup_is_the_grouped_walk(spark):
    from pyspark.sql import functions as F

    from tesserae.operators import graph as G

    # a tree, a node with two ways to it, a parent that is no node, a loop
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (99, 1), (7, 7)], "parent long, child long")
    own = spark.createDataFrame([(k, 10 * k) for k in (1, 2, 3, 4, 5, 7)], "node long, b long")
    for levels in (1, 3, 8):
        walked = G.flatten(own.select(F.col("node").alias("root")), links, levels).join(own, "node").groupBy("root", "depth").agg(F.count("*").alias("leaves"), F.sum("b").alias("b"))
        assert sorted(map(tuple, G.rollup(own, links, 3, levels).collect())) == sorted(map(tuple, walked.collect()))
    assert G.rollup(own, links.limit(0), 3).count() == 6
