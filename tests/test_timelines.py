"""Timeline documents as rows."""

from __future__ import annotations

import json
import os
from decimal import Decimal

from pyspark.sql import functions as F

from tesserae.sources import timelines as T

CLIP = {"OTIO_SCHEMA": "Clip.2", "name": "a", "source_range": {"start_time": {"value": 10, "rate": 24}, "duration": {"value": 48.5, "rate": 23.976}}, "media_reference": {"target_url": "a.mov"}, "effects": [{}], "markers": [{}, {}], "metadata": {"uuid": "u1"}, "odd": {"b": [1, 2], "a": None}, "enabled": False}
GAP = {"OTIO_SCHEMA": "Gap.1", "source_range": {"start_time": {"value": 0, "rate": 24}, "duration": {"value": 1001, "rate": 24000}}}
TWO = {"OTIO_SCHEMA": "Clip.2", "name": "b", "active_media_reference_key": "hi", "media_references": {"lo": {"target_url": "lo.mov"}, "hi": {"target_url": "hi.mov"}}}


def track(*items, kind="Video", name="V1"):
    return {"OTIO_SCHEMA": "Track.1", "kind": kind, "name": name, "children": list(items)}


def doc(*tracks):
    return json.dumps({"OTIO_SCHEMA": "Timeline.1", "tracks": {"OTIO_SCHEMA": "Stack.1", "children": list(tracks)}})


def rows(spark, read, **texts):
    got = {}
    for r in read(spark.createDataFrame(list(texts.items()), "doc string, text string")).collect():
        got.setdefault(r.doc, []).append(r)
    return {d: sorted(rs, key=lambda r: (r.track or 0, r.idx or 0)) for d, rs in got.items()}


def test_json_items(spark):
    got = rows(spark, T.otio, d=doc(track(CLIP, GAP, TWO)), bad="{}", none=None, broken="{", empty=doc())
    a, gap, b = got["d"]
    assert (a.track, a.idx, a.kind, a.name, a.uuid, a.media, a.effects, a.markers, a.track_kind, a.track_name) == (0, 0, "clip", "a", "u1", "a.mov", 1, 2, "Video", "V1")
    assert (a.start_value, a.start_rate, a.dur_value, a.dur_rate) == (10, 24, Decimal("48.5"), Decimal("23.976"))
    assert json.loads(a.extra) == {"enabled": False, "metadata": {"uuid": "u1"}, "odd": {"a": None, "b": [1, 2]}} and gap.extra is None
    assert (gap.kind, gap.name, gap.dur_value, gap.dur_rate, gap.media) == ("gap", "", 1001, 24000, None) and b.media == "hi.mov" and b.start_value is None
    assert {d: [(r.kind, r.extra) for r in rs] for d, rs in got.items() if d != "d"} == {"bad": [("error", "not a timeline")], "none": [("error", "no JSON")], "broken": [("error", "no JSON")]}


def test_nested_json(spark):
    deep = {"OTIO_SCHEMA": "Stack.1", "name": "s", "children": [track({"OTIO_SCHEMA": "Clip.2", "name": "deep"}, {"OTIO_SCHEMA": "Stack.1", "name": "s2", "children": [track({"OTIO_SCHEMA": "Clip.2", "name": "deeper"}, name="x")]}, kind="Audio"), {"OTIO_SCHEMA": "Clip.2", "name": "bare"}]}
    got = rows(spark, T.otio, d=doc(track({"OTIO_SCHEMA": "Clip.2", "name": "a"}, deep, {"OTIO_SCHEMA": "Clip.2", "name": "z"}), track({"OTIO_SCHEMA": "Clip.2", "name": "q"}), {"OTIO_SCHEMA": "Clip.2", "name": "loose"}))["d"]
    assert [(r.track, r.idx, r.kind, r.name, r.inside) for r in got] == [
        (0, 0, "clip", "a", None), (0, 1, "stack", "s", None), (0, 2, "clip", "z", None), (1, 0, "clip", "q", None), (2, 0, "clip", "loose", None),
        (3, 0, "clip", "deep", "0/1"), (3, 1, "stack", "s2", "0/1"), (4, 0, "clip", "bare", "0/1"), (5, 0, "clip", "deeper", "0.1.0/1"),
    ]


XML = """<?xml version="1.0"?><!DOCTYPE fcpxml><fcpxml version="1.10"><resources><asset id="r2" src="z.mov"/><asset id="r1"><media-rep src="a.mov"/></asset></resources><library><event><project name="p"><sequence><spine>
<asset-clip ref="r1" name="a" start="1001/24000s" duration="2s" offset="0s" audioRole="dialogue"><marker start="1s" value="x"/><adjust-volume amount="-6dB"><param/></adjust-volume>
  <asset-clip ref="r2" name="up" lane="1" offset="1/2s" duration="1s"><marker/><marker/></asset-clip><title name="t" lane="-1" duration="1s"><text/></title><audio name="s" lane="-2" duration="3s"/></asset-clip>
<gap duration="1s" offset="2s"><video lane="2" name="v"/><video lane="-3" name="low"/></gap><transition name="x" duration="1/2s"/><mc-clip name="m"/>
</spine></sequence></project></event></library></fcpxml>"""


def test_xml_lanes_and_offsets(spark):
    got = rows(spark, T.fcpxml, d=XML, cut=XML[:300], old='<fcpxml version="2.0"/>', none=None)
    names = {r.track: r.track_name for r in got["d"]}
    assert names == {0: "V1", 1: "V2", 2: "V2", 3: "V2", 4: "V3", 5: "A1"}  # lanes -1, -3, then 1 and 2, then audio
    assert [(r.track, r.idx, r.kind, r.name, r.media, r.markers) for r in got["d"]] == [
        (0, 0, "clip", "a", "a.mov", 1), (0, 1, "gap", "", None, 0), (0, 2, "transition", "x", None, 0), (0, 3, "clip", "m", None, 0),
        (1, 0, "clip", "t", None, 0), (2, 0, "clip", "low", None, 0), (3, 0, "clip", "up", "z.mov", 2), (4, 0, "clip", "v", None, 0), (5, 0, "clip", "s", None, 0),
    ]
    a = got["d"][0]
    assert (a.start_value, a.start_rate, a.dur_value, a.dur_rate, a.offset_value, a.offset_rate, a.track_kind) == (1001, 24000, 2, 1, 0, 1, "Video")
    assert json.loads(a.extra) == {"attrs": {"audioRole": "dialogue"}, "lost": ["adjust-volume", "param"]}
    assert json.loads(got["d"][4].extra) == {"element": "title", "lost": ["text"]} and got["d"][1].extra is None
    assert got["d"][-1].track_kind == "Audio" and (got["d"][6].offset_value, got["d"][6].offset_rate) == (1, 2)
    assert [r.kind for d in ("cut", "old", "none") for r in got[d]] == ["error"] * 3
    lost = T.losses(T.fcpxml(spark.createDataFrame([("d", XML)], "doc string, text string"))).collect()
    assert {(r.tag, r["items"]) for r in lost} == {("adjust-volume", 1), ("param", 1), ("text", 1)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_readers_write_no_tables(spark):
    """A JSON document is read where its row is; the elements of XML are dealt once, by document."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = sorted(os.listdir(shared)) if os.path.isdir(shared) else []
    texts = spark.createDataFrame([("d", doc(track(CLIP)))], "doc string, text string")
    assert exchanges(T.otio(texts)) == 0 and exchanges(T.fcpxml(texts)) == 1
    assert before == (sorted(os.listdir(shared)) if os.path.isdir(shared) else [])


def test_xml_deeper_than_64_and_media_of_assets(spark):
    deep = "<spine>" + "<clip>" * 80 + '<audio ref="r"><marker/></audio>' + "</clip>" * 80 + "</spine>"
    assets = '<asset id="r" src="old"/><asset id="r" src="own"><media-rep/><media-rep src="late"/></asset><asset src="no id"/>'
    got = T.fcpxml(spark.createDataFrame([("d", f'<fcpxml version="1.1">{assets}{deep}</fcpxml>')], "doc string, text string")).collect()
    assert len(got) == 81 and [(r.idx, r.media, r.markers) for r in got if r.track_name == "A1"] == [(0, "own", 1)]
    assert {(r.media, r.markers) for r in got if r.track_name == "V1"} == {(None, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc string, text string")
    assert T.otio(none).count() == 0 == T.fcpxml(none).count()
    assert T.losses(T.fcpxml(none)).count() == 0


def test_many_blocks_of_a_long_text(spark):
    clips = "".join(f'<asset-clip name="c{i}" duration="{i}/24s"/>' for i in range(5000))
    text = f'<fcpxml version="1.9"><spine>{clips}</spine></fcpxml>'
    assert len(text) > 1 << 17
    got = T.fcpxml(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert got.where(F.col("name") == F.concat(F.lit("c"), F.col("idx").cast("string"))).where("dur_value = idx").count() == 5000
