"""Timeline documents as rows of items: JSON by VARIANT paths, XML by its elements.

Both give (doc, track, track_name, track_kind, idx, kind, name, uuid, start_value, start_rate, dur_value, dur_rate,
media, effects, markers, inside, extra). Times stay the pair of value and rate that the document has, exactly, so seconds
are value / rate. A document that can't be read is one row of kind ``error`` whose extra says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.workers import by_value

by_value(__name__)

_TIME = "decimal(38,9)"
ITEM = ["doc", "track", "track_name", "track_kind", "idx", "kind", "name", "uuid", "start_value", "start_rate", "dur_value", "dur_rate", "media", "effects", "markers", "inside", "extra"]
#: How deep stacks and tracks may lie in tracks.
DEPTH = 16
# What the columns hold of an item of a JSON timeline; all else is kept in ``extra``.
_KNOWN = ["OTIO_SCHEMA", "name", "source_range", "media_reference", "media_references", "active_media_reference_key", "effects", "markers", "children"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _schema(v: Column) -> Column:
    """clip of Clip.2, and so on."""
    return F.lower(F.split_part(F.coalesce(_get(v, "$.OTIO_SCHEMA"), F.lit("")), F.lit("."), F.lit(1)))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _rest(v: Column) -> Column:
    """The item's other fields as JSON with sorted keys, or null."""
    fields = F.map_filter(F.coalesce(_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(_KNOWN))
    entries = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.element_at(fields, k))))
    return F.when(F.size(fields) > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))


#: An item on its way through the levels of a document.
_PLACED = "array<struct<track:bigint,path:array<int>,inside:string,track_name:string,track_kind:string,idx:int,i:variant>>"


def _tracks(found: Column, path: Callable[[Column], Column], inside: Column) -> Column:
    """The things in ``found`` as tracks of items; what isn't a track is alone on one of its own, and those without items are left out."""

    def one(t: Column, n: Column) -> Column:
        is_track = _schema(t) == "track"
        own = F.when(is_track, _list(t, "$.children")).otherwise(F.array(t))
        return F.struct(path(n).alias("path"), inside.alias("inside"), F.when(is_track, _get(t, "$.name")).alias("name"), _get(t, "$.kind").alias("kind"), own.alias("own"))

    return F.filter(F.transform(found, one), lambda t: F.size(t["own"]) > 0)


def _items(tracks: Column, before: Column) -> Column:
    """The items of ``tracks``, which are numbered from ``before``."""
    item = lambda t, n, i, k: F.struct((before + n).alias("track"), t["path"].alias("path"), t["inside"].alias("inside"), t["name"].alias("track_name"), t["kind"].alias("track_kind"), k.alias("idx"), i.alias("i"))
    return F.flatten(F.transform(tracks, lambda t, n: F.transform(t["own"], lambda i, k: item(t, n, i, k))))


def _held(r: Column) -> Column:
    """The tracks that an item holds."""
    nested = _schema(r["i"])
    # a stack holds tracks; a track in a track is one of its own, where it isn't the whole of it
    held = F.when(nested == "stack", _list(r["i"], "$.children")).when((nested == "track") & r["track_name"].isNotNull(), F.array(r["i"])).otherwise(F.array().cast("array<variant>"))
    inside = F.concat(F.array_join(F.transform(r["path"], lambda p: p.cast("string")), "."), F.lit("/"), r["idx"].cast("string"))
    return _tracks(held, lambda n: F.concat(r["path"], F.array(r["idx"], n)), inside)


def otio(docs: DataFrame) -> DataFrame:
    """The items of JSON timelines (doc, text). Tracks in tracks and stacks are items, and what they hold follows on tracks of its own.

    Tracks are numbered in the order of the document, those inside behind the ones that hold them; ``inside`` is the
    track and place of the item that holds an item's track, level by level, to a bounded depth. A document is read where its row is.
    """
    v = F.col("v")
    parsed = docs.select("doc", F.try_parse_json("text").alias("v"))
    wrong = F.when(v.isNull(), "no JSON").when(~F.coalesce(_get(v, "$.OTIO_SCHEMA").startswith("Timeline."), F.lit(False)), "not a timeline")
    top = _items(_tracks(_list(v, "$.tracks.children"), lambda n: F.array(n), F.lit("")), F.lit(0).cast("long"))

    def deeper(s: Column, _: Column) -> Column:
        """What is done and the items of a level, from those of the level above."""
        last = F.get(s["level"], F.size(s["level"]) - 1)
        below = _items(F.flatten(F.transform(s["level"], _held)), last["track"] + 1)
        return F.when(F.size(s["level"]) == 0, s).otherwise(F.struct(F.concat(s["done"], s["level"]).alias("done"), below.alias("level")))

    levels = F.sequence(F.lit(2), F.lit(DEPTH))
    every = F.aggregate(levels, F.struct(F.array().cast(_PLACED).alias("done"), top.cast(_PLACED).alias("level")), deeper, lambda s: F.concat(s["done"], s["level"]))
    rows = parsed.select("doc", wrong.alias("wrong"), "v").select("doc", "wrong", F.explode(F.when(F.col("wrong").isNull(), every).otherwise(F.array(F.lit(None)))).alias("r"))
    rows = rows.select("doc", "wrong", "r.*")
    i = F.col("i")
    fine = lambda c: F.when(F.col("wrong").isNull(), c)
    active = F.coalesce(_get(i, "$.active_media_reference_key"), F.lit("DEFAULT_MEDIA"))
    media = F.element_at(_get(i, "$.media_references", "map<string,variant>"), active)
    url = F.coalesce(_get(media, "$.target_url"), _get(i, "$.media_reference.target_url"))
    time = lambda part, what: _get(i, f"$.source_range.{part}.{what}", _TIME)
    return rows.select(
        "doc", "track", "track_name", "track_kind", F.col("idx").cast("long").alias("idx"), F.coalesce(fine(_schema(i)), F.lit("error")).alias("kind"), fine(F.coalesce(_get(i, "$.name"), F.lit(""))).alias("name"), _get(i, "$.metadata.uuid").alias("uuid"),
        time("start_time", "value").alias("start_value"), time("start_time", "rate").alias("start_rate"), time("duration", "value").alias("dur_value"), time("duration", "rate").alias("dur_rate"),
        url.alias("media"), fine(F.size(_list(i, "$.effects")).cast("long")).alias("effects"), fine(F.size(_list(i, "$.markers")).cast("long")).alias("markers"), F.nullif("inside", F.lit("")).alias("inside"), F.coalesce("wrong", _rest(i)).alias("extra"),
    ).select(*ITEM)


# Elements of a spine that are items, what they are, and attributes that the columns hold.
_ITEMS = {"asset-clip": "clip", "clip": "clip", "video": "clip", "audio": "clip", "title": "clip", "ref-clip": "clip", "mc-clip": "clip", "gap": "gap", "transition": "transition"}
_ATTRS = ["name", "start", "duration", "ref", "offset", "id", "lane"]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What rows are made of: all that lies in a spine in or as an item, assets with the place of their media, and problems.

    ``of`` is the element that a row tells of: an item or asset itself, the item around what lies in one; problems tell of -1.
    Attributes are kept where columns come from them.
    """
    import xml.etree.ElementTree as ET

    class Rows:
        def __init__(self):
            self.row, self.rows, self.keys, self.values, self.ends = 0, [], [], [], [0]

        def open(self, row):
            # of what is open: its number, whether it is or lies in a spine, the nearest item, an asset's attributes, its first media
            self.row, self.n, self.path = row, 0, [(None, False, None, None, [])]

        def add(self, of, n, tag, spine, problem, attrs):
            self.rows.append((self.row, of, n, tag, spine, problem))
            if attrs:
                self.keys.extend(attrs)
                self.values.extend(attrs.values())
            self.ends.append(len(self.keys))

        def start(self, tag, attrs):
            n, (_, spine, item, asset, found) = self.n, self.path[-1]
            if n == 0 and (tag != "fcpxml" or not attrs.get("version", "").startswith("1.")):
                self.add(-1, n, tag, False, "not a project of version 1", None)
            if spine and tag in _ITEMS:
                self.add(n, n, tag, True, None, attrs)
                item = n
            elif item is not None:
                self.add(item, n, tag, True, None, None)
            if tag == "media-rep" and asset is not None:
                found.append(attrs.get("src"))
            self.path.append((n, spine or tag == "spine", item, attrs if tag == "asset" else None, []))
            self.n = n + 1

        def end(self, tag):
            n, _, _, asset, found = self.path.pop()
            if asset is not None:
                src = found[0] if found and found[0] is not None else asset.get("src")
                self.add(n, n, tag, False, None, {"id": asset.get("id"), "src": src})

        def close(self):
            pass

        def batch(self, docs):
            row, of, n, tag, spine, problem = zip(*self.rows) if self.rows else [[]] * 6
            attrs = pa.MapArray.from_arrays(pa.array(self.ends, "int32"), pa.array(self.keys, "string"), pa.array(self.values, "string"))
            out = [docs.take(pa.array(row, "int32")), pa.array(of, "int32"), pa.array(n, "int32"), pa.array(tag, "string"), pa.array(spine, "bool"), pa.array(problem, "string"), attrs]
            self.rows, self.keys, self.values, self.ends = [], [], [], [0]
            return pa.RecordBatch.from_arrays(out, ["doc", "of", "n", "tag", "spine", "problem", "attrs"])

    for batch in batches:
        rows, docs = Rows(), batch.column(0)
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            rows.open(k)
            if text is None:
                rows.add(-1, None, None, False, "no text", None)
                continue
            parser = ET.XMLParser(target=rows)
            try:
                for at in range(0, len(text), 1 << 16):
                    parser.feed(text[at : at + (1 << 16)])
                    if len(rows.ends) > 50_000:
                        yield rows.batch(docs)
                parser.close()
            except ET.ParseError as problem:
                rows.add(-1, None, None, False, str(problem)[:200], None)
        yield rows.batch(docs)


_ELEMENT = [("of", "int"), ("n", "int"), ("tag", "string"), ("spine", "boolean"), ("problem", "string"), ("attrs", "map<string,string>")]


def _ticks(c: Column) -> tuple[Column, Column]:
    """Value and rate of a time such as 3600/2400s or 5s."""
    plain = F.when(c.endswith("s"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.split_part(plain, F.lit("/"), F.lit(1)).cast(_TIME), F.when(plain.contains("/"), F.split_part(plain, F.lit("/"), F.lit(2))).otherwise(F.when(c.isNotNull(), "1")).cast(_TIME)


def fcpxml(docs: DataFrame) -> DataFrame:
    """The items of XML projects (doc, text), with two more columns ``offset_value`` and ``offset_rate``, where they stand.

    Items of the spine are on track V1. Connected clips, wherever they hang, are on a track for each lane: lanes below 0 come
    behind V1, nearest first, then those above it; audio comes last. A marker is of the nearest item that holds it.
    ``extra`` has, as JSON, the element's own attributes, its tag where it isn't a plain clip, and ``lost``, the tags below it that rows don't hold.
    """
    attr = lambda name: F.col("attrs")[name]
    schema = docs.select("doc", *(F.lit(None).cast(kind).alias(name) for name, kind in _ELEMENT)).schema
    e = docs.select("doc", "text").mapInArrow(_texts, schema)
    item, is_asset = F.col("spine") & F.col("tag").isin(list(_ITEMS)), ~F.col("spine") & (F.col("tag") == "asset")
    own = F.map_filter("attrs", lambda k, _: ~k.isin(_ATTRS))
    e = e.select(
        "doc", "of", "n", "tag", "spine", F.col("problem").alias("wrong"), *(attr(a).alias(a) for a in ("name", "start", "duration", "offset", "lane", "src")),
        F.when(is_asset, attr("id")).otherwise(attr("ref")).alias("ref"), F.when(item & (F.size(own) > 0), own).alias("own"),
    )
    # one shuffle of elements by document; all that follows are windows inside it
    e = e.repartition("doc")
    told, below = Window.partitionBy("doc", "of"), F.col("spine") & ~item
    e = e.withColumn("first", F.row_number().over(told.orderBy(F.col("wrong").asc_nulls_last())) == 1)
    e = e.withColumns({
        "markers": F.count_if(below & (F.col("tag") == "marker")).over(told), "lost": F.array_sort(F.collect_set(F.when(below & ~F.col("tag").isin("marker", "note", "spine"), F.col("tag"))).over(told)),
    })
    e = e.withColumn("extra", F.min("wrong").over(Window.partitionBy("doc")))
    error = F.col("extra").isNotNull()
    e = e.where((~error & (item | is_asset)) | (error & F.col("first") & (F.col("of") == -1)))
    media = F.max_by(F.when(is_asset, F.col("src")), F.when(is_asset, F.col("n"))).over(Window.partitionBy("doc", "ref"))
    rows = e.withColumn("media", F.when(F.col("ref").isNotNull(), media)).where(~is_asset | error)
    lane = F.when(F.col("tag") == "audio", F.lit(2**62)).otherwise(F.coalesce(F.col("lane").try_cast("bigint"), F.lit(0)))
    # V1, then lanes below the spine from the nearest, then those above, then audio
    rank = F.when(F.col("_lane") == 0, F.lit(-(2**62))).when(F.col("_lane") < 0, -F.lit(2**61) - F.col("_lane")).otherwise(F.col("_lane"))
    rows = rows.withColumn("_lane", lane).withColumn("_rank", rank)
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("doc", "_rank").orderBy("n")) - 1).cast("long"))
    rows = rows.withColumn("track", (F.dense_rank().over(Window.partitionBy("doc").orderBy("_rank")) - 1).cast("long"))
    name = F.when(F.col("_lane") == 2**62, "A1").when(F.col("_lane") == 0, "V1").otherwise(F.concat(F.lit("V"), (F.greatest("_lane", F.lit(1)) + 1).cast("string")))
    times = {p: _ticks(F.col(a)) for p, a in (("start", "start"), ("dur", "duration"), ("offset", "offset"))}
    more = F.to_json(F.struct(F.col("own").alias("attrs"), F.when(~F.col("tag").isin("asset-clip", "clip", "gap", "transition"), F.col("tag")).alias("element"), F.when(F.size("lost") > 0, F.col("lost")).alias("lost")))
    kind = F.element_at(F.create_map(*(F.lit(x) for p in _ITEMS.items() for x in p)), F.col("tag"))
    fine = lambda c: F.when(~error, c)
    return rows.select(
        "doc", fine(F.col("track")).alias("track"), fine(name).alias("track_name"), fine(F.when(name == "A1", "Audio").otherwise("Video")).alias("track_kind"), fine(F.col("idx")).alias("idx"),
        F.when(error, "error").otherwise(kind).alias("kind"), fine(F.coalesce("name", F.lit(""))).alias("name"), F.lit(None).cast("string").alias("uuid"), *(fine(c).alias(f"{p}_{w}") for p, pair in times.items() for w, c in zip(("value", "rate"), pair)),
        fine(F.col("media")).alias("media"), fine(F.lit(0).cast("long")).alias("effects"), fine(F.col("markers")).alias("markers"), F.lit(None).cast("string").alias("inside"), F.coalesce("extra", F.nullif(more, F.lit("{}"))).alias("extra"),
    ).select(*ITEM, "offset_value", "offset_rate")


def losses(items: DataFrame) -> DataFrame:
    """The ledger of what rows don't hold of XML projects: (doc, tag, items)."""
    lost = F.from_json("extra", "lost array<string>")["lost"]
    return items.where("kind <> 'error'").select("doc", F.explode(lost).alias("tag")).groupBy("doc", "tag").agg(F.count("*").alias("items"))
