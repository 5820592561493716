"""Three-way merges and comparisons of timelines and notes as equi-joins over flattened rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_notes(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The merged notes (id, author, anchor, status, pin, attachment, created_ms) with the reason of a conflict, if any.

    Added on one side: kept. Deleted on a side that had it: gone. Open gives way to a decision,
    resolved against rejected is a conflict that keeps ours; pin and attachment take the side
    that changed them, and are a conflict where both did differently.
    """
    cols = ["author", "anchor", "status", "pin", "attachment", "created_ms"]
    side = lambda df, p: df.select("id", F.struct(*cols).alias(p))
    j = side(base, "b").join(side(ours, "o"), "id", "full").join(side(theirs, "t"), "id", "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    both = o.isNotNull() & t.isNotNull()
    gone = b.isNotNull() & ~both
    so, st = F.col("o.status"), F.col("t.status")
    clash = (so != st) & (so != "OPEN") & (st != "OPEN")
    status = F.when(so == "OPEN", st).otherwise(so)

    def pick(f: str) -> tuple[Column, Column]:
        vo, vt, vb = F.col(f"o.{f}"), F.col(f"t.{f}"), F.col(f"b.{f}")
        split = ~vo.eqNullSafe(vt) & ~vo.eqNullSafe(vb) & ~vt.eqNullSafe(vb)
        return F.when(vo.eqNullSafe(vb), vt).otherwise(vo), split

    (pin, pin_split), (att, att_split) = pick("pin"), pick("attachment")
    same = o.eqNullSafe(t)
    old = b.isNotNull() & both & ~same
    reason = F.when(b.isNull() & both & ~same, "id collision").when(old & clash, "status").when(old & att_split, "attachment").when(old & pin_split, "pin")
    one = F.coalesce(o, t)
    fuse = old & ~clash
    return j.where(~gone).select(
        "id", one["author"].alias("author"), one["anchor"].alias("anchor"), F.when(fuse, status).otherwise(one["status"]).alias("status"),
        F.when(fuse, pin).otherwise(one["pin"]).alias("pin"), F.when(fuse, att).otherwise(one["attachment"]).alias("attachment"),
        F.when(fuse, F.greatest(F.col("o.created_ms"), F.col("t.created_ms"))).otherwise(one["created_ms"]).alias("created_ms"), reason.alias("conflict"),
    )


def answered_twice(notes: DataFrame) -> DataFrame:
    """The first two ids of every (author, anchor) with several notes, by two minima rather than a list of the group."""
    first = notes.groupBy("author", "anchor").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rest = notes.join(first, ["author", "anchor"]).where("id > first")
    return rest.groupBy("author", "anchor", "first").agg(F.min("id").alias("second"))


def apply_changelist(clips: DataFrame, items: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The clips (doc, element, track, idx, start, dur, name, url) after a changelist, with ``gains``, and its ledger (doc, note, n, op, status).

    Items (doc, note, n, frame, op, amount, target) are pinned to the element at their frame before anything moves, and run in the order
    of frames, notes, then n. A name that several clips share leads to the first of them that is left. A delete ends a clip;
    what follows on a gone one is ``removed``. Cuts add up: one without a range to cut is ``no range``, one that would leave nothing
    ``refused``. A replacement sets the media of a clip that has one, else it is ``no media``. A gain always applies, and all of them stay in order.
    Few items meet on a clip; they are folded in one value, beside the clips of a name that items lead to. Both tables are dealt by doc, in
    ``parts`` if given (one that lies so already stays where it is), and meet in unions and windows by doc, as joins on more than doc would move them again.
    """
    dealt = [*([parts] if parts else []), "doc"]
    clips, items = clips.repartition(*dealt), items.repartition(*dealt)
    pinned = _pinned(clips, items)
    own = F.struct("track", "idx", "start", "dur", "name", "url").alias("clip")
    led = _led(clips.select("doc", "element", own), pinned.where("element is not null"))
    led = led.select("doc", "element", "clips", _changes(told=False).alias("s"))
    led = led.select("doc", "element", F.posexplode("clips").alias("nth", "c"), "s").where("coalesce(nth >= s.at, true)")  # a plain comparison would have the fold run twice, to see that it isn't null
    left = led.select("doc", "element", "c.*", F.when(F.col("nth") == F.col("s.at"), F.col("s")).alias("s"))
    place = (F.row_number().over(Window.partitionBy("doc", "track").orderBy("idx")) - 1).cast("long")
    head, tail = F.coalesce("s.head", F.lit(0)), F.coalesce("s.tail", F.lit(0))
    after = left.select(
        "doc", "element", "track", place.alias("idx"), (F.col("start") + head).alias("start"), (F.col("dur") - head - tail).alias("dur"), "name", F.coalesce("s.url", "url").alias("url"), F.coalesce("s.gains", F.array().cast("array<bigint>")).alias("gains")
    )
    told = _led(clips.select("doc", "element", own), pinned).select("doc", F.explode(_changes(told=True)["said"]).alias("r"))
    return after, told.select("doc", "r.*")


def _pinned(clips: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, frame, element, step): each item with the clip that holds its frame, as :func:`element_at` says, in windows by doc.

    A frame stands on each track of its doc, behind the clips that begin at or before it; the one of them that ends last holds it if any does.
    """
    none, frame = F.lit(None), F.col("frame")
    before = Window.partitionBy("doc", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    c = clips.where("dur is not null").select("doc", "track", "dur", "element", F.coalesce(F.sum("dur").over(before), F.lit(0)).alias("at")).where("dur > 0")
    c = c.select("doc", "at", "track", F.struct((F.col("at") + F.col("dur")).alias("end"), "element").alias("clip"))
    frames = items.groupBy("doc", "frame").agg(F.lit(True).alias("looks"))
    both = c.withColumn("looks", F.lit(False)).unionByName(frames.select("doc", frame.alias("at"), none.cast(c.schema["track"].dataType).alias("track"), none.cast(c.schema["clip"].dataType).alias("clip"), "looks"))
    tracks = F.collect_set("track").over(Window.partitionBy("doc"))
    both = both.withColumn("tracks", tracks).withColumn("track", F.explode(F.when(F.col("looks"), F.col("tracks")).otherwise(F.array("track"))))
    upto = Window.partitionBy("doc", "track").orderBy("at", "looks").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("clip", F.max("clip").over(upto)).where("looks and clip.end > at").select("doc", F.col("at").alias("frame"), "track", "clip.element")
    steps = items.select("doc", "frame", F.struct("frame", "note", "n", "op", "amount", "target").alias("step"))
    both = hit.unionByName(steps, allowMissingColumns=True)
    return both.withColumn("element", F.min_by("element", "track").over(Window.partitionBy("doc", "frame"))).where("step is not null").select("doc", "frame", "element", "step")


def _led(clips: DataFrame, pinned: DataFrame) -> DataFrame:
    """(doc, element, steps, clips): items in their order, and the clips of their name in theirs; a clip that none leads to is alone, and so are items of a frame without a clip."""
    rows = clips.unionByName(pinned, allowMissingColumns=True)
    led = F.max(F.col("step").isNotNull()).over(Window.partitionBy("doc", "element")) & F.col("element").isNotNull()
    rows = rows.withColumn("alone", F.when(~led, F.struct("clip.track", "clip.idx", "frame")))
    return rows.groupBy("doc", "element", "alone").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.sort_array(F.collect_list("clip")).alias("clips"))


def _changes(told: bool) -> Column:
    """What ``steps`` do to ``clips`` of one name: (at, cut, head, tail, url, gains) of the first clip that is left, and with ``told`` what is ``said`` of each."""
    said, zero = "array<struct<note:bigint,n:int,op:string,status:string>>", F.lit(0).cast("long")
    none = {"cut": zero, "head": zero, "tail": zero, "url": F.lit(None).cast("string"), "gains": F.array().cast("array<bigint>")}
    begin = F.struct(F.lit(0).alias("at"), *(v.alias(n) for n, v in none.items()), *([F.array().cast(said).alias("said")] if told else []))

    def one(s: Column, x: Column) -> Column:
        clip, trim = F.get(F.col("clips"), s["at"]), x["op"].isin("trim_in", "trim_out")
        status = (
            F.when(F.size("clips") == 0, "no clip").when(s["at"] >= F.size("clips"), "removed").when(trim & clip["dur"].isNull(), "no range").when(trim & (clip["dur"] - s["cut"] - x["amount"] <= 0), "refused")
            .when((x["op"] == "replace") & clip["url"].isNull(), "no media").otherwise("applied")
        )
        return F.get(F.transform(F.array(status), lambda t: then(s, x, t)), 0)  # so that the status is found once

    def then(s: Column, x: Column, status: Column) -> Column:
        is_op = lambda kind: (status == "applied") & (x["op"] == kind)
        gone, amount = is_op("delete"), F.coalesce(x["amount"], zero)
        now = {
            "cut": F.when(is_op("trim_in") | is_op("trim_out"), s["cut"] + x["amount"]).otherwise(s["cut"]), "head": F.when(is_op("trim_in"), s["head"] + amount).otherwise(s["head"]), "tail": F.when(is_op("trim_out"), s["tail"] + amount).otherwise(s["tail"]),
            "url": F.when(is_op("replace"), x["target"]).otherwise(s["url"]), "gains": F.when(is_op("gain"), F.concat(s["gains"], F.array(x["amount"]))).otherwise(s["gains"]),
        }
        row = F.struct(x["note"].alias("note"), x["n"].alias("n"), x["op"].alias("op"), status.alias("status"))
        same = [F.concat(s["said"], F.array(row)).alias("said")] if told else []
        new = F.struct((s["at"] + 1).alias("at"), *(v.alias(n) for n, v in none.items()), *same)
        return F.when(gone, new).otherwise(F.struct(s["at"].alias("at"), *(v.alias(n) for n, v in now.items()), *same))

    return F.aggregate("steps", begin, one)


def cherry_pick(source: DataFrame, target: DataFrame, picks: DataFrame) -> DataFrame:
    """Where each picked element (doc, element) of a branch lands in the target: (doc, element, track, after, status).

    It lands after the last clip of the first track that holds one of those before it in the branch; without
    such an anchor at the end of the track of its own kind. What the branch lacks or the target has is refused.
    """
    s = source.select("doc", "element", F.col("track").alias("s_track"), F.col("idx").alias("s_idx"))
    has = target.select("doc", "element", F.lit(True).alias("there"))
    p = picks.join(s, ["doc", "element"], "left").join(has, ["doc", "element"], "left")
    anchors = target.select("doc", F.col("element").alias("a"), "track", "idx").join(s.withColumnRenamed("element", "a"), ["doc", "a"])
    before = p.join(anchors.select("doc", "s_track", F.col("s_idx").alias("a_idx"), "track", "idx"), ["doc", "s_track"]).where("a_idx < s_idx")
    # a doc's picks are few; of its anchors only the least track and its last place are kept
    spot = before.groupBy("doc", "element").agg(F.min(F.struct("track", (-F.col("idx")).alias("back"))).alias("m"))
    end = target.groupBy("doc", F.col("track").alias("s_track")).agg(F.max("idx").alias("end"))
    j = p.join(spot, ["doc", "element"], "left").join(end, ["doc", "s_track"], "left")
    status = F.when(F.col("s_idx").isNull(), "not in the branch").when(F.col("there"), "already there").otherwise("picked")
    fine = status == "picked"
    return j.select("doc", "element", F.when(fine, F.coalesce("m.track", "s_track")).alias("track"), F.when(fine, F.coalesce(-F.col("m.back"), "end", F.lit(-1))).alias("after"), status.alias("status"))


def verify_roundtrip(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per doc: clips kept, dropped and added (matched by name and its occurrence), and drift of durations, whole and below a frame."""
    n = F.row_number().over(Window.partitionBy("doc", "name").orderBy("idx"))
    a = before.withColumn("n", n).select("doc", "name", "n", F.col("dur").alias("da"))
    b = after.withColumn("n", n).select("doc", "name", "n", F.col("dur").alias("db"))
    j = a.join(b, ["doc", "name", "n"], "full")
    drift = F.abs(F.col("da") - F.col("db"))
    return j.groupBy("doc").agg(
        F.count_if(F.col("da").isNotNull() & F.col("db").isNotNull()).alias("kept"), F.count_if(F.col("db").isNull()).alias("dropped"), F.count_if(F.col("da").isNull()).alias("added"),
        F.count_if(drift >= 1).alias("whole_drift"), F.count_if((drift > 0) & (drift < 1)).alias("sub_drift"),
    )


_AUDITED = {"clips": "kind = 'clip'", "gaps": "kind = 'gap'", "transitions": "kind = 'transition'", "audio": "kind = 'clip' and track_kind = 'Audio'", "linked": "link is not null"}


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per doc what a round trip kept: counts of either side, and what differs, for items (doc, track, track_kind, kind, effects, params, markers, link)."""

    def side(df: DataFrame, p: str) -> DataFrame:
        counts = [F.count_if(F.expr(cond)).alias(f"{p}_{n}") for n, cond in _AUDITED.items()]
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{p}_{c}") for c in ("effects", "params", "markers")]
        # a doc's few tracks are gathered, as distinct counts would send each item three times
        by_kind = [F.size(F.collect_set(F.when(F.col("track_kind") == k, F.col("track")))).cast("long").alias(f"{p}_{k.lower()}_tracks") for k in ("Video", "Audio")]
        return df.groupBy("doc").agg(*counts, *sums, *by_kind)

    b, a = side(before, "before"), side(after, "after")
    names = [c.removeprefix("before_") for c in b.columns if c != "doc"]
    j = b.join(a, "doc", "full").na.fill(0)
    lost = F.array_compact(F.array(*(F.when(F.col(f"before_{n}") != F.col(f"after_{n}"), F.lit(n)) for n in names)))
    return j.withColumn("differs", F.array_join(lost, ","))


#: Frames of a bin in :func:`element_at`.
BIN = 1024


def element_at(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """(doc, frame, element): the clip that holds a frame, half-open; of several tracks the lowest rank wins.

    Positions are running sums inside the doc's tracks. A clip stands in each bin of frames that it
    touches, so frames and clips meet in an equi-join on doc and bin.
    """
    before = Window.partitionBy("doc", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    c = clips.select("doc", "track", "idx", "dur", "element").withColumn("pos", F.coalesce(F.sum("dur").over(before), F.lit(0))).where("dur > 0")
    c = c.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / BIN), F.floor((F.col("pos") + F.col("dur") - 1) / BIN))))
    hit = frames.withColumn("bin", F.floor(F.col("frame") / BIN)).join(c, ["doc", "bin"]).where((F.col("frame") >= F.col("pos")) & (F.col("frame") < F.col("pos") + F.col("dur")))
    return hit.groupBy("doc", "frame").agg(F.min_by("element", "track").alias("element"))
