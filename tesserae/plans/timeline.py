"""Queries over orders and lines read as notes and timelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import timeline as T
from tesserae.plans.derived import ENTRIES, manifest_entries
from tesserae.plans.registry import query, table
from tesserae.scratch import buckets, saved

_BASE_NOTES = "select o_orderkey as id, o_custkey % 50 as author, o_orderkey % 400 as anchor, case o_orderstatus when 'O' then 'OPEN' when 'F' then 'RESOLVED' else 'REJECTED' end as status, o_custkey % 5 as pin, o_orderpriority as attachment, o_orderkey * 1000 as created_ms from orders"
_TURN = "case when o_orderkey % {a} = 0 then case status when 'OPEN' then '{to}' else 'OPEN' end else status end"


def _notes_sql(drop: int, turn: int, to: str, pin: int, att: int, late: int, extra: int) -> str:
    return f"""select id, author, anchor, case when id % {turn} = 0 then '{to}' else status end as status, case when id % {pin} = 0 then pin + {pin} else pin end as pin,
        case when id % {att} = 0 then 'a{att}' else attachment end as attachment, created_ms + case when id % {late} = 0 then {late} else 0 end as created_ms
        from every where id % {drop} <> 0 and (id % 20 <> 3 or id % {extra} = 0)"""


_NOTES = f"""every as ({_BASE_NOTES}), b as (select * from every where id % 20 <> 3), o as ({_notes_sql(11, 7, 'RESOLVED', 13, 23, 4, 2)}), t as ({_notes_sql(17, 5, 'REJECTED', 19, 29, 6, 3)})"""


def _notes(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("REJECTED")
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("author"), (F.col("o_orderkey") % 400).alias("anchor"), status.alias("status"), (F.col("o_custkey") % 5).alias("pin"), F.col("o_orderpriority").alias("attachment"), (F.col("o_orderkey") * 1000).alias("created_ms"))

    def side(drop, turn, to, pin, att, late, extra):
        at = lambda n: F.col("id") % n == 0
        return every.where(~at(drop) & ((F.col("id") % 20 != 3) | at(extra))).withColumns({
            "status": F.when(at(turn), to).otherwise(F.col("status")), "pin": F.when(at(pin), F.col("pin") + pin).otherwise(F.col("pin")),
            "attachment": F.when(at(att), f"a{att}").otherwise(F.col("attachment")), "created_ms": F.col("created_ms") + F.when(at(late), late).otherwise(0),
        })

    return every.where("id % 20 <> 3"), side(11, 7, "RESOLVED", 13, 23, 4, 2), side(17, 5, "REJECTED", 19, 29, 6, 3)


_MERGED = """j as (select coalesce(o.id, t.id, b.id) as id, b.id as bid, o.id as oid, t.id as tid, b.pin as bp, o.pin as op, t.pin as tp, b.attachment as ba, o.attachment as oa, t.attachment as ta, o.status as os, t.status as ts,
    o.created_ms as oc, t.created_ms as tc, coalesce(o.author, t.author) as author, coalesce(o.anchor, t.anchor) as anchor, (o.status, o.pin, o.attachment, o.created_ms) = (t.status, t.pin, t.attachment, t.created_ms) as same
    from b full join o on b.id = o.id full join t on t.id = coalesce(b.id, o.id)),
k as (select *, bid is not null and oid is not null and tid is not null and not same as old, os <> ts and os <> 'OPEN' and ts <> 'OPEN' as clash from j where bid is null or (oid is not null and tid is not null)),
m as (select id, author, anchor, case when old and not clash then case when os = 'OPEN' then ts else os end else coalesce(os, ts) end as status,
    case when old and not clash then case when op = bp then tp else op end else coalesce(op, tp) end as pin,
    case when old and not clash then case when oa = ba then ta else oa end else coalesce(oa, ta) end as attachment,
    case when old and not clash then greatest(oc, tc) else coalesce(oc, tc) end as created_ms,
    case when bid is null and oid is not null and tid is not null and not same then 'id collision' when old and clash then 'status' when old and oa <> ta and oa <> ba and ta <> ba then 'attachment' when old and op <> tp and op <> bp and tp <> bp then 'pin' end as conflict from k)"""


@query(f"with {_NOTES}, {_MERGED} select * from m")
def notes_merge(spark, sf_dir):
    return T.merge_notes(*_notes(spark, sf_dir))


@query(f"with {_NOTES}, {_MERGED}, r as (select author, anchor, id, row_number() over (partition by author, anchor order by id) as n from m) select a.author, a.anchor, a.id as first, b.id as second from r a join r b using (author, anchor) where a.n = 1 and b.n = 2")
def notes_answered_twice(spark, sf_dir):
    return T.answered_twice(T.merge_notes(*_notes(spark, sf_dir)))


def _clips(spark, sf_dir, parts=None):
    e, chunk = manifest_entries(spark, sf_dir, parts), F.col("chunk")
    return e.select(F.col("manifest").alias("doc"), F.concat(F.lit("e"), F.col("idx").cast("string")).alias("element"), (chunk % 3).alias("track"), "idx", (chunk % 50).alias("start"), F.col("len").alias("dur"), F.concat(F.lit("clip"), (chunk % 40).cast("string")).alias("name"), "chunk")


_CLIPS = f"{ENTRIES}, clips as (select manifest as doc, 'e' || idx as element, chunk % 3 as track, idx, chunk % 50 as start, len as dur, 'clip' || chunk % 40 as name, chunk from entries)"


_PICKS = f"""{_CLIPS}, target as (select doc, element, (track + doc) % 2 as track, row_number() over (partition by doc, (track + doc) % 2 order by idx) - 1 as idx from clips where chunk % 3 <> 0),
picks as (select doc, element from clips where chunk % 3 = 0 union all select doc, element from clips where idx = 1 union all select doc, 'zz' from clips where idx = 2 group by doc)"""


@query(f"""with {_PICKS}, p as (select k.doc, k.element, s.track as st, s.idx as si, t.element is not null as there from (select distinct * from picks) k left join clips s on s.doc = k.doc and s.element = k.element left join target t on t.doc = k.doc and t.element = k.element),
spot as (select p.doc, p.element, min((t.track, -t.idx)) as m from p join clips s on s.doc = p.doc and s.track = p.st and s.idx < p.si join target t on t.doc = s.doc and t.element = s.element group by 1, 2),
e as (select doc, track, max(idx) as last from target group by 1, 2)
select p.doc, p.element, case when si is not null and not there then coalesce(m[1], st) end as track, case when si is not null and not there then coalesce(-m[2], last, -1) end::bigint as after,
    case when si is null then 'not in the branch' when there then 'already there' else 'picked' end as status
from p left join spot using (doc, element) left join e on e.doc = p.doc and e.track = p.st""")
def cherry_picks(spark, sf_dir):
    c = saved(_clips(spark, sf_dir))
    lane = (F.col("track") + F.col("doc")) % 2
    target = c.where("chunk % 3 <> 0").select("doc", "element", lane.alias("track"), "idx")
    target = target.withColumn("idx", (F.row_number().over(Window.partitionBy("doc", "track").orderBy("idx")) - 1).cast("long"))
    picks = c.where("chunk % 3 = 0 or idx = 1").select("doc", "element").unionByName(c.where("idx = 2").select("doc", F.lit("zz").alias("element"))).distinct()
    return T.cherry_pick(c, target, picks)


_OPS = ["trim_in", "gain", "delete", "replace", "trim_out", "trim_out", "gain"]


def _items(spark, sf_dir, parts):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey").repartition(parts, "doc")
    each = o.select("doc", "o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i"))
    i = F.col("i")
    op = F.element_at(F.array(*(F.lit(x) for x in _OPS)), ((F.col("doc") + i) % len(_OPS) + 1).cast("int"))
    frame = (F.col("o_custkey") * 7 + F.floor(i / 2) * (F.col("doc") % 3) * 50) % 1500
    return each.select("doc", F.floor(i / 2).alias("note"), (i % 2).cast("int").alias("n"), frame.alias("frame"), op.alias("op"), (F.col("o_custkey") % 90 + i).alias("amount"), F.concat(F.lit("shot"), i.cast("string")).alias("target"))


def _named_clips(spark, sf_dir, parts):
    """Clips of which some share a name, some have no media, and some no range."""
    c, chunk = _clips(spark, sf_dir, parts), F.col("chunk")
    none = F.lit(None)
    return c.select("doc", F.concat(F.lit("n"), (F.col("idx") % 4).cast("string")).alias("element"), "track", "idx", F.when(chunk % 10 > 0, F.col("start")).otherwise(none).alias("start"), F.when(chunk % 10 > 0, F.col("dur")).otherwise(none).alias("dur"), "name", F.when(chunk % 3 > 0, F.concat(F.lit("m"), (chunk % 9).cast("string"))).alias("url"))


def _changelist(spark, sf_dir):
    """Clips after a changelist and its ledger; orders and lines are dealt by document once, into parts whose size does not grow with them."""
    parts = buckets(table(spark, sf_dir, "lineitem").count())
    return T.apply_changelist(_named_clips(spark, sf_dir, parts), _items(spark, sf_dir, parts), parts)


_ITEMS = f"""nclips as (select doc, 'n' || idx % 4 as element, track, idx, case when chunk % 10 > 0 then start end as start, case when chunk % 10 > 0 then dur end as dur, name, case when chunk % 3 > 0 then 'm' || chunk % 9 end as url from clips),
items as (select o_orderkey as doc, i // 2 as note, (i % 2)::int as n, (o_custkey * 7 + i // 2 * (o_orderkey % 3) * 50) % 1500 as frame, {_OPS}[((o_orderkey + i) % {len(_OPS)} + 1)::int] as op, o_custkey % 90 + i as amount, 'shot' || i as target from orders, unnest([0, 1, 2, 3, 4, 5]::bigint[]) x(i)),
spots as (select *, coalesce(sum(dur) over (partition by doc, track order by idx rows between unbounded preceding and 1 preceding), 0) as pos from nclips where dur is not null),
hits as (select i.doc, i.frame, arg_min(element, track) as element from (select distinct doc, frame from items) i join spots s on s.doc = i.doc and i.frame >= pos and i.frame < pos + dur group by 1, 2),
pinned as (select i.*, h.element, row_number() over (partition by i.doc, h.element order by i.frame, note, n) as k from items i left join hits h using (doc, frame)),
alike as (select doc, element, track, idx, dur, url, row_number() over (partition by doc, element order by track, idx) - 1 as a from nclips),
r as (select distinct doc, element, 0::bigint as k, 0::bigint as a, 0::bigint as cut, null::bigint as note, null::int as n, null::varchar as op, null::varchar as status, 0::bigint as amount, null::varchar as target, 0::bigint as hit from pinned where element is not null
    union all select doc, element, k, case when done and op = 'delete' then a + 1 else a end, case when done and op = 'delete' then 0 when done and op like 'trim%' then cut + amount else cut end, note, n, op, status, amount, target, a
    from (select *, status = 'applied' as done from (select p.doc, p.element, p.k, r.a, r.cut, p.note, p.n, p.op, p.amount, p.target, case when c.idx is null then 'removed' when p.op like 'trim%' and c.dur is null then 'no range' when p.op like 'trim%' and c.dur - r.cut - p.amount <= 0 then 'refused'
        when p.op = 'replace' and c.url is null then 'no media' else 'applied' end as status from r join pinned p on p.doc = r.doc and p.element = r.element and p.k = r.k + 1 left join alike c on c.doc = r.doc and c.element = r.element and c.a = r.a)))"""


@query(f"""with recursive {_CLIPS}, {_ITEMS} select doc, note, n, op, status from r where k > 0 union all select doc, note, n, op, 'no clip' from pinned where element is null""")
def changelist_ledger(spark, sf_dir):
    return _changelist(spark, sf_dir)[1]


@query(f"""with recursive {_CLIPS}, {_ITEMS}, d as (select c.doc, c.track, c.idx, r.* exclude (doc) from r join alike c on c.doc = r.doc and c.element = r.element and c.a = r.hit where r.status = 'applied'),
per as (select doc, track, idx, bool_or(op = 'delete') as gone, coalesce(sum(amount) filter (op = 'trim_in'), 0) as head, coalesce(sum(amount) filter (op = 'trim_out'), 0) as tail, arg_max(target, k) filter (op = 'replace') as url, string_agg(amount::varchar, ',' order by k) filter (op = 'gain') as gains from d group by 1, 2, 3)
select c.doc, c.element, c.track, (row_number() over (partition by c.doc, c.track order by c.idx) - 1)::bigint as idx, (start + coalesce(head, 0))::bigint as start, (dur - coalesce(head, 0) - coalesce(tail, 0))::bigint as dur, coalesce(p.url, c.url) as url, coalesce(gains, '') as gains
from nclips c left join per p on p.doc = c.doc and p.track = c.track and p.idx = c.idx where not coalesce(gone, false)""")
def changelist_clips(spark, sf_dir):
    after = _changelist(spark, sf_dir)[0]
    return after.drop("name").withColumn("gains", F.array_join(F.transform("gains", lambda g: g.cast("string")), ","))


@query("""with m as (select l_orderkey as doc, list_sort(list_distinct(list(l_returnflag || l_linenumber))) as a, list_sort(list_distinct(list(l_linestatus || l_linenumber) || list(l_returnflag || (l_linenumber + 1)))) as b from lineitem group by 1)
select doc, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ',') as added, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as removed from m""")
def marker_set_diff(spark, sf_dir):
    n = F.col("l_linenumber")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_set(F.concat("l_returnflag", n.cast("string"))).alias("a"), F.collect_set(F.concat("l_linestatus", n.cast("string"))).alias("b1"), F.collect_set(F.concat("l_returnflag", (n + 1).cast("string"))).alias("b2"))
    b = F.array_union("b1", "b2")
    return m.select("doc", F.array_join(F.array_sort(F.array_except(b, F.col("a"))), ",").alias("added"), F.array_join(F.array_sort(F.array_except(F.col("a"), b)), ",").alias("removed"))


@query(f"""with {_CLIPS}, a as (select doc, name, row_number() over (partition by doc, name order by idx) as n, dur::double as d from clips), b as (select doc, name, row_number() over (partition by doc, name order by idx) as n, case when chunk % 9 = 0 then dur + 0.5 when chunk % 10 = 0 then dur + 2 else dur end::double as d from clips where chunk % 8 <> 0
    union all select doc, 'extra', 1, 1 from clips where idx = 1 and doc % 3 = 0)
select coalesce(a.doc, b.doc) as doc, count(*) filter (a.d is not null and b.d is not null) as kept, count(*) filter (b.d is null) as dropped, count(*) filter (a.d is null) as added, count(*) filter (abs(a.d - b.d) >= 1) as whole_drift, count(*) filter (abs(a.d - b.d) > 0 and abs(a.d - b.d) < 1) as sub_drift
from a full join b on a.doc = b.doc and a.name = b.name and a.n = b.n group by 1""")
def verify_roundtrip(spark, sf_dir):
    c = _clips(spark, sf_dir).withColumn("dur", F.col("dur").cast("double"))
    at = lambda n: F.col("chunk") % n == 0
    after = c.where(~at(8)).withColumn("dur", F.when(at(9), F.col("dur") + 0.5).when(at(10), F.col("dur") + 2).otherwise(F.col("dur")))
    extra = c.where("idx = 1 and doc % 3 = 0").withColumns({"name": F.lit("extra"), "dur": F.lit(1.0)})
    return T.verify_roundtrip(c, after.unionByName(extra))


@query(f"""with {_CLIPS}, p as (select *, coalesce(sum(dur) over (partition by doc, track order by idx rows between unbounded preceding and 1 preceding), 0) as pos from clips), f as (select distinct o_orderkey as doc, o_custkey * 7 % 3000 as frame from orders)
select f.doc, f.frame, arg_min(p.element, p.track) as element from f join p on p.doc = f.doc and frame >= pos and frame < pos + dur group by 1, 2""")
def point_in_interval(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") * 7 % 3000).alias("frame")).distinct()
    return T.element_at(frames, _clips(spark, sf_dir))
