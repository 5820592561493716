"""Queries over read-side views, small predicates and functions without a built-in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import exact as X
from tesserae.functions.note_grammar import note_ops as parse
from tesserae.operators import activity as A
from tesserae.operators import threeway as Y
from tesserae.operators import views as V
from tesserae.operators.store import numbered
from tesserae.plans.activity import MS
from tesserae.plans.derived import ENTRIES, FILES, JOURNAL, files, journal, manifest_entries, millis
from tesserae.plans.registry import query, table
from tesserae.scratch import saved

_STATES = list(V.TRANSITIONS)


def _pick(values, n):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


@query(f"""with s as (select event_id, {_STATES}[(event_id % 9 + 1)::int] as before, {_STATES}[(event_id // 9 % 9 + 1)::int] as after from events)
select event_id, before, after, before = after or before || '>' || after in ({', '.join(f"'{a}>{b}'" for a, bs in V.TRANSITIONS.items() for b in bs.split())}) as allowed from s""")
def state_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", _pick(_STATES, F.col("event_id")).alias("before"), _pick(_STATES, F.floor(F.col("event_id") / 9)).alias("after"))
    return e.withColumn("allowed", V.may_follow(F.col("before"), F.col("after")))


_KINDS = list(V.ERRORS)


@query(f"""with k as (select event_id, {_KINDS}[(event_id % 20 + 1)::int] as kind from events), d as (select * from (values {', '.join(f"('{k}', '{c}', '{r}')" for k, (c, r) in V.ERRORS.items())}) t(kind, code, retry))
select code, retry, count(*) as n from k join d using (kind) group by 1, 2""")
def error_codes(spark, sf_dir):
    return V.with_errors(table(spark, sf_dir, "events").select(_pick(_KINDS, F.col("event_id")).alias("kind"))).groupBy("code", "retry").agg(F.count("*").alias("n"))


@query(f"""with {FILES}, disk as (select path, case when doc_id % 6 = 0 then size - 1 else size end as size from files where doc_id % 3 <> 1)
select f.project_id, f.path from files f left join disk d using (path) where manifest is not null and local_state in ('synced', 'clean', 'placeholder') and (d.path is null or (local_state = 'placeholder' and d.size <> f.size))""")
def hydration_candidates(spark, sf_dir):
    f = files(spark, sf_dir)
    disk = f.where("doc_id % 3 <> 1").select("path", F.when(F.col("doc_id") % 6 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    return V.hydration(f, disk).select("project_id", "path")


@query("""with v as (select p_partkey, p_partkey * 1000 as total, p_partkey * 37 % 900 * p_partkey // 3 as free, p_size * 3 as pct, p_partkey * 100 as live from part)
select p_partkey, case when total > 0 and pct between 1 and 99 and free < total * pct // 100 then least(live, total * pct // 100 - free) end as target from v""")
def eviction_target(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", V.eviction_target(k * 1000, F.floor(k * 37 % 900 * k / 3), F.col("p_size") * 3, k * 100).cast("long").alias("target"))


@query("select o_orderkey, case when o_orderkey % 9 <> 0 and o_orderkey % 4 = 0 then 'file_changed' when o_orderkey % 7 <> 0 and o_orderkey % 5 = 0 then 'timeline_moved' else 'current' end as status from orders")
def handoff_status(spark, sf_dir):
    k = F.col("o_orderkey")
    file_now = F.when(k % 9 == 0, F.lit(None)).otherwise(F.when(k % 4 == 0, "x").otherwise("a"))
    line_now = F.when(k % 7 == 0, F.lit(None)).otherwise(F.when(k % 5 == 0, "y").otherwise("b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.handoff(file_now, F.lit("a"), line_now, F.lit("b")).alias("status"))


@query(f"""with a as (select user_id as device, {MS} as ts_ms, event_id as id from events where event_type <> 'view'), top as (select distinct device from (select * from a order by ts_ms desc, id desc limit 12))
select m.device, coalesce(n, 0) as records, t.device is not null as recent from (select distinct user_id as device from events) m left join (select device, count(*) as n from a group by 1) c using (device) left join top t using (device)""")
def team_view(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    audit = e.where("event_type <> 'view'").select(F.col("user_id").alias("device"), F.expr(millis("ts")).alias("ts_ms"), F.col("event_id").alias("id"))
    return V.team(e.select(F.col("user_id").alias("device")).distinct(), audit, 12)


@query("""with e as (select l_orderkey as doc, l_linenumber::bigint as uuid, min(l_partkey) as start, 'm' || min(l_suppkey) as name from lineitem group by 1, 2),
n as (select doc, uuid, start + 5 as start, 'note' as name from e where uuid % 2 = 0), u as (select * from e where (doc, uuid) not in (select doc, uuid from n) union all select * from n)
select *, row_number() over (partition by doc order by start, name, uuid)::int as n from u""")
def note_markers(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("uuid")).agg(F.min("l_partkey").alias("start"), F.concat(F.lit("m"), F.min("l_suppkey").cast("string")).alias("name"))
    return V.markers(e, e.where("uuid % 2 = 0").select("doc", "uuid", (F.col("start") + 5).alias("start"), F.lit("note").alias("name")))


@query("""with r as (select p_partkey, [24000, 30000, 25, 60, 48000][(p_partkey % 5 + 1)::int] as num, [1001, 1001, 1, 1, 1000][(p_partkey % 5 + 1)::int] as den from part)
select p_partkey, greatest(1, (num + den - 1) // den)::bigint as timebase, den > 1 and num % den <> 0 as ntsc from r""")
def rate_fields(spark, sf_dir):
    basis, ntsc = V.rate_fields(_pick([24000, 30000, 25, 60, 48000], F.col("p_partkey")), _pick([1001, 1001, 1, 1, 1000], F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", basis.cast("long").alias("timebase"), ntsc.alias("ntsc"))


@query("select o_custkey as link, o_orderkey as at_key, row_number() over (partition by o_custkey order by o_orderkey)::int as number, o_orderkey = max(o_orderkey) over (partition by o_custkey) as latest from orders")
def version_stack(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("link"), F.col("o_orderkey").alias("at"))
    return V.version_stack(v).withColumnRenamed("at", "at_key")


@query(f"with {JOURNAL} select project_id, path, max(server_ms) as created, count(*) as raised from journal where kind = 'file_upsert' group by 1, 2")
def merge_offers(spark, sf_dir):
    j = journal(spark, sf_dir).where("kind = 'file_upsert'")
    return V.offers(j.select("project_id", "path", F.col("server_ms").alias("created")))


@query("""with r as (select event_id, event_type as family, case when event_id % 3 = 0 then 'plain ' || event_id else props end as payload from events)
select event_id, family, event_id % 3 <> 0 as is_json, case when event_id % 3 = 0 then '{"text":"' || payload || '"}' else payload end as shown from r where family in ('click', 'signup')""")
def raw_records(spark, sf_dir):
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("plain "), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    r = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("family"), payload.alias("payload"))
    return V.raw_records(r, ["click", "signup"]).select("event_id", "family", "is_json", "shown")


@query("select s_nationkey as volume, max(s_suppkey * 10) as total, min(s_suppkey) as free from supplier group by 1")
def workspace_volumes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("volume"), (F.col("s_suppkey") * 10).alias("total"), F.col("s_suppkey").alias("free"))
    return V.volumes(s)


@query(f"""with {ENTRIES} select manifest, sha256(string_agg(sha256(chunk::varchar), '' order by idx)) as file_hash, sum(len)::bigint as total_len, true as gapless from entries group by 1""")
def manifest_reassemble(spark, sf_dir):
    return V.reassembled(manifest_entries(spark, sf_dir))


@query("""with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events) select user_id, event_id from a where n % 10 = 1""")
def every_tenth(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n")).where("n % 10 = 1").drop("n")


@query(f"select user_id % 10 as tenant, strftime(ts, '%Y-%m-%d') as day, sum(event_id % 1000)::bigint as bytes_uploaded from events group by 1, 2")
def uploaded_bytes(spark, sf_dir):
    from tesserae.functions.scalar import day

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tenant"), day(F.expr(millis("ts"))).alias("day"), (F.col("event_id") % 1000).alias("b"))
    return e.groupBy("tenant", "day").agg(F.sum("b").alias("bytes_uploaded"))


@query("select o_custkey % 50 as author, o_orderkey as id, substr(sha256(o_orderkey || chr(31) || o_orderpriority || chr(31) || o_custkey), 1, 16) as v1, substr(sha256('note2' || chr(31) || o_orderkey || chr(31) || o_orderpriority || chr(31) || o_custkey || chr(31) || 'comment' || chr(31) || '' || chr(31) || 'public'), 1, 16) as v2 from orders")
def note_ids(spark, sf_dir):
    own = [F.col(c).cast("string") for c in ("o_orderkey", "o_orderpriority", "o_custkey")]
    tag = lambda *f: F.substring(F.sha2(F.concat_ws("\x1f", *f), 256), 1, 16)
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("author"), F.col("o_orderkey").alias("id"), tag(*own).alias("v1"), tag(F.lit("note2"), *own, F.lit("comment"), F.lit(""), F.lit("public")).alias("v2"))


@query("select l_orderkey as doc, count_if(l_returnflag = 'A') as video, count_if(l_returnflag = 'N') as audio, count_if(l_returnflag = 'R') as gaps, count(*) as items from lineitem group by 1")
def track_counts(spark, sf_dir):
    k = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(k("A").alias("video"), k("N").alias("audio"), k("R").alias("gaps"), F.count("*").alias("items"))


@query(f"with {FILES} select project_id, count_if(local_state in ('dirty', 'fetching')) as pending, count_if(local_state = 'conflict') as stuck from files group by 1")
def pending_counts(spark, sf_dir):
    s = F.col("local_state")
    return files(spark, sf_dir).groupBy("project_id").agg(F.count_if(s.isin("dirty", "fetching")).alias("pending"), F.count_if(s == "conflict").alias("stuck"))


@query("""with recursive o as (select user_id, event_type <> 'error' as ok, row_number() over (partition by user_id order by event_id) as n from events),
r as (select distinct user_id, 0::bigint as n, 4 as lim from o union all select o.user_id, o.n, case when ok then least(64, lim + 1) else greatest(4, lim // 2) end from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select user_id, max_by(lim, n)::int as last_limit, max(lim)::int as peak from r where n > 0 group by 1""")
def aimd_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return A.aimd(e).groupBy("user_id").agg(F.max_by("limit", "event_id").cast("int").alias("last_limit"), F.max("limit").cast("int").alias("peak"))


@query("select p_partkey, nfc_normalize(p_name || '/cafe' || chr(769)) as path from part")
def nfc_paths(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("/cafe\u0301"))
    return table(spark, sf_dir, "part").select("p_partkey", X.nfc(name).alias("path"))


@query("""with r as (select o_orderkey, o_orderkey::hugeint as k, (o_custkey % 7)::hugeint as d from orders),
f as (select o_orderkey, unnest(['add', 'sub', 'mul', 'div']) as op, unnest([k * d + 1001 * 24, k * d - 1001 * 24, k * 1001, k * d]) as n, unnest([24 * d, 24 * d, 24 * d, 24 * 1001]) as m, d from r),
g as (select *, case when d = 0 then null else (n // gcd(abs(n), m))::varchar || '/' || (m // gcd(abs(n), m))::varchar end as v from f)
select o_orderkey, max(v) filter (op = 'add') as add, max(v) filter (op = 'sub') as sub, max(v) filter (op = 'mul') as mul, max(v) filter (op = 'div') as div from g group by 1""")
def rational_arithmetic(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    a, b = F.concat(k, F.lit("/24")), F.concat(F.lit("1001/"), (F.col("o_custkey") % 7).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *(X.rational(op, a, b).alias(op) for op in ("add", "sub", "mul", "div")))


@query()
def compressed_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").alias("raw"), X.zstd_size(F.col("text").cast("binary")).alias("packed"))


@query(f"""with recursive {ENTRIES}, seq as (select manifest, idx, row_number() over (partition by manifest order by chunk, idx) as n from entries),
r as (select manifest, n, [idx] as tops from seq where n = 1 union all
    select s.manifest, s.n, tops[1:len([y for y in tops if y < s.idx])] || [s.idx] || tops[len([y for y in tops if y < s.idx]) + 2:] from r join seq s on s.manifest = r.manifest and s.n = r.n + 1),
stay as (select manifest, unnest(arg_max(tops, n)) as idx from r group by 1)
select manifest, idx as moved from seq where not exists (select 1 from stay where stay.manifest = seq.manifest and stay.idx = seq.idx)""")
def moved_items(spark, sf_dir):
    """Lines of an order that moved, if its chunks were sorted; each manifest streams through its piles."""
    e = saved(numbered(manifest_entries(spark, sf_dir), ["chunk", "idx"], ["manifest"], "n"))
    kept = Y.moved_in_track(e, ["manifest"], "n", "idx")
    return kept.where("not stays").join(e, ["manifest", "n"]).select("manifest", F.col("idx").alias("moved"))


@query("select event_id, case when event_id % 5 in (0, 2, 3) then 'mechanical' else 'creative' end as part, (event_id % 5 in (0, 2, 3))::int as n_ops from events")
def changelist_partition(spark, sf_dir):
    notes = ["cut 2 seconds off the end", "I love this", "make it louder by 4 db. Nice", "replace it with b-roll", "hmm"]
    e = table(spark, sf_dir, "events").select("event_id", _pick(notes, F.col("event_id")).alias("body")).withColumn("ops", parse("body"))
    return e.select("event_id", F.when(F.size("ops") > 0, "mechanical").otherwise("creative").alias("part"), F.size("ops").alias("n_ops"))
