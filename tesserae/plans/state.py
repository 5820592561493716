"""Queries over keys, cursors, leases, marks and small functions of the modelled store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import exact as X
from tesserae.functions import scalar as C
from tesserae.operators import activity as A
from tesserae.operators import journal as J
from tesserae.operators import store as S
from tesserae.operators import timeline as T
from tesserae.operators import views as V
from tesserae.plans.activity import MS, _events
from tesserae.plans.derived import CHUNKS, ENTRIES, FILES, JOURNAL, chunks, files, journal, manifest_entries
from tesserae.plans.registry import query, table
from tesserae.scratch import saved


@query(f"with {FILES} select project_id, path, size, mtime, local_state from files where project_id = 'src6' order by path")
def project_files(spark, sf_dir):
    return S.in_project(files(spark, sf_dir), "src6").select("project_id", "path", "size", "mtime", "local_state")


@query("select * from customer where c_custkey = 42")
def point_lookup(spark, sf_dir):
    return S.lookup(table(spark, sf_dir, "customer"), c_custkey=42)


@query("select p_partkey, p_type from part where starts_with(p_type, 'S') order by p_type")
def prefix_scan(spark, sf_dir):
    return S.with_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "S")


@query(f"with {CHUNKS} select 'all' as asked, hash, size from chunks where tier = 'archive' union all select 'one', hash, size from chunks where tier = 'archive' and hash = (select min(hash) from chunks where tier = 'archive')")
def recall_targets(spark, sf_dir):
    c = chunks(spark, sf_dir)
    one = c.where("tier = 'archive'").agg(F.min("hash")).first()[0]
    pick = lambda asked, rows: rows.select(F.lit(asked).alias("asked"), "hash", "size")
    return pick("all", S.to_recall(c)).unionByName(pick("one", S.to_recall(c, one)))


@query("""with v as (select o_orderkey as id, ['private', 'internal', 'public'][(o_orderkey % 3 + 1)::int] as visibility from orders)
select v.id, v.visibility, a.audience from v join (values ('public'), ('internal'), ('all')) a(audience) on audience = 'all' or visibility = audience""")
def visible_notes(spark, sf_dir):
    from tesserae.sources.writers import visible

    kind = F.element_at(F.array(F.lit("private"), F.lit("internal"), F.lit("public")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("visibility"))
    out = notes.withColumn("audience", F.lit("all"))
    for audience in ("public", "internal"):
        out = out.unionByName(visible(notes, audience).withColumn("audience", F.lit(audience)))
    return out


@query("""with c as (select c_custkey as key, c_nationkey::bigint as v, c_acctbal as moment from customer where c_custkey % 3 <> 0), i as (select c_custkey as key, (c_nationkey + 100)::bigint as v, c_acctbal + (c_custkey % 2) - 0.5 as moment from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0)
select key, v, moment from (select *, 0 as s from c union all select *, 1 from i) qualify row_number() over (partition by key order by moment desc, s desc) = 1""")
def upsert_rows(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("key"), F.col("c_nationkey").cast("long").alias("v"), F.col("c_acctbal").alias("moment"))
    new = rows.where("key % 2 = 0 or key % 3 = 0").select("key", (F.col("v") + 100).alias("v"), (F.col("moment") + F.col("key") % 2 - 0.5).alias("moment"))
    return S.upsert(rows.where("key % 3 <> 0"), new, ["key"], "moment")


@query("select c_custkey as key, 'old' as origin from customer where c_custkey % 3 <> 0 union all select distinct o_custkey, 'new' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0)")
def insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("origin"))
    return S.insert_ignore(old, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("origin")), ["key"])


@query(f"with {JOURNAL}, n as (select * from journal where seq > 200) select project_id, seq, path, device_id, (select max(seq) from n b where b.project_id = n.project_id) as cursor from n where device_id <> 5")
def own_op_suppression(spark, sf_dir):
    return J.foreign(journal(spark, sf_dir), device=5, after=200).select("project_id", "seq", "path", "device_id", "cursor")


@query(f"with {JOURNAL} select project_id, device_id, max_by(base_seq, seq) as cursor from journal group by 1, 2")
def durable_cursors(spark, sf_dir):
    return J.cursors(journal(spark, sf_dir).select("project_id", "device_id", F.col("base_seq").alias("cursor"), F.col("seq").alias("at")))


@query(f"with {JOURNAL} select project_id, seq, path, device_id = 7 as own from journal where project_id in (1, 7)")
def echo_flag(spark, sf_dir):
    return journal(spark, sf_dir).where(F.col("project_id").isin(1, 7)).select("project_id", "seq", "path", (F.col("device_id") == 7).alias("own"))


_EFFECTS = """effects as (
    select project_id, seq, 0 as part, path, case when kind = 'file_upsert' then 'present' else 'tombstone' end as state, manifest, size from journal where kind in ('file_upsert', 'file_delete', 'rename')
    union all select project_id, seq, 1, new_path, 'present', manifest, 0 from journal where kind = 'rename'),
tree0 as (select * from effects qualify row_number() over (partition by project_id, path order by seq desc, part desc) = 1)"""


@query(f"""with {JOURNAL}, {_EFFECTS}, parts as (select project_id, substr(sha256(path), 1, 2) as p, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as d from (select *, path || '|' || manifest || '|' || size as line from tree0 where state = 'present') group by 1, 2),
tops as (select project_id, sum(n)::bigint as paths, sha256(string_agg(p || d, chr(10) order by p)) as tree from parts group by 1)
select m.project_id, snapshot_seq, coalesce(paths, 0) as paths, tree, case when n > 150 then 'entries' when (select max(server_ms) from journal) - old > 86400000 then 'age' else 'demand' end as trigger
from (select project_id, max(seq) as snapshot_seq, count(*) as n, min(server_ms) as old from journal group by 1) m left join tops using (project_id)""")
def snapshot_commit(spark, sf_dir):
    j = journal(spark, sf_dir)
    return J.snapshot_commit(j, j.agg(F.max("server_ms")).first()[0] or 0, most=150)


@query(f"with {JOURNAL}, h as (select path, min(seq) as seq, min_by(event_id % 7, seq) as tries from journal where kind = 'file_upsert' and project_id = 1 group by 1) select path, seq, tries from h where tries < 5 order by seq, path limit 4")
def outbox_flush(spark, sf_dir):
    pending = journal(spark, sf_dir).where("kind = 'file_upsert' and project_id = 1").select("path", "seq", (F.col("event_id") % 7).alias("tries"))
    return J.outbox(pending)


@query(f"""with {JOURNAL}, w as (select project_id, path, seq, device_id, base_seq, server_ms from journal where kind = 'file_upsert'),
c as (select a.*, exists (select 1 from w b where b.project_id = a.project_id and b.path = a.path and b.seq < a.seq and b.seq > a.base_seq and b.device_id <> a.device_id) as conflict from w a)
select project_id, path, seq, conflict, case when conflict then path || ' (conflict — dev' || device_id || ' — ' || strftime(make_timestamp(server_ms * 1000), '%Y-%m-%d') || ')' else path end as lands_at from c""")
def conflict_copies(spark, sf_dir):
    j = J.conflicts(journal(spark, sf_dir).where("kind = 'file_upsert'"))
    copy = C.conflict_copy("path", F.concat(F.lit("dev"), F.col("device_id").cast("string")), C.day("server_ms"))
    return j.select("project_id", "path", "seq", "conflict", F.when(F.col("conflict"), copy).otherwise(F.col("path")).alias("lands_at"))


@query(f"""with {ENTRIES}, f as (select manifest, case when manifest % 5 = 0 and idx = 1 then chunk + 1 else chunk end as chunk, idx from entries where not (manifest % 7 = 0 and idx = 2))
select coalesce(k.manifest, f.manifest) as manifest, bool_and(k.chunk is not distinct from f.chunk) as same from entries k full join f on k.manifest = f.manifest and k.idx = f.idx group by 1""")
def rehash_sweep(spark, sf_dir):
    k = manifest_entries(spark, sf_dir)
    f = k.where("not (manifest % 7 = 0 and idx = 2)").withColumn("chunk", F.when(F.expr("manifest % 5 = 0 and idx = 1"), F.col("chunk") + 1).otherwise(F.col("chunk")))
    return S.rehash(k, f)


_ASKS = ["acquire", "renew", "acquire", "release", "renew"]


@query(f"""with recursive q as (select user_id % 30 as path, {MS} as ms, event_id, user_id % 4 as device_id, {_ASKS}[(event_id % 5 + 1)::int] as what, row_number() over (partition by user_id % 30 order by {MS}, event_id) as n from events),
r as (select distinct path, 0::bigint as ms, 0::bigint as event_id, 0::bigint as n, false as granted, null::bigint as holder, 0::bigint as token, 0::bigint as until from q
    union all
    select path, ms, event_id, n, fine, case when what = 'acquire' and fine then device_id when what = 'release' and fine then null else holder end, case when what = 'acquire' and fine then token + 1 else token end,
           case when what <> 'release' and fine then ms + 7200000 when what = 'release' and fine then 0 else until end
    from (select q.*, r.holder, r.token, r.until, case when what = 'acquire' then not (r.holder is not null and r.until > q.ms) or r.holder = q.device_id else coalesce(r.holder = q.device_id and r.until > q.ms, false) end as fine from r join q on q.path = r.path and q.n = r.n + 1))
select path, ms, event_id, granted, token, until as expires_at from r where n > 0""")
def lease_log(spark, sf_dir):
    what = F.element_at(F.array(*(F.lit(x) for x in _ASKS)), (F.col("event_id") % 5 + 1).cast("int"))
    q = _events(spark, sf_dir).select((F.col("user_id") % 30).alias("path"), "ms", "event_id", (F.col("user_id") % 4).alias("device_id"), what.alias("what"))
    return A.lease_log(q, 7_200_000)


@query(f"""with recursive b0 as (select distinct user_id % 20 as job, {MS} as ms, event_id % 3 as node from events), b as (select *, row_number() over (partition by job order by ms, node) as n from b0),
r as (select distinct job, 0::bigint as ms, 0::bigint as node, 0::bigint as n, false as leads, null::bigint as holder, 0::bigint as until from b
    union all select job, ms, node, n, fine, case when fine then node else holder end, case when fine then ms + 3600000 else until end
    from (select b.*, r.holder, r.until, coalesce(r.holder = b.node, false) or r.until <= b.ms as fine from r join b on b.job = r.job and b.n = r.n + 1))
select job, ms, node, leads from r where n > 0""")
def leader_lease(spark, sf_dir):
    bids = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("job"), "ms", (F.col("event_id") % 3).alias("node")).distinct()
    return A.leaders(bids, 3_600_000)


@query(f"""with c as (select event_id as id, {MS} as began, {MS} + event_id % 50 * 100000 as ends from events where event_type in ('view', 'click')), e as (select {MS} as moment from events where event_type = 'error' and event_id % 4 = 0)
select id, (select count(*) from e where moment <= began) = (select count(*) from e where moment <= ends) as lands from c""")
def epoch_guard(spark, sf_dir):
    e = _events(spark, sf_dir)
    commits = e.where("event_type in ('view', 'click')").select(F.col("event_id").alias("id"), F.col("ms").alias("began"), (F.col("ms") + F.col("event_id") % 50 * 100_000).alias("ends"))
    return S.guarded(commits, e.where("event_type = 'error' and event_id % 4 = 0").select(F.col("ms").alias("at")))


@query(f"""with t as (select 'k' || user_id % 60 as key, max_by({MS} + event_id % 9 * 1000, ({MS}, event_id % 9 * 1000)) as deadline from events group by 1)
select key, deadline from t where deadline <= (select max({MS}) from events) order by deadline, key limit 20""")
def due_timers(spark, sf_dir):
    e = _events(spark, sf_dir)
    timers = e.select(F.concat(F.lit("k"), (F.col("user_id") % 60).cast("string")).alias("key"), F.col("ms").alias("armed_ms"), (F.col("event_id") % 9 * 1000).alias("wait_ms"))
    return A.due(timers, e.agg(F.max("ms")).first()[0] or 0, 20)


@query(f"""with heads as (select distinct max(o_orderkey) as commit from orders group by o_custkey), tree as (select l_orderkey as commit, l_partkey as manifest from lineitem),
trash as (select p_partkey as manifest from part where p_size = 1), sess as (select user_id as manifest, {MS} as expires_at, event_type = 'purchase' as complete from events),
holds as (select user_id + 100 as manifest from events group by user_id having max_by(event_type, event_id) in ('view', 'click')),
roots as (select manifest from tree join heads using (commit) union select manifest from trash union select manifest from sess where not complete and expires_at > (select max({MS}) from events) - 7 * 86400000::bigint union select manifest from holds)
select distinct l_suppkey * 8 + l_linenumber as chunk from lineitem where l_partkey in (select manifest from roots)""")
def reachability_mark(spark, sf_dir):
    line, e = table(spark, sf_dir, "lineitem"), _events(spark, sf_dir)
    heads = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("commit"))
    tree = line.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("manifest"))
    trash = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("manifest"))
    sessions = e.select(F.col("user_id").alias("manifest"), F.col("ms").alias("expires_at"), (F.col("event_type") == "purchase").alias("complete"))
    op = F.when(F.col("event_type").isin("view", "click"), "upsert").otherwise("delete")
    holds = e.select(F.col("user_id").alias("key"), (F.col("user_id") + 100).alias("manifest"), F.col("event_id").alias("at"), op.alias("op"))
    now = e.agg(F.max("ms")).first()[0] or 0
    entries = line.select(F.col("l_partkey").alias("manifest"), (F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("chunk"))
    return S.mark(heads, tree, trash, sessions, holds, now, entries)


@query("""with s as (select p_partkey, sha256(p_partkey::varchar) as d from part), a as (select distinct unnest([('0x' || substr(d, 1, 8))::bigint % 65536, ('0x' || substr(d, 9, 8))::bigint % 65536, ('0x' || substr(d, 17, 8))::bigint % 65536]) as place from s)
select place // 32 as word, bit_or((1::bigint << (place % 32)::int)) as bits from a group by 1""")
def membership_sketch(spark, sf_dir):
    return S.bloom(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash")), 65_536, 3)


@query("""with c as (select distinct l_partkey as chunk, l_suppkey as peer from lineitem), l as (select l_suppkey as peer, count(*) // 50 as load from lineitem group by 1)
select chunk, arg_min(peer, (load, (peer + chunk) % 97, peer)) as peer from c join l using (peer) group by 1""")
def least_loaded_peer(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    load = line.groupBy(F.col("l_suppkey").alias("peer")).agg(F.floor(F.count("*") / 50).alias("load"))
    return S.peers(line.select(F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("peer")).distinct().join(load, "peer"))


@query("select p_partkey, lower(hex(encode(p_name))) as hexed, p_name as unhexed, base64(encode(p_name)) as b64, p_name as unb64, substr(sha256(p_name), 1, 2) as shard from part")
def encodings(spark, sf_dir):
    data = F.encode("p_name", "UTF-8")
    text = lambda c: F.decode(c, "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", C.hex_text(data).alias("hexed"), text(F.unhex(C.hex_text(data))).alias("unhexed"), F.base64(data).alias("b64"), text(F.unbase64(F.base64(data))).alias("unb64"), C.shard(F.sha2("p_name", 256)).alias("shard"))


@query("""with n as (select p_partkey, case when p_partkey % 3 = 0 then p_name else p_brand || '#' || p_name || case when p_partkey % 2 = 0 then '#x' else '' end end as full_name from part)
select p_partkey, full_name, case when contains(full_name, '#') then substr(full_name, 1, instr(full_name, '#') - 1) end as owner, case when contains(full_name, '#') then substr(full_name, instr(full_name, '#') + 1) else full_name end as name from n""")
def namespaces(spark, sf_dir):
    full = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(C.namespace("p_brand", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "#x").otherwise(""))))
    owner, name = C.split_namespace("full_name")
    return table(spark, sf_dir, "part").select("p_partkey", full.alias("full_name")).select("p_partkey", "full_name", owner.alias("owner"), name.alias("name"))


@query("""with r as (select o_orderkey, (o_orderkey - 3000)::bigint as num, (o_custkey % 90 + 1)::bigint as den, [24, 25, 30, 60][(o_orderkey % 4 + 1)::int]::bigint as rate from orders)
select o_orderkey, floor(num * rate / den)::bigint as frame, ((num + den) // gcd(abs(num + den), rate)) || '/' || (rate // gcd(abs(num + den), rate)) as ends_at from r""")
def seconds_frames(spark, sf_dir):
    k = F.col("o_orderkey")
    rate = F.element_at(F.array(*(F.lit(x) for x in (24, 25, 30, 60))), (k % 4 + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", (k - 3000).alias("num"), (F.col("o_custkey") % 90 + 1).alias("den"), rate.cast("long").alias("rate"))
    num, den, rate = F.col("num"), F.col("den"), F.col("rate")
    return r.select("o_orderkey", C.to_frames(num, den, rate).alias("frame"), C.range_end(num, den, rate).alias("ends_at"))


@query(f"""with {ENTRIES} select manifest, idx, 'clip' || chunk % 40 || '|' || case when chunk % 3 = 0 then '' else 'm' || chunk end || '|' || "offset" || '|' || len as fingerprint from entries""")
def clip_fingerprints(spark, sf_dir):
    e = manifest_entries(spark, sf_dir)
    media = F.when(F.col("chunk") % 3 != 0, F.concat(F.lit("m"), F.col("chunk").cast("string")))
    return e.select("manifest", "idx", C.fingerprint(F.concat(F.lit("clip"), (F.col("chunk") % 40).cast("string")), media, "offset", "len").alias("fingerprint"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 0 else o_orderkey * 10 end > 0 and 30000 >= case when o_orderkey % 4 = 0 then 0 else o_orderkey * 10 end as expired from orders")
def link_expiry(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(F.col("o_orderkey") * 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.link_expired(end, 30_000).alias("expired"))


@query(f"select event_id, substr(sha256({MS} || chr(10) || user_id || chr(10) || event_type || chr(10) || (value > 50)::varchar), 1, 16) as audit_id from events")
def audit_ids(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", C.audit_id("ms", "user_id", "event_type", F.col("value") > 50).alias("audit_id"))


@query("""with p as (select p_partkey, [p_name || '.otio', 'x/' || p_name || '.FCPXML', 'y.prodsys/' || p_name, 'y' || chr(92) || 'z.prodsys' || chr(92) || p_name || '.otio', p_name || '.otio.bak', 'a.prodsysx/b'][(p_partkey % 6 + 1)::int] as path from part)
select p_partkey, regexp_matches(lower(path), '[.](otio|fcpxml)$') as is_timeline, len(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda c: ends_with(c, '.prodsys'))) > 0 as native_collab from p""")
def path_kinds(spark, sf_dir):
    n = F.col("p_name")
    kinds = [F.concat(n, F.lit(".otio")), F.concat(F.lit("x/"), n, F.lit(".FCPXML")), F.concat(F.lit("y.prodsys/"), n), F.concat(F.lit("y\\z.prodsys\\"), n, F.lit(".otio")), F.concat(n, F.lit(".otio.bak")), F.lit("a.prodsysx/b")]
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int")).alias("path"))
    return p.select("p_partkey", C.is_timeline("path").alias("is_timeline"), C.native_collab("path").alias("native_collab"))


@query("""with t as (select o_orderkey, o_custkey / 8.0 as x, [o_orderpriority, 'a,b', 'say "hi"', 'two' || chr(10) || 'lines'][(o_orderkey % 4 + 1)::int] as body from orders)
select o_orderkey, printf('%.3f', x::double) as pin, case when contains(body, ',') or contains(body, '"') or contains(body, chr(10)) then '"' || replace(body, '"', '""') || '"' else body end as field from t""")
def csv_fields(spark, sf_dir):
    body = F.element_at(F.array(F.col("o_orderpriority"), F.lit("a,b"), F.lit('say "hi"'), F.lit("two\nlines")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.pin_text(F.col("o_custkey") / 8.0).alias("pin"), C.csv_field(body).alias("field"))


@query("""with e as (select l_suppkey as manifest, sha256((l_partkey * 10 + l_linenumber)::varchar) as hash, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as idx from lineitem)
select manifest, idx * 1000 as "offset", 1000::bigint as len, hash from e""")
def manifest_objects(spark, sf_dir):
    from tesserae.sources import objects as O

    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").withColumn("idx", (F.row_number().over(by) - 1).cast("long"))
    digest = F.sha2((F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string"), 256)
    entries = line.select(F.col("l_suppkey").alias("manifest"), "idx", (F.col("idx") * 1000).alias("offset"), F.lit(1000).cast("long").alias("len"), digest.alias("hash"))
    built = O.manifests(entries, fan=256)
    top = built.groupBy("manifest").agg(F.max_by("hash", "level").alias("root"))
    return O.flattened(top, built.select("hash", "content")).select("manifest", "offset", "len", "hash")


@query("""with p as (select doc_id, i, encode(coalesce(text, ''))[i * 997 + 1 : (i + 1) * 997] as piece from documents, range(0, 100000) r(i) where i * 997 < greatest(1, strlen(coalesce(text, '')))),
q as (select *, sha256(piece) as hash from p)
select doc_id, sha256(unhex(coalesce(string_agg(case when hash not like '00%' then hex(piece) end, '' order by i), ''))) as content_hash, bool_and(hash not like '00%') as valid from q group by 1""")
def assembled_files(spark, sf_dir):
    """Documents from pieces of 997 bytes, which end inside characters; the store has lost those whose digest begins with two zeros."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    last = F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / 997)
    piece = lambda i: F.struct(i.alias("idx"), F.substring(F.col("data"), (i * 997 + 1).cast("int"), F.lit(997)).alias("piece"))
    pieces = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), piece)).alias("p")).select("doc_id", "p.idx", F.col("p.piece").alias("data"), F.sha2("p.piece", 256).alias("hash"))
    pieces = saved(pieces)
    out = V.assembled(pieces.select(F.col("doc_id").alias("file"), "idx", "hash"), pieces.where("hash not like '00%'").select("hash", "data").dropDuplicates(["hash"]))
    return out.select(F.col("file").alias("doc_id"), F.sha2("content", 256).alias("content_hash"), "valid")


@query(f"""with {FILES}, p as (select path, case when doc_id % 5 = 0 then size + 1 else size end as size, case when doc_id % 7 = 0 then mtime - 1 else mtime end as mtime, doc_id % 11 = 0 as failed from files where doc_id % 3 <> 0)
select f.path, case when p.path is null then 'none' when failed then 'failed' when p.size = f.size and p.mtime = f.mtime then 'ready' else 'stale' end as status from files f left join p using (path)""")
def proxy_states(spark, sf_dir):
    f = files(spark, sf_dir)
    k = F.col("doc_id")
    p = f.where("doc_id % 3 <> 0").select("path", (F.col("size") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime") - F.when(k % 7 == 0, 1).otherwise(0)).alias("mtime"), (k % 11 == 0).alias("failed"), F.lit(2).alias("at"))
    old = p.withColumns({"failed": ~F.col("failed"), "at": F.lit(1)})
    return V.proxy_status(f.select("path", "size", "mtime"), p.unionByName(old))


@query("select doc_id, sha256(text) as plain, sha256(text) as with_words from documents")
def zstd_round_trip(spark, sf_dir):
    words = " ".join(["the", "of", "and", "in", "to", "is", "a"] * 40).encode()
    data = F.col("text").cast("binary")
    both = table(spark, sf_dir, "documents").select("doc_id", X.zstd(data).alias("a"), X.zstd(data, words=words).alias("b"))
    return both.select("doc_id", F.sha2(X.unzstd("a"), 256).alias("plain"), F.sha2(X.unzstd("b", words=words), 256).alias("with_words"))


_ITEMS = """items as (select l_orderkey as doc, l_linenumber % 3 as track, case when l_linenumber % 3 = 2 then 'Audio' else 'Video' end as track_kind, ['clip', 'clip', 'gap', 'transition'][(l_partkey % 4 + 1)::int] as kind, l_suppkey % 3 as effects, l_suppkey % 5 as params, l_partkey % 2 as markers,
    case when l_partkey % 6 = 0 then l_suppkey end as link, l_partkey from lineitem), lost as (select doc, track, track_kind, kind, case when l_partkey % 10 = 0 then 0 else effects end as effects, params, case when l_partkey % 15 = 0 then markers + 1 else markers end as markers, case when l_partkey % 12 = 0 then null else link end as link from items where l_partkey % 8 <> 3)"""
_KEPT = {"clips": "kind = 'clip'", "gaps": "kind = 'gap'", "transitions": "kind = 'transition'", "audio": "kind = 'clip' and track_kind = 'Audio'", "linked": "link is not null"}
_NAMES = [*_KEPT, "effects", "params", "markers", "video_tracks", "audio_tracks"]


def _audit_sql(name: str, rows: str) -> str:
    counts = ", ".join(f"count_if({c})::bigint as {name}_{n}" for n, c in _KEPT.items())
    sums = ", ".join(f"sum({c})::bigint as {name}_{c}" for c in ("effects", "params", "markers"))
    kinds = ", ".join(f"count(distinct case when track_kind = '{k}' then track end) as {name}_{k.lower()}_tracks" for k in ("Video", "Audio"))
    return f"{name} as (select doc, {counts}, {sums}, {kinds} from {rows} group by 1)"


@query(f"""with {_ITEMS}, {_audit_sql('before', 'items')}, {_audit_sql('after', 'lost')}
select b.doc, {', '.join(f'b.before_{n}, coalesce(a.after_{n}, 0) as after_{n}' for n in _NAMES)}, concat_ws(',', {', '.join(f"case when b.before_{n} <> coalesce(a.after_{n}, 0) then '{n}' end" for n in _NAMES)}) as differs from before b left join after a using (doc)""")
def roundtrip_audit(spark, sf_dir):
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    kind = F.element_at(F.array(F.lit("clip"), F.lit("clip"), F.lit("gap"), F.lit("transition")), (p % 4 + 1).cast("int"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (n % 3).alias("track"), F.when(n % 3 == 2, "Audio").otherwise("Video").alias("track_kind"), kind.alias("kind"), (s % 3).alias("effects"), (s % 5).alias("params"), (p % 2).alias("markers"), F.when(p % 6 == 0, s).alias("link"), p.alias("p"))
    at = lambda k: F.col("p") % k == 0
    lost = items.where("p % 8 <> 3").withColumns({"effects": F.when(at(10), 0).otherwise(F.col("effects")), "markers": F.col("markers") + F.when(at(15), 1).otherwise(0), "link": F.when(~at(12), F.col("link"))})
    return T.audit(items, lost)
