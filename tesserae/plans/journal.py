"""Queries over events read as a journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import journal as J
from tesserae.operators import records as R
from tesserae.plans.derived import JOURNAL, journal
from tesserae.plans.registry import query, table

_EFFECTS = """
effects as (
    select project_id, seq, 0 as part, path, case when kind = 'file_upsert' then 'present' else 'tombstone' end as state,
           case when kind = 'file_upsert' then manifest end as manifest, case when kind = 'file_upsert' then size end as size
    from journal where kind in ('file_upsert', 'file_delete', 'rename')
    union all
    select project_id, seq, 1, new_path, 'present', manifest, 0 from journal where kind = 'rename'
), folded as (
    select project_id, path, state, manifest, size, seq from effects qualify row_number() over (partition by project_id, path order by seq desc, part desc) = 1
)
"""


@query(f"with {JOURNAL}, {_EFFECTS} select * from folded")
def journal_fold(spark, sf_dir):
    return J.fold(journal(spark, sf_dir))


@query(f"with {JOURNAL}, {_EFFECTS} select project_id, path, manifest, size, snapshot_seq from folded join (select project_id, max(seq) as snapshot_seq from journal group by 1) using (project_id) where state = 'present'")
def snapshot_tree(spark, sf_dir):
    return J.snapshot(journal(spark, sf_dir))


@query(f"with {JOURNAL} select project_id, seq, path, kind from journal where seq > 100 qualify row_number() over (partition by project_id order by seq) <= 50")
def journal_batch(spark, sf_dir):
    return J.batch(journal(spark, sf_dir), after=100, limit=50).select("project_id", "seq", "path", "kind")


@query(f"with {JOURNAL} select project_id, seq, request_id, min(seq) over (partition by project_id, request_id) as answer_seq, seq <> min(seq) over (partition by project_id, request_id) as deduplicated from journal")
def append_dedup(spark, sf_dir):
    return J.deduplicate(journal(spark, sf_dir)).select("project_id", "seq", "request_id", "answer_seq", "deduplicated")


@query(f"""with {JOURNAL}, w as (select project_id, path, seq, device_id, base_seq from journal where kind <> 'state_record')
select a.project_id, a.path, a.seq, exists (select 1 from w b where b.project_id = a.project_id and b.path = a.path and b.seq < a.seq and b.seq > a.base_seq and b.device_id <> a.device_id) as conflict,
       (select max(seq) from w b where b.project_id = a.project_id and b.path = a.path and b.seq < a.seq) as head_seq from w a""")
def conflict_rule(spark, sf_dir):
    return J.conflicts(journal(spark, sf_dir)).select("project_id", "path", "seq", "conflict", "head_seq")


@query(f"""with recursive {JOURNAL}, t as (select project_id, path, seq, device_id, base_seq, row_number() over (partition by project_id, path order by seq) as n from journal where kind <> 'state_record'),
r as (select distinct project_id, path, 0::bigint as seq, 0::bigint as n, true as accepted, 0::bigint as last, -1::bigint as device, 0::bigint as other from t
      union all
      select t.project_id, t.path, t.seq, t.n, a, case when a then t.seq else last end, case when a then t.device_id else device end, case when a and t.device_id <> device then last else other end
      from (select t.*, r.last, r.device, r.other, case when t.device_id = r.device then r.other else r.last end <= t.base_seq as a from r join t on t.project_id = r.project_id and t.path = r.path and t.n = r.n + 1) t)
select project_id, path, seq, accepted from r where n > 0""")
def conflict_online(spark, sf_dir):
    return J.online_accept(journal(spark, sf_dir))


@query(f"""with {JOURNAL}, leases as (
    select project_id, path, device_id as holder, seq % 5 as lease_token, server_ms + 3600000 as expires_at from journal where kind = 'file_upsert'
    qualify row_number() over (partition by project_id, path order by seq) = 1)
select j.project_id, j.seq, j.path, coalesce(expires_at > server_ms and (holder <> device_id or lease_token <> seq % 5), false) as fenced
from journal j left join leases using (project_id, path) where kind in ('file_upsert', 'rename')""")
def fencing_check(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("token", F.col("seq") % 5)
    first = F.min_by(F.struct(F.col("device_id").alias("holder"), F.col("token").alias("lease_token"), (F.col("server_ms") + 3_600_000).alias("expires_at")), "seq").alias("l")
    leases = j.where("kind = 'file_upsert'").groupBy("project_id", "path").agg(first).select("project_id", "path", "l.*")
    return J.fencing(j, leases).select("project_id", "seq", "path", "fenced")


@query(f"""with {JOURNAL}, f as (select project_id, max(seq) // 2 as fold_seq from journal group by 1)
select project_id, seq, path, kind from journal join f using (project_id) where not (seq <= fold_seq and server_ms < (select max(server_ms) from journal) - 86400000 and path not like 'state/%')""")
def journal_compact(spark, sf_dir):
    j = journal(spark, sf_dir)
    folds = j.groupBy("project_id").agg(F.floor(F.max("seq") / 2).alias("fold_seq"))
    now = j.agg(F.max("server_ms")).first()[0]
    return J.compact(j, folds, now - 86_400_000).select("project_id", "seq", "path", "kind")


def _records(spark, sf_dir):
    e = journal(spark, sf_dir)
    return e.select("family", (F.col("device_id") % 20).alias("key"), F.floor(F.col("server_ms") / 3_600_000).alias("ts_ms"), (F.col("device_id") % 3).alias("device_id"), F.col("props").alias("payload"), (F.col("value") < 5).alias("tombstone"), F.col("event_id").alias("seq"))


_RECORDS = f"{JOURNAL}, records as (select family, device_id % 20 as key, server_ms // 3600000 as ts_ms, device_id % 3 as device_id, props as payload, value < 5 as tombstone, event_id as seq from journal)"


@query(f"with {_RECORDS} select family, key, ts_ms, device_id, payload, tombstone from records qualify row_number() over (partition by family, key order by ts_ms desc, device_id desc, tombstone desc, seq) = 1")
def lww_registers(spark, sf_dir):
    return R.lww(_records(spark, sf_dir))


@query(f"""with {_RECORDS}, w as (select *, substr(sha256(concat_ws('|', family, key::varchar, payload)), 1, 32) as record_id from records)
select record_id, family, key, payload, ts_ms, device_id from w qualify row_number() over (partition by record_id order by seq) = 1""")
def union_records(spark, sf_dir):
    return R.union(_records(spark, sf_dir))


@query(f"with {_RECORDS}, w as (select family, key, tombstone from records qualify row_number() over (partition by family, key order by ts_ms desc, device_id desc, tombstone desc, seq) = 1) select family, key from w where tombstone")
def revoked_links(spark, sf_dir):
    return R.revoked(_records(spark, sf_dir))


_LOCAL = """local as (select project_id, path, manifest, size, server_ms as mtime, ['synced', 'dirty', 'clean', 'conflict'][(seq % 4 + 1)::int] as local_state
    from journal where seq <= 300 and kind = 'file_upsert' qualify row_number() over (partition by project_id, path order by seq desc) = 1)"""


@query(f"""with {JOURNAL}, late as (select * from journal where seq > 300), {_EFFECTS.replace('from journal', 'from late')}, {_LOCAL},
e as (select f.*, kind, server_ms from folded f join late l using (project_id, seq)),
j as (select e.project_id, e.path, e.state, e.manifest, e.size, e.server_ms, l.size as l_size, l.mtime as l_mtime, l.local_state as l_state,
             e.state = 'present' and e.kind = 'file_upsert' as up,
             coalesce(l.local_state in ('dirty', 'conflict') or l.manifest = e.manifest, false) and e.state = 'present' and e.kind = 'file_upsert' as keep
      from e left join local l on e.project_id = l.project_id and e.path = l.path)
select project_id, path, case when state = 'present' then manifest end as manifest, (case when keep then l_size when up then size else 0 end)::bigint as size,
       case when state = 'present' then 'file' else 'tombstone' end as mode, case when keep then l_mtime else server_ms end as mtime,
       case when keep then l_state when up then 'placeholder' when state = 'present' then 'clean' else 'synced' end as local_state from j""")
def apply_replay(spark, sf_dir):
    j = journal(spark, sf_dir)
    states = F.element_at(F.array(*(F.lit(s) for s in ("synced", "dirty", "clean", "conflict"))), (F.col("seq") % 4 + 1).cast("int"))
    own = F.max_by(F.struct("manifest", "size", F.col("server_ms").alias("mtime"), states.alias("local_state")), "seq").alias("r")
    local = j.where("seq <= 300 and kind = 'file_upsert'").groupBy("project_id", "path").agg(own).select("project_id", "path", "r.*")
    return J.apply_replay(j.where("seq > 300"), local)


@query(f"with {JOURNAL} select project_id, path, least(500, min(seq) - 1) as base from journal where device_id % 3 <> 0 and kind = 'file_upsert' group by 1, 2")
def fork_base(spark, sf_dir):
    return J.fork_base(journal(spark, sf_dir), me_mod=3, cursor=500)


@query(f"""with {JOURNAL}, u as (select * from journal where kind = 'file_upsert'),
j as (select a.project_id, a.path, a.seq, max(case when b.seq = a.base_seq then b.manifest end) as base_manifest,
             max_by(b.manifest, b.seq) filter (b.seq > a.base_seq and b.device_id <> a.device_id) as theirs_manifest
      from u a join u b on a.project_id = b.project_id and a.path = b.path and b.seq >= a.base_seq and b.seq < a.seq group by 1, 2, 3)
select * from j where base_manifest is not null or theirs_manifest is not null""")
def merge_base_lookup(spark, sf_dir):
    return J.merge_base(journal(spark, sf_dir))


@query(f"""with recursive {JOURNAL}, t as (select project_id as ref, row_number() over (partition by project_id order by seq) as attempt, (seq // 3)::bigint as expected from journal),
r as (select ref, 0::bigint as attempt, 0::bigint as expected, false as accepted, 0::bigint as version from (select distinct ref from t)
      union all
      select t.ref, t.attempt, t.expected, t.expected = r.version, case when t.expected = r.version then r.version + 1 else r.version end from r join t on t.ref = r.ref and t.attempt = r.attempt + 1)
select ref, attempt, expected, accepted, version from r where attempt > 0""")
def ref_cas(spark, sf_dir):
    j = journal(spark, sf_dir)
    return J.ref_swaps(j.select(F.col("project_id").alias("ref"), F.col("seq").alias("attempt"), F.floor(F.col("seq") / 3).alias("expected")))


@query(f"with {JOURNAL} select project_id, seq, 'req-' || sha256(project_id || chr(10) || device_id || chr(10) || path || chr(10) || kind || chr(10) || manifest) as content_request_id from journal")
def request_ids(spark, sf_dir):
    from tesserae.functions.scalar import request_id

    return journal(spark, sf_dir).select("project_id", "seq", request_id("project_id", "device_id", "path", "kind", "manifest").alias("content_request_id"))


@query("""with recursive h as (select o_orderkey as ref, o_orderkey as commit, 0 as depth from orders
    union all select ref, commit // 2, depth + 1 from h where commit // 2 >= 1 and depth < 511)
select ref, commit, depth from h where commit in (select o_orderkey from orders)""")
def snapshot_history(spark, sf_dir):
    from tesserae.operators.graph import ancestors

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"))
    # every commit's parent is half its number, so all parents are known commits or end the walk
    parents = o.sparkSession.range(1, (o.agg(F.max("commit")).first()[0] or 1) + 1).select(F.col("id").alias("commit"), F.when(F.floor(F.col("id") / 2) >= 1, F.floor(F.col("id") / 2)).alias("parent"))
    return ancestors(o.select(F.col("commit").alias("ref"), "commit"), parents, most=512).join(o, "commit", "left_semi").select("ref", "commit", "depth")


@query("""select o_orderkey as commit, l_linenumber::bigint as path, min(l_partkey) as manifest, (min(l_partkey) % 1000 + 1)::bigint as bytes, true as dirty
from orders join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def restore_plan(spark, sf_dir):
    from tesserae.plans.derived import manifest_entries

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"))
    tree = manifest_entries(spark, sf_dir).select(F.col("manifest").alias("commit"), F.col("idx").alias("path"), F.col("chunk").alias("manifest"), F.col("len").alias("bytes"))
    return tree.join(o, "commit", "left_semi").withColumn("dirty", F.lit(True))
