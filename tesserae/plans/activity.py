"""Queries over events read as activity, samples, leases and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalar as C
from tesserae.operators import activity as A
from tesserae.operators import search as Q
from tesserae.operators import store as S
from tesserae.plans.derived import FILES, files, millis
from tesserae.plans.registry import query, table

MS = "epoch_us(ts) // 1000"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ms", F.expr(millis("ts")))


@query(f"select ((floor(({MS} - 120 * 60000) / 86400000.0) * 86400000)::bigint + 120 * 60000)::bigint as day_start_ms, sum(event_id % 1000)::bigint as bytes, count(*) as files from events where {MS} >= (select max({MS}) from events) - 20 * 86400000::bigint group by 1")
def daily_activity(spark, sf_dir):
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ms")).first()[0] or 0
    return S.daily_activity(e.select(F.col("ms").alias("mtime"), (F.col("event_id") % 1000).alias("size")), now - 20 * S.DAY_MS, 120)


@query(f"with {FILES} select project_id, path, mtime from files order by mtime desc, path limit 25")
def recent_files(spark, sf_dir):
    return A.newest(files(spark, sf_dir).select("project_id", "path", "mtime"), [F.desc("mtime"), F.asc("path")], 25)


@query(f"""with a as (select 'file' as kind, {MS} as ts, event_id as ref from events where event_type in ('view', 'click') order by ts desc, ref limit 10),
b as (select 'pin' as kind, {MS} as ts, event_id as ref from events where event_type = 'purchase' order by ts desc, ref limit 6),
c as (select 'lease' as kind, {MS} as ts, event_id as ref from events where event_type = 'signup' order by ts desc, ref limit 12)
select * from (select * from a union all select * from b union all select * from c) order by ts desc, kind, ref limit 12""")
def activity_feed(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("ms").alias("ts"), F.col("event_id").alias("ref"), "event_type")
    pick = lambda *t: e.where(F.col("event_type").isin(*t))
    return A.feed([("file", pick("view", "click"), 10), ("pin", pick("purchase"), 6), ("lease", pick("signup"), 12)], 12)


@query(f"""with e as (select user_id % 40 as path, {MS} as ms, event_id from events), g as (select *, case when ms - lag(ms) over w <= 600000 then 0 else 1 end as fresh from e window w as (partition by path order by ms, event_id)),
b as (select *, sum(fresh) over (partition by path order by ms, event_id) as burst from g) select path, max(ms) + 600000 as settled_ms, count(*) as events from b group by path, burst""")
def debounce_sessions(spark, sf_dir):
    return A.debounce(_events(spark, sf_dir).select((F.col("user_id") % 40).alias("path"), "ms", "event_id"), 600_000)


@query(f"with l as (select user_id, {MS} as ms, event_type from events qualify row_number() over (partition by user_id order by {MS} desc, event_id desc) = 1) select * from l where (select max({MS}) from events) - ms <= 86400000")
def presence_latest(spark, sf_dir):
    e = _events(spark, sf_dir)
    return A.presence(e, e.agg(F.max("ms")).first()[0] or 0, 86_400_000)


@query("with s as (select event_id as frame, value as v from events where event_id % 100 < 90 or event_id // 100 % 2 = 0), b as (select frame // 10 as bin, min(v) as lo, max(v) as hi from s group by 1) select r.bin, coalesce(lo, 0) as lo, coalesce(hi, 0) as hi from (select unnest(range((select max(event_id) // 10 + 1 from events))) as bin) r left join b using (bin)")
def waveform_peaks(spark, sf_dir):
    e = _events(spark, sf_dir)
    bins = (e.agg(F.max("event_id")).first()[0] or 0) // 10 + 1
    s = e.where("event_id % 100 < 90 or cast(floor(event_id / 100) as long) % 2 = 0").select(F.col("event_id").alias("frame"), F.col("value").alias("v"))
    return A.peaks(s, 10, bins)


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events),
p as (select unnest([0.5, 0.95, 0.99]::double[]) as p) select event_type, p, min(value) as value from r, p where i = floor((n - 1) * p + 0.5) group by 1, 2""")
def latency_percentiles(spark, sf_dir):
    return A.nearest_rank(_events(spark, sf_dir), "event_type", "value", [0.5, 0.95, 0.99])


@query("""with b as (select event_type, value, list_position(list_transform([0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0], lambda x: value <= x), true) as pos from events),
c as (select event_type, coalesce(nullif(pos, 0) - 1, 14) as i, count(*) as c from b group by 1, 2),
w as (select *, sum(c) over (partition by event_type order by i) as cum, sum(c) over (partition by event_type) as n from c),
f as (select event_type, min(i) as i from w where cum >= ceil(n * 0.9::double) group by 1)
select event_type, (case when i = 0 then 0.05 when i < 14 then [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0][i::int] / 2.0 + [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0][i::int + 1] / 2.0 else 5000.0 end)::double as estimate from f""")
def histogram_percentile(spark, sf_dir):
    return A.histogram_percentile(_events(spark, sf_dir), "event_type", "value", 0.9)


_LIMIT = """t as (select user_id, event_id, {ms} as ms, row_number() over (partition by user_id order by {ms}, event_id) as n from events),
r as (select distinct user_id, 0::bigint as event_id, 0::bigint as n, false as allowed, null::bigint as start, 0 as used from t
      union all
      select user_id, event_id, n, used < {budget}, start, used + (used < {budget})::int
      from (select t.user_id, t.event_id, t.n, case when r.start is null or t.ms - r.start >= {window} then t.ms else r.start end as start, case when r.start is null or t.ms - r.start >= {window} then 0 else r.used end as used
            from r join t on t.user_id = r.user_id and t.n = r.n + 1))"""


@query(f"with recursive {_LIMIT.format(ms=MS, budget=3, window=3_600_000)} select user_id, event_id, allowed from r where n > 0")
def rate_limit(spark, sf_dir):
    return A.rate_limit(_events(spark, sf_dir), budget=3, window_ms=3_600_000)


@query(f"with recursive {_LIMIT.format(ms=MS, budget=1, window=60_000)} select user_id, event_id, allowed as touched from r where n > 0")
def touch_debounce(spark, sf_dir):
    return A.touches(_events(spark, sf_dir), 60_000)


@query("select event_id, coalesce(json_extract(props, '$.k')::bigint, -1) as k, coalesce(json_extract_string(props, '$.absent'), 'none') as absent from events")
def json_payload(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(v, "$.absent", "string"), F.lit("none")).alias("absent"))


_ROLES = ["owner", "lead-editor", "editor", "assistant", "colorist", "sound-designer", "reviewer", "unknown"]
_PERMISSIONS = [
    "read", "write-files", "organize-bins", "lock-file", "lock-timeline", "edit-timeline", "color-grade", "mix-audio", "comment", "manage-review", "manage-members", "manage-flags", "attach-root", "detach-root", "verify", "snapshot",
    "restore", "view-presence",
]


@query(f"""with e as (select event_id, {_ROLES}[(user_id % 8 + 1)::int] as role, {_PERMISSIONS}[(event_id % 18 + 1)::int] as permission from events),
k as (select *, case role when 'unknown' then 'editor' else role end as r from e)
select event_id, role, permission, case
    when permission in ('read', 'comment', 'view-presence') then true when permission in ('manage-members', 'restore') then r = 'owner' when permission in ('lock-timeline', 'manage-flags') then r in ('owner', 'lead-editor')
    when permission in ('write-files', 'attach-root', 'verify') then r <> 'reviewer' when permission = 'organize-bins' then r in ('owner', 'lead-editor', 'editor', 'assistant') when permission = 'lock-file' then r not in ('assistant', 'reviewer')
    when permission in ('edit-timeline', 'manage-review', 'detach-root') then r in ('owner', 'lead-editor', 'editor') when permission = 'snapshot' then r in ('owner', 'lead-editor', 'editor', 'assistant')
    when permission = 'color-grade' then r in ('owner', 'lead-editor', 'colorist') when permission = 'mix-audio' then r in ('owner', 'lead-editor', 'sound-designer') end as allowed from k""")
def rbac_decisions(spark, sf_dir):
    """All permissions against all roles, one of them unknown."""
    pick = lambda words, n: F.element_at(F.array(*(F.lit(x) for x in words)), (n + 1).cast("int"))
    return C.decide(table(spark, sf_dir, "events").select("event_id", pick(_ROLES, F.col("user_id") % 8).alias("role"), pick(_PERMISSIONS, F.col("event_id") % 18).alias("permission")))


@query(f"select {MS} as ts_ms, user_id as device, substr(sha256(event_id || '|' || user_id || '|' || event_type), 1, 16) as id, value >= 5 as allowed from events order by ts_ms desc, id desc limit 500")
def audit_newest(spark, sf_dir):
    id_ = F.substring(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type"), 256), 1, 16)
    return A.newest(_events(spark, sf_dir).select(F.col("ms").alias("ts_ms"), F.col("user_id").alias("device"), id_.alias("id"), (F.col("value") >= 5).alias("allowed")), [F.desc("ts_ms"), F.desc("id")], 500)


_LEASES = f"leases as (select 'f' || event_id % 97 as path, user_id as device_id, event_id, row_number() over (partition by event_id % 97 order by {MS}, event_id) as token, {MS} + 3600000 as expires_at from events where event_type = 'purchase')"


def _leases(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    return A.leases(e.select(F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("path"), F.col("user_id").alias("device_id"), "ms", "event_id"), 3_600_000)


@query(f"with {_LEASES} select path, device_id, token, expires_at from leases")
def lease_tokens(spark, sf_dir):
    return _leases(spark, sf_dir).select("path", "device_id", "token", "expires_at")


@query(f"with {_LEASES}, l as (select * from leases qualify row_number() over (partition by path order by token desc) = 1) select path, device_id, token, expires_at from l where expires_at > (select max({MS}) from events) - 50 * 3600000::bigint")
def active_leases(spark, sf_dir):
    now = _events(spark, sf_dir).agg(F.max("ms")).first()[0] or 0
    return A.active(_leases(spark, sf_dir), now - 50 * 3_600_000)


@query("""with c as (select user_id as review, count(*) as comments from events where event_type = 'click' group by 1),
l as (select user_id as review, event_id, event_id % 3 = 0 as expired from events where event_type = 'purchase'), t as (select event_id + 1 as event_id from events where event_type = 'error')
select l.review, coalesce(max(comments), 0) as comments, count_if(not expired and t.event_id is null) as live, count_if(expired) as expired, count_if(t.event_id is not null) as revoked
from l left join t using (event_id) left join c using (review) group by 1""")
def review_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    comments = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("review")).agg(F.count("*").alias("comments"))
    links = e.where("event_type = 'purchase'").select(F.col("user_id").alias("review"), "event_id", (F.col("event_id") % 3 == 0).alias("expired"))
    gone = e.where("event_type = 'error'").select((F.col("event_id") + 1).alias("event_id"), F.lit(True).alias("gone"))
    by = links.join(gone, "event_id", "left").groupBy("review").agg(F.count_if(~F.col("expired") & F.col("gone").isNull()).alias("live"), F.count_if("expired").alias("expired"), F.count_if("gone").alias("revoked"))
    return by.join(comments, "review", "left").na.fill(0, ["comments"])


@query("""with s as (select user_id as root, event_id as seen_at, case when event_type = 'error' then 'error' when value < 3 then 'unreachable' when event_type in ('click', 'purchase') then 'transferring' else 'idle' end as state from events),
w as (select *, lag(state) over (partition by root order by seen_at) as before from s) select root, seen_at, state from w where before is null or before <> state""")
def change_only(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 3, "unreachable").when(F.col("event_type").isin("click", "purchase"), "transferring").otherwise("idle")
    return A.changes_only(table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("event_id").alias("seen_at"), state.alias("state")))


@query("""with d as (select * from (values ('merge', 'true'), ('search', 'FALSE'), ('audit', '')) t(flag, fallback)), s as (select n_nationkey as tenant, case when n_nationkey % 2 = 0 then 'false' else 'beta' end as value from nation where n_nationkey % 3 = 0)
select n_nationkey as tenant, flag, coalesce(case when flag = 'merge' then value end, fallback) as value, lower(coalesce(case when flag = 'merge' then value end, fallback)) <> 'false' as enabled from nation cross join d left join s on s.tenant = n_nationkey""")
def flags_defaults(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant"))
    stored = n.where("tenant % 3 = 0").select("tenant", F.lit("merge").alias("flag"), F.when(F.col("tenant") % 2 == 0, "false").otherwise("beta").alias("value"))
    return C.flags(n, stored, {"merge": "true", "search": "FALSE", "audit": ""})


@query(f"with {FILES} select path, case when local_state = 'conflict' then 'conflict' when local_state = 'synced' then 'synced' else 'syncing' end as badge from files")
def file_badge(spark, sf_dir):
    return files(spark, sf_dir).select("path", C.badge("local_state").alias("badge"))


@query(f"with {FILES} select path, case local_state when 'placeholder' then 'fetching' when 'clean' then 'synced' else local_state end as overlay from files where local_state in ('conflict', 'placeholder', 'clean', 'synced', 'pinned')")
def overlay_states(spark, sf_dir):
    return files(spark, sf_dir).select("path", C.overlay("local_state").alias("overlay")).where("overlay is not null")


_LINE = "('0x' || substr(sha256(path || '|' || {state} || '|3'), 1, 15))::bigint::hugeint"


@query(f"""with {FILES}, d as (select project_id, sum({_LINE.format(state='local_state')})::varchar as digest, count_if(local_state in ('conflict', 'placeholder', 'synced', 'clean', 'pinned')) as entries,
    sum(case when doc_id % 40 = 1 then {_LINE.format(state="'old'")} else {_LINE.format(state='local_state')} end)::varchar as was, max(doc_id) as last from files group by 1)
select project_id, digest, entries, not (digest = was and (last * 997 % 90000) > 30000) as write from d""")
def overlay_writes(spark, sf_dir):
    """Which projects write their icons again, a minute and a half after the start, against what each looked like at some time since."""
    f = files(spark, sf_dir)
    at = f.groupBy("project_id").agg((F.max("doc_id") * 997 % 90_000).alias("at_ms"))
    old = Q.overlays(f.withColumn("local_state", F.when(F.col("doc_id") % 40 == 1, "old").otherwise(F.col("local_state"))), spark.createDataFrame([], "project_id string, digest string, at_ms long"), 3, 0)
    return Q.overlays(f, old.select("project_id", "digest").join(at, "project_id"), 3, 90_000)



@query(f"""with {FILES}, pins as (select path from files where doc_id % 4 = 0), offers as (select path from files where doc_id % 10 = 1),
proxies as (select path, case when doc_id % 3 = 0 then size else size + 1 end as len from files where doc_id % 6 = 0)
select f.path, f.size, f.path in (select path from pins) as pinned, f.path in (select path from offers) as offered, case when p.path is null then 'none' when p.len = f.size then 'ready' else 'stale' end as proxy
from files f left join proxies p using (path)""")
def files_view(spark, sf_dir):
    f = files(spark, sf_dir)
    pins = f.where("doc_id % 4 = 0").select("path", F.lit(True).alias("pinned"))
    offers = f.where("doc_id % 10 = 1").select("path", F.lit(True).alias("offered"))
    proxies = f.where("doc_id % 6 = 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("len"))
    j = f.join(pins, "path", "left").join(offers, "path", "left").join(proxies, "path", "left")
    proxy = F.when(F.col("len").isNull(), "none").when(F.col("len") == F.col("size"), "ready").otherwise("stale")
    return j.select("path", "size", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("offered", F.lit(False)).alias("offered"), proxy.alias("proxy"))
