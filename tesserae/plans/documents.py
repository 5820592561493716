"""Queries that write documents from the tables, read them with the sources, and compare with the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.derived import ENTRIES, manifest_entries
from tesserae.plans.registry import query, table
from tesserae.scratch import folder, saved
from tesserae.sources import readers as R
from tesserae.sources import timelines as T
from tesserae.sources import writers as W

_TIMES = "start_value::double as start_value, start_rate::double as start_rate, dur_value::double as dur_value, dur_rate::double as dur_rate"


def _doubles(items):
    return items.withColumns({c: F.col(c).cast("double") for c in items.columns if c.endswith(("_value", "_rate"))})


@query(f"""with {ENTRIES}, c as (select manifest as doc, idx, chunk, len, row_number() over (partition by manifest, chunk % 2 order by idx) - 1 as n from entries),
direct as (select doc, (chunk % 2 + case when chunk % 2 = 1 and not exists (select 1 from c d where d.doc = c.doc and d.chunk % 2 = 0) then -1 else 0 end)::bigint as track, n, case when chunk % 5 = 0 then 'gap' when chunk % 7 = 0 then 'stack' else 'clip' end as kind, chunk, len, idx from c)
select doc, kind, case when kind = 'gap' then '' else 'n' || idx end as name, case when kind = 'clip' then 'u' || chunk end as uuid, (case when kind <> 'stack' then chunk % 100 end)::double as start_value, (case when kind <> 'stack' then 24 end)::double as start_rate,
    (case when kind <> 'stack' then len / 2.0 end)::double as dur_value, (case when kind <> 'stack' then 24 end)::double as dur_rate, case when kind = 'clip' then 'm' || chunk % 9 end as media, case when kind = 'clip' then chunk % 3 else 0 end::bigint as markers, n::bigint as idx, null as inside from direct
union all select doc, 'clip', 'in' || idx, null, null, null, null, null, null, 0, 0, track || '/' || n from direct where kind = 'stack'""")
def otio_items(spark, sf_dir):
    """JSON timelines of all orders: lines on two tracks, every seventh a stack with a clip in it."""
    c, idx, chunk = manifest_entries(spark, sf_dir), F.col("idx").cast("string"), F.col("chunk")
    kind = F.when(chunk % 5 == 0, "Gap.1").when(chunk % 7 == 0, "Stack.1").otherwise("Clip.2")
    clip, stack = kind == "Clip.2", kind == "Stack.1"
    time = lambda value: F.struct(value.alias("value"), F.lit(24).alias("rate"))
    inner = F.array(F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.lit("Audio").alias("kind"), F.array(F.struct(F.lit("Clip.2").alias("OTIO_SCHEMA"), F.concat(F.lit("in"), idx).alias("name"))).alias("children")))
    item = F.struct(
        kind.alias("OTIO_SCHEMA"), F.when(kind != "Gap.1", F.concat(F.lit("n"), idx)).alias("name"), F.when(~stack, F.struct(time(chunk % 100).alias("start_time"), time(F.col("len") / 2).alias("duration"))).alias("source_range"),
        F.when(clip, F.struct(F.concat(F.lit("m"), (chunk % 9).cast("string")).alias("target_url"))).alias("media_reference"), F.when(clip, F.struct(F.concat(F.lit("u"), chunk.cast("string")).alias("uuid"))).alias("metadata"),
        F.when(clip, F.array_repeat(F.struct(F.lit("red").alias("color")), (chunk % 3).cast("int"))).alias("markers"), F.when(stack, inner).alias("children"),
    )
    lanes = c.groupBy("manifest", (chunk % 2).alias("lane")).agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("i")))).alias("s"))
    lanes = lanes.select("manifest", F.struct("lane", F.struct(F.lit("Track.1").alias("OTIO_SCHEMA"), F.lit("Video").alias("kind"), F.transform("s", lambda x: x["i"]).alias("children")).alias("t")).alias("t"))
    docs = lanes.groupBy("manifest").agg(F.transform(F.array_sort(F.collect_list("t"), lambda a, b: (a["lane"] - b["lane"]).cast("int")), lambda x: x["t"]).alias("children"))
    docs = docs.select(F.col("manifest").alias("doc"), F.to_json(F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.struct("children").alias("tracks"))).alias("text"))
    return _doubles(T.otio(docs)).select("doc", "kind", "name", "uuid", "start_value", "start_rate", "dur_value", "dur_rate", "media", "markers", "idx", "inside")


@query(f"""with {ENTRIES}, c as (select *, chunk % 6 = 0 as tied, case when chunk % 12 = 0 then -1 else 1 end as lane from entries),
s as (select *, row_number() over (partition by manifest order by idx) - 1 as n from c where not tied or idx = 1), t as (select *, row_number() over (partition by manifest, lane order by idx) - 1 as n from c where tied and idx > 1 and manifest in (select manifest from s))
select manifest as doc, 'V1' as track_name, n::bigint as idx, 'n' || idx as name, chunk::double as start_value, 24000.0::double as start_rate, len::double as dur_value, 24.0::double as dur_rate, "offset"::double as offset_value, 24.0::double as offset_rate, 'm' || chunk % 3 || '.mov' as media, (chunk % 2)::bigint as markers from s
union all select manifest, 'V2', n, 'n' || idx, null, null, len, 1, null, null, null, 0 from t""")
def fcpxml_items(spark, sf_dir):
    """XML projects of all orders: the first line and five of six others on the spine, the rest connected above or below the first."""
    c, s = manifest_entries(spark, sf_dir), lambda x: F.col(x).cast("string")
    tied = (F.col("chunk") % 6 == 0) & (F.col("idx") > 1)
    lane = F.when(F.col("chunk") % 12 == 0, "-1").otherwise("1")
    own = F.concat(F.lit('<asset-clip ref="r'), (F.col("chunk") % 3).cast("string"), F.lit('" name="n'), s("idx"), F.lit('" start="'), s("chunk"), F.lit('/24000s" duration="'), s("len"), F.lit('/24s" offset="'), s("offset"), F.lit('/24s">'), F.when(F.col("chunk") % 2 == 1, "<marker/>").otherwise(""))
    hung = F.concat(F.lit('<title name="n'), s("idx"), F.lit('" duration="'), s("len"), F.lit('s" lane="'), lane, F.lit('"/>'))
    rows = c.select("manifest", "idx", tied.alias("tied"), F.when(tied, hung).otherwise(own).alias("x"))
    each = rows.groupBy("manifest").agg(F.array_sort(F.collect_list(F.when(~F.col("tied"), F.struct("idx", "x")))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("tied"), F.struct("idx", "x")))).alias("hung"))
    close = F.lit("</asset-clip>")
    body = F.array_join(F.transform("own", lambda r: F.concat(r["x"], F.when(r["idx"] == F.col("own")[0]["idx"], F.array_join(F.transform("hung", lambda h: h["x"]), "")).otherwise(""), close)), "")
    head = '<fcpxml version="1.10"><resources>' + "".join(f'<asset id="r{i}"><media-rep src="m{i}.mov"/></asset>' for i in range(3)) + "</resources><spine>"
    docs = each.where("size(own) > 0").select(F.col("manifest").alias("doc"), F.concat(F.lit(head), body, F.lit("</spine></fcpxml>")).alias("text"))
    cols = ["doc", "track_name", "idx", "name", "start_value", "start_rate", "dur_value", "dur_rate", "offset_value", "offset_rate", "media", "markers"]
    return _doubles(T.fcpxml(docs)).select(*cols)


@query("""select event_id::varchar as id, event_id % 500 - 20 as frame, 24::bigint as rate, case event_type when 'view' then 'OPEN' when 'click' then 'RESOLVED' when 'purchase' then 'REJECTED' else 'OPEN' end as status, trim('said "' || event_type || '", ' || user_id) as body from events where event_id % 7 <> 0 and event_id % 11 <> 0""")
def notes_table(spark, sf_dir):
    """Notes of all events written as CSV under other headers, read back; rows without a rate or a body are refused."""
    path = folder(spark)
    word = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", "rejected").otherwise("whatever")
    body = F.concat(F.lit('said "'), "event_type", F.lit('", '), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 500 - 20).alias("Frame Number"), F.when(F.col("event_id") % 7 == 0, "0").otherwise("24").alias("FPS"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(body).alias("Comment"), word.alias("Status")
    )
    e.write.option("header", "true").option("escape", '"').csv(path)
    return R.notes_csv(spark, path)[0].select("id", "frame", "rate", "status", "body")


@query("select nation.n_name as name, sum(c_acctbal > 0)::bigint as good, count(*) as entries from customer join nation on c_nationkey = n_nationkey where n_nationkey % 5 <> 0 group by 1")
def json_ledgers(spark, sf_dir):
    """A ledger of a nation's customers as one JSON document; those with another tag are left out."""
    path, c = folder(spark), table(spark, sf_dir, "customer")
    entry = F.struct(F.col("c_custkey").alias("key"), (F.col("c_acctbal") > 0).alias("good"), F.col("n_name").alias("name"))
    tag = F.when(F.col("n_nationkey") % 5 == 0, "other/1").otherwise("customers/1")
    docs = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.to_json(F.struct(F.first(tag).alias("schema"), F.collect_list(entry).alias("entries"))).alias("value"))
    docs.repartition("n_nationkey").select("value", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    rows = R.ledger(spark, f"{path}/*", "customers/1", "struct<key: bigint, good: boolean, name: string>")
    return rows.groupBy("name").agg(F.count_if("good").alias("good"), F.count("*").alias("entries"))


@query("select sha256(coalesce(text, '')) as hash, strlen(coalesce(text, ''))::bigint as size, count(*) as copies from documents group by 1, 2")
def packed_objects(spark, sf_dir):
    """Documents as objects in packs of the store: written, verified, read back, each with the documents that name it."""
    path = folder(spark)
    d = saved(table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("data")).select(F.sha2("data", 256).alias("hash"), "data"))
    W.write_packs(d, path, 1 << 20)
    packs = spark.read.parquet(f"{path}/packs")
    objects = R.packs(packs.select(F.col("pack").cast("string").alias("path"), "content")).where("valid")
    return objects.select("hash", F.octet_length("data").cast("long").alias("size")).join(d.groupBy("hash").agg(F.count("*").alias("copies")), "hash")


@query("select event_type as action, count(distinct user_id)::bigint as actors, count(*) as rows from events group by 1")
def audit_sink(spark, sf_dir):
    """Audit rows appended in two goes, read as one table."""
    path, e = folder(spark), table(spark, sf_dir, "events")
    rows = e.select(F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("r").alias("resource"), F.lit("").alias("detail"), F.col("event_id").alias("ts_ms"))
    W.audit(rows.where("ts_ms % 2 = 0"), path)
    W.audit(rows.where("ts_ms % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count_distinct("actor").alias("actors"), F.count("*").alias("rows"))
