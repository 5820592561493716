"""Queries over texts and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.note_grammar import note_ops as parse
from tesserae.functions.scalar import search_score
from tesserae.operators import blobs as B
from tesserae.operators import chunking as K
from tesserae.operators import search as Q
from tesserae.operators.store import prefix_until
from tesserae.plans.derived import FILES, files
from tesserae.plans.registry import query, table

_WORDS = ["red", "widget", "eco", "brand"]


@query(f"""with p as (select p_partkey, replace(p_brand, '#', '') || '/' || p_type || '/' || p_name || '.mov' as path from part),
t as (select *, lower(path) as low, lower(p[3]) as name, list_filter(regexp_split_to_array(lower(path), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2) as toks from (select *, string_split(path, '/') as p from p)),
s as (select p_partkey, path, {' + '.join(f"case when list_contains(toks, '{w}') then 10 when len(list_filter(toks, lambda x: starts_with(x, '{w}'))) > 0 then 6 when contains(name, '{w}') then 4 when contains(low, '{w}') then 2 else 0 end" for w in _WORDS)} as raw, {' and '.join(f"contains(low, '{w}')" for w in _WORDS)} as every from t)
select p_partkey, path, (raw + case when raw > 0 and every then 5 else 0 end)::int as score from s where raw > 0 order by score desc, path, p_partkey limit 50""")
def ranked_search(spark, sf_dir):
    path = F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("")), "p_type", F.concat("p_name", F.lit(".mov")))
    hits = table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("score", search_score(_WORDS, "path").cast("int"))
    return hits.where("score > 0").orderBy(F.desc("score"), "path", "p_partkey").limit(50)


@query("""with l as (select source, unnest(string_split(text, chr(10))) as line from documents), h as (select source, sha256(line) as hash, count(*) as n, min(strlen(line)) as size from l where line <> '' group by 1, 2)
select source, sum(n)::bigint as total, count(*) as "unique", round((sum(n) - count(*)) * 100.0 / sum(n), 9)::double as dedup_pct, sum(n * size)::bigint as bytes, sum(size)::bigint as stored from h group by 1""")
def line_chunk_dedup(spark, sf_dir):
    return K.line_stats(table(spark, sf_dir, "documents"), "source")


@query()
def cdc_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return K.cdc_chunks(d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data")))


def source_blocks(spark, sf_dir):
    """One blob a source: its documents in order, each a block with the digest of its number behind it."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.coalesce("text", F.lit("")), F.sha2(F.col("doc_id").cast("string"), 256)).cast("binary").alias("data"))
    placed = prefix_until(d.select("source", "doc_id", F.octet_length("data").cast("long").alias("n")), ["doc_id"], "n", ["source"]).select("doc_id", F.col("before").alias("offset"))
    return d.join(placed, "doc_id").select(F.col("source").alias("id"), F.col("doc_id").alias("block"), "offset", "data")


@query()
def blob_chunks(spark, sf_dir):
    return B.chunk_blocks(source_blocks(spark, sf_dir)).drop("data")


@query("""with b as (select p_partkey // 8 as stripe, unnest(range(1, length(p_name) + 1)) as pos, p_name from part), x as (select stripe, pos, bit_xor(ascii(p_name[pos::int])) as v from b group by 1, 2)
select stripe, string_agg(lpad(lower(to_hex(v)), 2, '0'), '' order by pos) as parity from x group by 1""")
def xor_parity(spark, sf_dir):
    return K.xor_parity(table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 8).alias("stripe"), F.encode("p_name", "UTF-8").alias("data")))


@query("select p_partkey // 8 as stripe, p_partkey % 8 as shard, p_name as text from part where p_partkey % 8 = p_partkey // 8 % 8 and p_partkey // 8 % 3 > 0")
def parity_recovery(spark, sf_dir):
    k = F.col("p_partkey")
    every = table(spark, sf_dir, "part").select(F.floor(k / 8).alias("stripe"), (k % 8).alias("shard"), F.encode("p_name", "UTF-8").alias("data"))
    lost = F.expr("shard = stripe % 8 or (stripe % 3 = 0 and shard = (stripe + 1) % 8)")  # of every third stripe two
    sizes = every.select("stripe", "shard", F.octet_length("data").alias("size"))
    back = K.recover(every.where(~lost), K.xor_parity(every), sizes).where("stripe % 3 > 0")
    return back.select("stripe", "shard", F.decode("data", "UTF-8").alias("text"))


_SAID = """case event_id % 5 when 0 then [('trim_out', (2 * k + 1) || '/2'), ('gain', k::varchar)] when 1 then [('trim_in', '1/2'), ('delete', '')] when 2 then [('replace', 'the wide shot')] when 3 then [('trim_out', k::varchar)] else [('gain', '-3')] end"""
_BODIES = """case event_id % 5 when 0 then 'Cut ' || k || '.5 seconds off the end. Louder by ' || k || ' db!' when 1 then 'trim half a second off the start; delete this' when 2 then 'replace it with the wide shot please' when 3 then 'shave ' || k || ' frames off the tail' else 'Love the mood here. Turn down the music' end"""


@query(f"""with e as (select event_id, event_id % 9 + 1 as k from events), s as (select event_id, {_SAID} as ops from e)
select event_id, n::int as n, case when n is not null then ops[n + 1][1] end as op, case when n is not null then ops[n + 1][2] end as value from s, unnest([0, 1]) u(n) where n < len(ops)""")
def note_ops(spark, sf_dir):
    n = (F.col("event_id") % 9 + 1).cast("string")
    notes = [F.concat(F.lit("Cut "), n, F.lit(".5 seconds off the end. Louder by "), n, F.lit(" db!")), F.concat(F.lit("trim half a second off the start; delete this")), F.lit("replace it with the wide shot please"), F.concat(F.lit("shave "), n, F.lit(" frames off the tail")), F.lit("Love the mood here. Turn down the music")]
    body = F.element_at(F.array(*notes), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", body.alias("body")).select("event_id", F.posexplode_outer(parse("body")).alias("n", "o")).select("event_id", "n", "o.op", "o.value")


@query("""with p as (select distinct 'r' || p_partkey % 5 || '/s' || p_partkey % 7 || '/t' || p_partkey % 11 as path from part), r as (select unnest(['r0', 'r0/s1', 'r0/s1/t3', 'r1/s', 'r2', 'r3/s3', 'r3/s3/t10']) as root)
select path, max_by(root, length(root)) as root from p join r on path = root or starts_with(path, root || '/') group by 1""")
def longest_prefix(spark, sf_dir):
    k = lambda c, n: F.concat(F.lit(c), (F.col("p_partkey") % n).cast("string"))
    roots = spark.createDataFrame([(r,) for r in ("r0", "r0/s1", "r0/s1/t3", "r1/s", "r2", "r3/s3", "r3/s3/t10")], "root string")
    return K.longest_prefix(table(spark, sf_dir, "part").select(F.concat_ws("/", k("r", 5), k("s", 7), k("t", 11)).alias("path")), roots)


@query(f"""with {FILES}, p as (select 0 as k, 'project' as kind, source as project, upper(source) || ' c1' as label from documents group by source), f as (select project_id as project, path from files where contains(lower(path), 'c1')),
n as (select *, row_number() over (order by project, path) as r from f), last as (select max(project) as last from n where r <= 40 having count(*) = 40), hits as (select project, path from n where r <= 40 union all (select project, min(path) from f, last where project > last group by 1)),
a as (select * from p where contains(lower(label), 'c1') or contains(lower(project), 'c1') union all select 1, 'file', project, path from hits union all select 2, 'review', source, 'Review C1 of ' || source from documents group by source)
select kind, project, label, row_number() over (order by k, project, label) - 1 as rank from a order by k, project, label limit 60""")
def substring_search(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    projects = sources.select(F.col("source").alias("project"), F.concat(F.upper("source"), F.lit(" c1")).alias("display"))
    reviews = sources.select(F.col("source").alias("project"), F.concat(F.lit("Review C1 of "), "source").alias("title"))
    return Q.find(projects, files(spark, sf_dir).select(F.col("project_id").alias("project"), "path", F.lit("file").alias("mode")), reviews, "C1")


_HAY = "lower(path || ' ' || p_name || ' ' || p_brand || '.mov')"


def _clip_score(words: list[str]) -> str:
    return " + ".join(f"case when list_contains(toks, '{w}') then 10 when len([x for x in toks if starts_with(x, '{w}')]) > 0 then 6 when contains(low, '{w}') then 4 when contains(hay, '{w}') then 2 else 0 end" for w in words)


@query(f"""with c as (select p_partkey, p_name, p_brand, 'cut' || p_partkey % 50 || '.otio' as path, p_partkey // 50 % 2 as track, p_partkey // 100 as idx, p_size::bigint as dur from part),
h as (select *, lower(p_name) as low, {_HAY} as hay, [x for x in regexp_split_to_array({_HAY}, '[^\\p{{L}}\\p{{N}}]+') if strlen(x) >= 2] as toks, coalesce(sum(dur) over (partition by path, track order by idx rows between unbounded preceding and 1 preceding), 0) as pos from c),
s as (select *, {_clip_score(_WORDS)} as raw, {' and '.join(f"contains(hay, '{w}')" for w in _WORDS)} as every from h)
select 'clip' as kind, path, p_name as clip, p_brand || '.mov' as media, lpad((pos // 24 // 3600)::varchar, 2, '0') || ':' || lpad((pos // 24 // 60 % 60)::varchar, 2, '0') || ':' || lpad((pos // 24 % 60)::varchar, 2, '0') || ':' || lpad((pos % 24)::varchar, 2, '0') as timecode,
    (raw + case when raw > 0 and every then 5 else 0 end + case when track = 0 then 2 else 0 end)::int as score from s where raw > 0 order by score desc, path, clip, timecode limit 60""")
def ranked_clips(spark, sf_dir):
    """Clips of fifty timelines, on a video and an audio track each; no file of theirs matches."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("cut"), (k % 50).cast("string"), F.lit(".otio"))
    clips = table(spark, sf_dir, "part").select(path.alias("path"), (F.floor(k / 50) % 2).alias("track"), F.floor(k / 100).alias("idx"), (F.floor(k / 50) % 2 == 0).alias("video"), F.col("p_name").alias("name"), F.concat(F.lit("media/"), "p_brand", F.lit(".mov")).alias("media"), F.col("p_size").cast("long").alias("dur"), F.lit(24).cast("long").alias("rate"))
    return Q.ranked(clips.select("path").distinct(), clips, _WORDS, 60).withColumn("score", F.col("score").cast("int"))
