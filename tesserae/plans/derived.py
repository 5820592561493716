"""Logical inputs (journal, files, state records, manifests) derived from the star schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.operators.store import numbered
from tesserae.plans.registry import table

DAY_MS = 86_400_000


def millis(ts: str) -> str:
    """Epoch milliseconds of a timestamp without zone."""
    return f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "file_upsert").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "signup", "state_record").otherwise("file_delete")
    j = e.select(
        (F.col("user_id") % 8).alias("project_id"), "event_id", F.col("user_id").alias("device_id"),
        F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("path"), F.concat(F.lit("f"), ((F.col("event_id") * 7 + 1) % 97).cast("string")).alias("new_path"),
        kind.alias("kind"), F.expr(millis("ts")).alias("server_ms"), F.concat(F.lit("m"), (F.col("event_id") % 211).cast("string")).alias("manifest"),
        (F.col("event_id") * 13 % 5000).alias("size"), F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("request_id"),
        F.col("event_type").alias("family"), "props", "value",
    )
    j = numbered(j, ["event_id"], ["project_id"], "seq").withColumn("seq", F.col("seq") + 1)
    return j.withColumn("base_seq", F.greatest(F.col("seq") - F.col("event_id") % 7 * 40, F.lit(0).cast("long")))


JOURNAL = """
journal0 as (
    select user_id % 8 as project_id, event_id, user_id as device_id, 'f' || (event_id % 97) as path, 'f' || ((event_id * 7 + 1) % 97) as new_path,
           case when event_type in ('view', 'click') then 'file_upsert' when event_type = 'purchase' then 'rename'
                when event_type = 'signup' then 'state_record' else 'file_delete' end as kind,
           epoch_us(ts) // 1000 as server_ms, 'm' || (event_id % 211) as manifest, event_id * 13 % 5000 as size,
           'r' || (event_id // 2) || '-' || user_id as request_id, event_type as family, props, value,
           row_number() over (partition by user_id % 8 order by event_id) as seq
    from events
), journal as (select *, greatest(seq - event_id % 7 * 40, 0) as base_seq from journal0)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local file rows, one per document."""
    states = F.element_at(F.array(*(F.lit(s) for s in ("synced", "clean", "dirty", "pinned", "placeholder", "conflict", "fetching"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.concat(F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".otio")).alias("path"), F.col("n_chars").alias("size"),
        (F.lit(1_700_000_000_000) + F.col("doc_id") * 3_600_007 % 7_776_000_000).cast("long").alias("mtime"), states.alias("local_state"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), (F.col("doc_id") % 89).cast("string"))).alias("manifest"), "doc_id",
    )


FILES = """
files as (
    select source as project_id, lang || '/doc' || doc_id || '.otio' as path, n_chars as size,
           1700000000000 + doc_id * 3600007 % 7776000000 as mtime,
           ['synced', 'clean', 'dirty', 'pinned', 'placeholder', 'conflict', 'fetching'][(doc_id % 7 + 1)::int] as local_state,
           case when doc_id % 5 <> 0 then 'm' || (doc_id % 89) end as manifest, doc_id
    from documents
)
"""


def manifest_entries(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(manifest, idx, chunk, len, offset): an order's distinct lines as a manifest of chunks. Rows are dealt once, by manifest."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_linenumber").cast("long").alias("idx"), "l_partkey")
    line = line.repartition(*([parts] if parts else []), "manifest").groupBy("manifest", "idx").agg(F.min("l_partkey").alias("chunk"))
    line = line.withColumn("len", F.col("chunk") % 1000 + 1)
    before = Window.partitionBy("manifest").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return line.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))


ENTRIES = """
entries0 as (select l_orderkey as manifest, l_linenumber::bigint as idx, min(l_partkey) as chunk from lineitem group by 1, 2),
entries as (select *, chunk % 1000 + 1 as len, (coalesce(sum(chunk % 1000 + 1) over (partition by manifest order by idx rows between unbounded preceding and 1 preceding), 0))::bigint as "offset" from entries0)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    last = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.expr(millis("l_shipdate"))).alias("last_touched"))
    return p.join(last, p.p_partkey == last.l_partkey, "left").select(
        F.col("p_partkey").alias("hash"), (F.col("p_size").cast("long") * 1000).alias("size"), F.when(F.col("p_size") % 3 == 0, "archive").otherwise("hot").alias("tier"),
        F.when(F.col("p_partkey") % 11 == 0, "deleting").otherwise("present").alias("state"), F.coalesce("last_touched", F.lit(0)).cast("long").alias("last_touched"),
    )


CHUNKS = """
chunks as (
    select p_partkey as hash, p_size::bigint * 1000 as size, case when p_size % 3 = 0 then 'archive' else 'hot' end as tier,
           case when p_partkey % 11 = 0 then 'deleting' else 'present' end as state, coalesce(t, 0) as last_touched
    from part left join (select l_partkey, max(epoch_us(l_shipdate) // 1000) as t from lineitem group by 1) on p_partkey = l_partkey
)
"""
