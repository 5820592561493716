"""The queries opN_<name>: each applies its operator to a whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import capfilters, dualtree, exact, fim, langid, lm, mixing, packing, quality, simhash, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), repeats=2.0)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.cluster(_table(spark, sf_dir, "embeddings"))


_QUERIES = [op1_simhash_near_dedup, op2_substring_dedup, op3_warc, op4_packing, op5_quality, op6_exact_dedup, op7_toxicity, op8_source_mixing, op9_embedding_near_dedup, op10_lm_scoring,
            op11_fill_in_middle, op12_language_id, op13_centroid_clustering]

def _rounds_sql(rounds: int = 10) -> str:
    """Lloyd's rounds over 8 centroids, one after the other."""
    near = """(select vec_id, rid, v, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, x)])::bigint, c := c)) as best
              from kept, c{0} group by vec_id, rid, v)"""
    steps = ["""kept as (select vec_id, row_number() over () as rid, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
                where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64)""",
             "c0 as (select (row_number() over (order by sha256('3:' || vec_id::varchar), v) - 1)::int as c, v as x from kept qualify c < 8)"]
    for r in range(rounds):
        steps.append(f"""m{r} as (select c, i, (s - ((s % n) + n) % n) // n as m from (
            select best.c as c, i, sum(v[i]) as s, count(*) as n from {near.format(r)}, range(1, 65) g(i) group by 1, 2))""")
        steps.append(f"c{r + 1} as (select o.c, coalesce(list(m.m::bigint order by m.i) filter (where m.m is not null), any_value(o.x)) as x from c{r} o left join m{r} m using (c) group by o.c)")
    return f"""with {', '.join(s.replace(' as (', ' as materialized (', 1) for s in steps)}
        select vec_id, best.c as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
               sha256(array_to_string(x, ',')) as centroid_sha256
        from {near.format(rounds)} join c{rounds} on c = best.c"""


_SQL = {
    "op11_fill_in_middle": """
        with t as (
            select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id::varchar) as h from documents
        ), u as (
            select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
                   case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
                        when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
            from t
        ), c as (
            select *, left(text, least(a, b)) as p, substr(text, least(a, b) + 1, abs(a - b)) as m, substr(text, greatest(a, b) + 1) as s from u
        )
        select doc_id, n, form, case when form <> 'plain' then least(a, b) end as prefix_chars, case when form <> 'plain' then abs(a - b) end as middle_chars,
               sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
               sha256(text) as restored_sha256
        from c
    """,
    "op13_centroid_clustering": _rounds_sql(),
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
        q as (select *, max(page_id) over (partition by hex) as last from p)
        select page_id, strlen(html) as payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1) for i in range(32)], '') as payload_digest,
               case when page_id = last then 'response' else 'revisit' end as record_type,
               case when page_id <> last then last end as refers_to
        from q
    """,
    "op6_exact_dedup": """
        with t as (
            select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents
        ), w as (
            select doc_id, norm,
                   first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
                   count(*) over (partition by norm) as group_size
            from t
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from w
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
