"""Queries that apply scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalar as C
from tesserae.plans.derived import millis
from tesserae.plans.registry import query, table

_PATHS = """paths as (select p_partkey, [p_name, '/' || p_name, 'a//' || p_name, 'c:' || p_name, 'a/../' || p_name, 'a' || chr(92) || p_name, 'ok/' || p_name || '.mov', '', 'x/' || chr(7), 'd/./e'][(p_partkey % 10 + 1)::int] as path from part)"""


def _paths(spark, sf_dir):
    n = F.col("p_name")
    kinds = [n, F.concat(F.lit("/"), n), F.concat(F.lit("a//"), n), F.concat(F.lit("c:"), n), F.concat(F.lit("a/../"), n), F.concat(F.lit("a\\"), n), F.concat(F.lit("ok/"), n, F.lit(".mov")), F.lit(""), F.lit("x/\x07"), F.lit("d/./e")]
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % 10 + 1).cast("int")).alias("path"))


@query(f"""with {_PATHS} select p_partkey, path, strlen(path) between 1 and 4096 and not regexp_matches(path, '[\\x00-\\x1f\\x7f\\\\]') and path[1] <> '/' and not regexp_matches(path, '^[A-Za-z]:')
    and len(list_filter(string_split(path, '/'), lambda c: c in ('', '.', '..'))) = 0 as valid,
    strlen(path) between 1 and 256 and not regexp_matches(path, '[\\x00-\\x1f\\x7f/\\\\]') as valid_key from paths""")
def path_validation(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", "path", C.valid_path("path").alias("valid"), C.valid_key("path").alias("valid_key"))


_NAMES = "names as (select p_partkey, p_name || ['.MOV', '.prproj', '.Json', '.unknown', '', '.tar.wav', '.averylongextension'][(p_partkey % 7 + 1)::int] as name from part)"


def _names(spark, sf_dir):
    ext = F.element_at(F.array(*(F.lit(x) for x in (".MOV", ".prproj", ".Json", ".unknown", "", ".tar.wav", ".averylongextension"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", ext).alias("name"))


@query(f"""with {_NAMES}, e as (select *, string_split(lower(name), '.')[-1] as ext from names) select p_partkey, ext, case when ext in ({', '.join(repr(x) for x in C.MEDIA)}) then 'none'
    when ext in ({', '.join(repr(x) for x in C.EDITORS)}) then 'zstd_dict' when ext in ({', '.join(repr(x) for x in C.TEXTISH)}) then 'zstd3' else 'none' end as policy from e""")
def compression_policy(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", C.extension("name").alias("ext"), C.compression("name").alias("policy"))


@query(f"""with {_NAMES}, s as (select p_partkey, name, regexp_extract(name, '^(.*)[.]([^./]+)$', 1) as stem, regexp_extract(name, '^(.*)[.]([^./]+)$', 2) as ext from names)
select p_partkey, case when ext <> '' and strlen(ext) <= 12 then stem || ' (conflict — dev_' || p_partkey % 5 || ' — 2024-01-02).' || ext else name || ' (conflict — dev_' || p_partkey % 5 || ' — 2024-01-02)' end as copy_name from s""")
def conflict_copy_name(spark, sf_dir):
    device = F.concat(F.lit("dev:"), (F.col("p_partkey") % 5).cast("string"))
    return _names(spark, sf_dir).select("p_partkey", C.conflict_copy("name", device, F.lit("2024-01-02")).alias("copy_name"))


@query("""with s as (select p_partkey, regexp_replace(lower(regexp_replace(trim(p_name || [' Cut #2', '', '!!', ' -x- '][(p_partkey % 4 + 1)::int]), '[^A-Za-z0-9_-]', '-', 'g')), '^-+|-+$', '', 'g') as s from part)
select p_partkey, case when s = '' then 'project' else substr(s, 1, 48) end as slug from s""")
def project_slug(spark, sf_dir):
    tail = F.element_at(F.array(*(F.lit(x) for x in (" Cut #2", "", "!!", " -x- "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.slug(F.concat("p_name", tail)).alias("slug"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def day_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.day(F.expr(millis("o_orderdate"))).alias("day"))


@query("""with f as (select o_orderkey, case when o_orderkey % 3 = 0 then -o_orderkey * 97 else o_orderkey * 97 end as frame, [24, 25, 30, 0][(o_orderkey % 4 + 1)::int] as rate from orders),
s as (select *, abs(frame) // nullif(rate, 0) as sec from f) select o_orderkey, case when rate <= 0 then frame::varchar else case when frame < 0 then '-' else '' end ||
    case when sec // 3600 < 100 then lpad((sec // 3600)::varchar, 2, '0') else (sec // 3600)::varchar end || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0') || ':' || lpad((abs(frame) % rate)::varchar, 2, '0') end as timecode from s""")
def timecode(spark, sf_dir):
    f = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_orderkey") * 97).otherwise(F.col("o_orderkey") * 97)
    rate = F.element_at(F.array(*(F.lit(x) for x in (24, 25, 30, 0))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.timecode(f, F.when(rate == 0, 0).otherwise(rate)).alias("timecode"))


@query("select o_orderkey, sign(o_orderkey::hugeint * 1001 * (o_custkey % 60 + 1) - o_custkey::hugeint * 24000)::int as cmp from orders")
def rational_compare(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.rational_compare(F.col("o_orderkey") * 1001, F.lit(24000), F.col("o_custkey"), F.col("o_custkey") % 60 + 1).alias("cmp"))


_R = ", ".join(f"'{k}': '{v}'" for k, v in C.ROLE_WORDS.items())
_S = ", ".join(f"'{k}': '{v}'" for k, v in C.STATUS_WORDS.items())


@query(f"""with w as (select event_id, [' Lead ', 'client', 'OWNER', 'sound', 'nobody'][(event_id % 5 + 1)::int] as r, ['done', ' open', 'WontFix', 'later', 'Resolved '][(event_id // 5 % 5 + 1)::int] as s from events)
select event_id, map {{{_R}}}[lower(trim(r))] as role, map {{{_S}}}[upper(trim(s))] as status from w""")
def enum_synonyms(spark, sf_dir):
    pick = lambda n, *x: F.element_at(F.array(*(F.lit(v) for v in x)), (n % 5 + 1).cast("int"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", C.synonym(pick(e, " Lead ", "client", "OWNER", "sound", "nobody"), C.ROLE_WORDS, False).alias("role"), C.synonym(pick(F.floor(e / 5), "done", " open", "WontFix", "later", "Resolved "), C.STATUS_WORDS, True).alias("status"))


@query("select n, least(30000, 100 * pow(2, least(n, 9)))::bigint as bound_ms from (select distinct event_id % 14 as n from events)")
def backoff_bounds(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 14).alias("n")).distinct().select("n", C.backoff_bound("n").alias("bound_ms"))


@query("""with n as (select p_partkey, ['con.txt', 'report.doc', 'LPT1', 'nul', 'comx.dat', '._hidden', 'a/.DS_Store', 'Thumbs.db'][(p_partkey % 8 + 1)::int] as name from part)
select p_partkey, case when upper(string_split(name, '.')[1]) in ('CON', 'LPT1', 'NUL') then '#' || name else name end as safe_name, string_split(name, '/')[-1] in ('.DS_Store', 'Thumbs.db', 'desktop.ini') or starts_with(string_split(name, '/')[-1], '._') as ignored from n""")
def name_rules(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(x) for x in ("con.txt", "report.doc", "LPT1", "nul", "comx.dat", "._hidden", "a/.DS_Store", "Thumbs.db"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.windows_name(name).alias("safe_name"), C.ignored(name).alias("ignored"))
