"""Searches over projects, files, clips and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import search_score, timecode, tokens

#: File hits before a search goes on with one of each later project, and hits in all.
FILES, ALL = 40, 60


def find(projects: DataFrame, files: DataFrame, reviews: DataFrame, needle: str) -> DataFrame:
    """(kind, project, label, rank) of what holds the needle, whatever its case: projects, then files, then reviews, 60 in all.

    ``projects`` are (project, display), ``files`` (project, path, mode), ``reviews`` (project, title), each in the order of
    project, then name. Files come project by project; from the fortieth on, each later project gives its first alone. An empty needle finds nothing.
    """
    low = needle.lower()
    hit = lambda c: F.lower(c).contains(low) & F.lit(bool(low.strip()))
    p = projects.where(hit("project") | hit("display")).select(F.lit(0).alias("_k"), F.lit("project").alias("kind"), "project", F.col("display").alias("label"))
    f = files.where(F.col("mode") == "file").where(hit("path")).select("project", "path")
    first = f.orderBy("project", "path").limit(FILES)
    full = first.agg(F.count("*").alias("_n"), F.max("project").alias("_last")).where(F.col("_n") >= FILES).select("_last")
    later = f.groupBy("project").agg(F.min("path").alias("path")).join(F.broadcast(full), F.col("project") > F.col("_last")).drop("_last").orderBy("project").limit(ALL)  # one row
    found = first.unionByName(later).select(F.lit(1).alias("_k"), F.lit("file").alias("kind"), "project", F.col("path").alias("label"))
    r = reviews.where(hit("title")).select(F.lit(2).alias("_k"), F.lit("review").alias("kind"), "project", F.col("title").alias("label"))
    top = p.unionByName(found).unionByName(r).orderBy("_k", "project", "label").limit(ALL)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy("_k", "project", "label")) - 1).cast("long")).drop("_k")  # at most 60 rows


def ranked(files: DataFrame, clips: DataFrame, query: list[str], most: int) -> DataFrame:
    """(kind, path, clip, media, timecode, score): files (path) and clips (path, track, idx, video, name, media, dur, rate) by relevance.

    A clip is scored by its own name, and by its document, name and media together, two more on a video track; clips
    without a name are left out. Its timecode is where it begins on its track. Order is by score, path, clip, timecode.
    """
    before = Window.partitionBy("path", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    c = clips.withColumn("_pos", F.coalesce(F.sum("dur").over(before), F.lit(0)))
    base = F.substring_index("media", "/", -1)
    score = search_score(query, F.concat_ws(" ", "path", "name", F.coalesce(base, F.lit(""))), "name")
    rate = F.when(F.coalesce("rate", F.lit(0)) > 0, F.col("rate")).otherwise(24)
    hit = c.withColumn("score", score).where("score > 0 and name <> ''").select(F.lit("clip").alias("kind"), "path", F.col("name").alias("clip"), base.alias("media"), timecode("_pos", rate).alias("timecode"), (F.col("score") + F.when(F.col("video"), 2).otherwise(0)).alias("score"))
    none = F.lit(None).cast("string")
    f = files.withColumn("score", search_score(query, "path")).where("score > 0").select(F.lit("file").alias("kind"), "path", none.alias("clip"), none.alias("media"), none.alias("timecode"), "score")
    return f.unionByName(hit).orderBy(F.desc("score"), "path", F.asc_nulls_first("clip"), F.asc_nulls_first("timecode")).limit(most)


def words(text: str, spark) -> list[str]:
    """The tokens of a query."""
    return spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]


def overlays(files: DataFrame, before: DataFrame, generation: int, now_ms: int, every_ms: int = 60_000) -> DataFrame:
    """(project_id, digest, entries, write): whether a project's icons are written again.

    They are if what shows changed since the last look (``before``: project_id, digest, at_ms) or that was ``every_ms`` ago or more. The
    digest is a sum over all files (project_id, path, local_state), so it depends on no order and a project is never gathered;
    entries are the files that have an icon.
    """
    line = F.sha2(F.concat_ws("|", "path", "local_state", F.lit(str(generation))), 256)
    part = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    icon = F.col("local_state").isin("conflict", "placeholder", "synced", "clean", "pinned")
    now = files.groupBy("project_id").agg(F.sum(part).cast("string").alias("digest"), F.count_if(icon).alias("entries"))
    old = before.select("project_id", F.col("digest").alias("_digest"), "at_ms")
    same = (F.col("_digest") == F.col("digest")) & (F.lit(now_ms) - F.col("at_ms") < every_ms)
    return now.join(old, "project_id", "left").select("project_id", "digest", "entries", (~F.coalesce(same, F.lit(False))).alias("write"))


def in_states(files: DataFrame, states: list[str]) -> DataFrame:
    """Files in one of the states; of none if there are none."""
    return files.where(F.col("local_state").isin(states)) if states else files.where(F.lit(False))
