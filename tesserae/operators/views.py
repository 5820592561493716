"""Read-side views over files, records, leases and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which local state may follow which; every state may follow itself.
TRANSITIONS = {
    "clean": "dirty placeholder pinned", "dirty": "hashing", "hashing": "upload_pending dirty", "upload_pending": "outbox_pending dirty", "outbox_pending": "synced dirty",
    "synced": "dirty conflict pinned placeholder", "placeholder": "pinned synced dirty", "pinned": "clean synced", "conflict": "dirty",
}

# Wire code and retry class of every kind of error.
ERRORS = {
    "conflict": ("CONFLICT", "conflict"), "stale_lease": ("STALE_LEASE", "conflict"), "ref_cas": ("REF_CAS", "conflict"), "unauthenticated": ("UNAUTHENTICATED", "never"),
    "permission_denied": ("PERMISSION_DENIED", "never"), "not_found": ("NOT_FOUND", "server"), "session_expired": ("SESSION_EXPIRED", "server"), "checksum_mismatch": ("CHECKSUM_MISMATCH", "server"),
    "batch_too_large": ("BATCH_TOO_LARGE", "server"), "rate_limited": ("RATE_LIMITED", "auto"), "internal": ("INTERNAL", "server"), "unavailable": ("UNAVAILABLE", "auto"),
    "compaction_required": ("COMPACTION_REQUIRED", "server"), "session_full": ("SESSION_FULL", "server"), "manifest_format": ("CHECKSUM_MISMATCH", "never"), "chunk_verification": ("CHECKSUM_MISMATCH", "never"),
    "local_cas_corrupt": ("CHECKSUM_MISMATCH", "never"), "compression": ("CHECKSUM_MISMATCH", "server"), "io": ("UNAVAILABLE", "auto"), "invalid_path": ("INVALID_PATH", "never"),
}


def may_follow(before: Column, after: Column) -> Column:
    """Whether a local state may become another."""
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs.split()]
    known = before.isin(list(TRANSITIONS)) & after.isin(list(TRANSITIONS))
    return known & ((before == after) | F.concat_ws(">", before, after).isin(pairs))


def with_errors(rows: DataFrame) -> DataFrame:
    """Rows with an error ``kind`` and their code and retry class."""
    dim = rows.sparkSession.createDataFrame([(k, *v) for k, v in ERRORS.items()], "kind string, code string, retry string")
    return rows.join(F.broadcast(dim), "kind", "left")  # a fixed table of twenty rows


def hydration(files: DataFrame, disk: DataFrame) -> DataFrame:
    """Files with a manifest in a state that wants bytes, and none of that size on disk (path, size)."""
    want = files.where(F.col("manifest").isNotNull() & F.col("local_state").isin("synced", "clean", "placeholder"))
    return want.join(disk.select("path", F.col("size").alias("_size")), "path", "left").where(F.col("_size").isNull() | ((F.col("local_state") == "placeholder") & (F.col("_size") != F.col("size")))).drop("_size")


def eviction_target(total: Column, free: Column, pct: Column, live: Column) -> Column:
    """Bytes to evict so that a share of the disk is free; null if there is nothing to do."""
    want = F.floor(total * pct / 100)
    return F.when((total > 0) & pct.between(1, 99) & (free < want), F.least(live, want - free))


def handoff(file_now: Column, file_then: Column, timeline_now: Column, timeline_then: Column) -> Column:
    """file_changed before timeline_moved before current; a missing value is not checked."""
    return F.when(file_now != file_then, "file_changed").when(timeline_now != timeline_then, "timeline_moved").otherwise("current")


def team(members: DataFrame, audit: DataFrame, newest: int) -> DataFrame:
    """Members by device, each with the number of audit records and whether one is among the newest."""
    top = audit.orderBy(F.desc("ts_ms"), F.desc("id")).limit(newest).select("device").distinct().withColumn("recent", F.lit(True))
    n = audit.groupBy("device").agg(F.count("*").alias("records"))
    return members.join(n, "device", "left").join(top, "device", "left").select("device", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("recent", F.lit(False)).alias("recent"))


def markers(existing: DataFrame, notes: DataFrame) -> DataFrame:
    """Markers (doc, uuid, start, name): notes replace those of the same uuid; order by start, then name."""
    rows = existing.join(notes.select("doc", "uuid"), ["doc", "uuid"], "left_anti").unionByName(notes)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("start", "name", "uuid")))


def rate_fields(num: Column, den: Column) -> tuple[Column, Column]:
    """(integer timebase, whether it is a broadcast rate) of num/den frames a second."""
    d = F.greatest(den, F.lit(1))
    return F.greatest(F.lit(1), F.floor((num + d - 1) / d)), (d > 1) & (num % d != 0)


def version_stack(versions: DataFrame) -> DataFrame:
    """Versions (link, at) with their number in the stack and whether each is the latest."""
    w = Window.partitionBy("link").orderBy("at")
    return versions.withColumn("number", F.row_number().over(w)).withColumn("latest", F.lead("at").over(w).isNull())


def offers(rows: DataFrame) -> DataFrame:
    """One pending merge offer (project_id, path, created) per path, the newest."""
    return rows.groupBy("project_id", "path").agg(F.max("created").alias("created"), F.count("*").alias("raised"))


def raw_records(rows: DataFrame, families: list[str]) -> DataFrame:
    """Records of known families with their payload as JSON text; one that does not parse becomes a JSON string."""
    v = F.try_parse_json("payload")
    return rows.where(F.col("family").isin(families)).withColumn("is_json", v.isNotNull()).withColumn("shown", F.when(v.isNotNull(), F.col("payload")).otherwise(F.to_json(F.struct(F.col("payload").alias("text")))))


def volumes(workspaces: DataFrame) -> DataFrame:
    """One row per volume (volume, total, free), from the workspaces on it."""
    return workspaces.groupBy("volume").agg(F.max("total").alias("total"), F.min("free").alias("free"))


def reassembled(entries: DataFrame) -> DataFrame:
    """Per manifest the digest of its chunk digests in order, its length, and whether the offsets are gapless."""
    each = F.array_sort(F.collect_list(F.struct("idx", "offset", "len", "chunk")))
    m = entries.groupBy("manifest").agg(each.alias("e"))
    digest = F.sha2(F.array_join(F.transform("e", lambda x: F.sha2(x["chunk"].cast("string"), 256)), ""), 256)
    total = F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    fits = F.aggregate("e", F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct((a.at + x["len"]).alias("at"), (a.ok & (a.at == x["offset"])).alias("ok")))
    return m.select("manifest", digest.alias("file_hash"), total.alias("total_len"), fits.ok.alias("gapless"))


def assembled(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, content binary, valid): files put together from their entries (file, idx, hash) and the store's chunks (hash, data binary).

    Bytes are joined as they are, whatever they encode and wherever chunks end. A file is one value, so it fits in a task; larger ones
    stay rows, see :func:`tesserae.operators.blobs.verified`. It is valid if no chunk is missing and each has its digest; a missing chunk counts as empty.
    """
    good = chunks.select("hash", "data", (F.sha2("data", 256) == F.col("hash")).alias("ok"))
    each = entries.join(good, "hash", "left").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("data", F.lit(b"")).alias("data")))).alias("e"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("valid"))
    return each.select("file", F.unhex(F.array_join(F.transform("e", lambda x: F.hex(x["data"])), "")).alias("content"), "valid")


def proxy_status(files: DataFrame, proxies: DataFrame) -> DataFrame:
    """(path, status): failed, ready (made of this size and time), stale, or none; of several proxies (path, size, mtime, failed, at) the newest counts."""
    last = proxies.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "failed"), "at").alias("p"))
    same = (F.col("p.size") == F.col("size")) & (F.col("p.mtime") == F.col("mtime"))
    return files.join(last, "path", "left").select("path", F.when(F.col("p").isNull(), "none").when(F.col("p.failed"), "failed").when(same, "ready").otherwise("stale").alias("status"))
