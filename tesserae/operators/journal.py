"""Operators over an append-only journal of file operations (project_id, seq, device_id, path, kind, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import runs


def batch(journal: DataFrame, after: int, limit: int) -> DataFrame:
    """Each project's next entries after a cursor, in sequence order; the limit is held in [1, 512]."""
    n = min(max(limit, 1), 512)
    order = Window.partitionBy("project_id").orderBy("seq")
    return journal.where(F.col("seq") > after).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def fold(journal: DataFrame, since: int = 0) -> DataFrame:
    """The state of every path after replaying entries with seq > since: (project_id, path, state, manifest, size, seq).

    An upsert sets a path present, a delete a tombstone, a rename both; other kinds do nothing. One
    aggregate with map-side combine keeps the last effect of each path, so a hot path costs one row a task.
    """
    here = F.struct(F.col("path").alias("path"), F.lit(0).alias("part"), F.when(F.col("kind") == "file_upsert", "present").otherwise("tombstone").alias("state"), F.when(F.col("kind") == "file_upsert", F.col("manifest")).alias("manifest"), F.when(F.col("kind") == "file_upsert", F.col("size")).alias("size"))
    there = F.struct(F.col("new_path").alias("path"), F.lit(1).alias("part"), F.lit("present").alias("state"), F.col("manifest").alias("manifest"), F.lit(0).cast("long").alias("size"))
    ops = journal.where(F.col("kind").isin("file_upsert", "file_delete", "rename") & (F.col("seq") > since))
    effects = ops.select("project_id", "seq", F.explode(F.when(F.col("kind") == "rename", F.array(here, there)).otherwise(F.array(here))).alias("e"))
    last = effects.groupBy("project_id", "e.path").agg(F.max_by("e", F.struct("seq", "e.part")).alias("e"), F.max("seq").alias("seq"))
    return last.select("project_id", "path", "e.state", "e.manifest", "e.size", "seq")


def snapshot(journal: DataFrame) -> DataFrame:
    """The present paths, and the watermark max(seq) of the whole journal of each project."""
    mark = journal.groupBy("project_id").agg(F.max("seq").alias("snapshot_seq"))
    return fold(journal).where("state = 'present'").join(mark, "project_id").select("project_id", "path", "manifest", "size", "snapshot_seq")


def deduplicate(journal: DataFrame) -> DataFrame:
    """Every append with the seq it is answered with: that of the first append with its request id."""
    first = journal.groupBy("project_id", "request_id").agg(F.min("seq").alias("answer_seq"))
    return journal.join(first, ["project_id", "request_id"]).withColumn("deduplicated", F.col("seq") != F.col("answer_seq"))


def conflicts(journal: DataFrame) -> DataFrame:
    """Entries (not state records) for which another device has an earlier entry with seq > base_seq on the same path.

    The windows read each path once: the last earlier entry by any device, and the last by a device other than that one's.
    """
    order = Window.partitionBy("project_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("seq", "device_id")).over(order)
    j = journal.where("kind <> 'state_record'").withColumn("_last", top)
    # the runner-up device: the last seq at which the device differs from that of the last entry before it
    change = F.lag("device_id").over(Window.partitionBy("project_id", "path").orderBy("seq"))
    j = j.withColumn("_before", F.when(change != F.col("device_id"), F.lag("seq").over(Window.partitionBy("project_id", "path").orderBy("seq"))))
    other = F.last("_before", ignorenulls=True).over(Window.partitionBy("project_id", "path").orderBy("seq"))
    j = j.withColumn("_other", F.when(F.col("_last.device_id") != F.col("device_id"), F.col("_last.seq")).otherwise(other))
    return j.withColumn("conflict", F.coalesce(F.col("_other") > F.col("base_seq"), F.lit(False))).withColumn("head_seq", F.col("_last.seq")).drop("_last", "_before", "_other")


def fencing(journal: DataFrame, leases: DataFrame) -> DataFrame:
    """Whether an unexpired lease (project_id, path, holder, token, expires_at) of another device or token fences an entry (token) out."""
    ruled = journal.where(F.col("kind").isin("file_upsert", "rename"))
    held = (F.col("expires_at") > F.col("server_ms")) & ((F.col("holder") != F.col("device_id")) | (F.col("lease_token") != F.col("token")))
    return ruled.join(leases, ["project_id", "path"], "left").withColumn("fenced", F.coalesce(held, F.lit(False)))


def compact(journal: DataFrame, fold_seq: DataFrame, cutoff_ms: int) -> DataFrame:
    """What compaction keeps: entries after the fold, younger than the cutoff, or of state records."""
    gone = (F.col("seq") <= F.col("fold_seq")) & (F.col("server_ms") < cutoff_ms) & ~F.col("path").like("state/%")
    return journal.join(fold_seq, "project_id").where(~gone).drop("fold_seq")


def apply_replay(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Local rows after the last effect of each path: dirty rows and rows with the same manifest keep their own size and state."""
    e, f = fold(entries).alias("e"), files.alias("f")
    ts = entries.groupBy("project_id", "seq").agg(F.max("server_ms").alias("server_ms"), F.max("kind").alias("kind"))
    e = fold(entries).join(ts, ["project_id", "seq"]).alias("e")
    j = e.join(f, (F.col("e.project_id") == F.col("f.project_id")) & (F.col("e.path") == F.col("f.path")), "left")
    own = F.col("f.local_state").isin("dirty", "conflict") | (F.col("f.manifest") == F.col("e.manifest"))
    upsert = (F.col("e.state") == "present") & (F.col("e.kind") == "file_upsert")
    keep = F.coalesce(own, F.lit(False)) & upsert
    state = F.when(keep, F.col("f.local_state")).when(upsert, "placeholder").when(F.col("e.state") == "present", "clean").otherwise("synced")
    size = F.when(keep, F.col("f.size")).when(upsert, F.col("e.size")).otherwise(F.lit(0))
    mtime = F.when(keep, F.col("f.mtime")).otherwise(F.col("e.server_ms"))
    mode = F.when(F.col("e.state") == "present", "file").otherwise("tombstone")
    return j.select("e.project_id", "e.path", F.when(F.col("e.state") == "present", F.col("e.manifest")).alias("manifest"), size.cast("long").alias("size"), mode.alias("mode"), mtime.alias("mtime"), state.alias("local_state"))


def fork_base(journal: DataFrame, me_mod: int, cursor: int) -> DataFrame:
    """min(cursor, fork - 1) for each path, where the fork is the first entry of another root."""
    return journal.where((F.col("device_id") % me_mod != 0) & (F.col("kind") == "file_upsert")).groupBy("project_id", "path").agg(F.least(F.lit(cursor).cast("long"), F.min("seq") - 1).alias("base"))


def merge_base(journal: DataFrame) -> DataFrame:
    """For each upsert: the manifest at its base and that of the last upsert of another device after the base and before it.

    The base is an equi-join on its sequence number; the other device's last upsert comes from running
    windows, as in :func:`conflicts`.
    """
    order = Window.partitionBy("project_id", "path").orderBy("seq")
    u = journal.where("kind = 'file_upsert'").select("project_id", "path", "seq", "device_id", "base_seq", "manifest")
    last = F.lag(F.struct("seq", "device_id", "manifest")).over(order)
    w = u.withColumn("_last", last).withColumn("_turn", F.when(F.col("_last.device_id") != F.col("device_id"), F.col("_last")))
    w = w.withColumn("_other", F.last("_turn", ignorenulls=True).over(order))  # what came before this run of one device
    theirs = F.when(F.col("_other.seq") > F.col("base_seq"), F.col("_other.manifest"))
    b = u.select("project_id", "path", F.col("seq").alias("base_seq"), F.col("manifest").alias("base_manifest"))
    j = w.withColumn("theirs_manifest", theirs).join(b, ["project_id", "path", "base_seq"], "left").withColumn("base_manifest", F.when(F.col("base_seq") < F.col("seq"), F.col("base_manifest")))
    return j.where("base_manifest is not null or theirs_manifest is not null").select("project_id", "path", "seq", "base_manifest", "theirs_manifest")


def ref_swaps(attempts: DataFrame) -> DataFrame:
    """Compare-and-swap of a ref (ref, attempt, expected): accepted if the expected version is the number of accepted swaps before it."""

    def begin():
        version = 0

        def swap(attempt: int, expected: int) -> tuple:
            nonlocal version
            fine = expected == version
            version += fine
            return expected, fine, version

        return swap

    return runs.fold(attempts, ["ref"], ["attempt"], ["expected"], begin, "expected long, accepted boolean, version long")


def online_accept(entries: DataFrame) -> DataFrame:
    """Sequential acceptance: an append is rejected if an accepted one of another device on its path came after its base.

    A path's state is its last accepted entry, and the last one of any other device than that one's.
    """

    def begin():
        last, device, other = None, None, None

        def accept(seq: int, dev: int, base: int) -> tuple:
            nonlocal last, device, other
            rival = other if dev == device else last
            fine = rival is None or rival <= base
            if fine:
                if dev != device:
                    other = last
                last, device = seq, dev
            return (fine,)

        return accept

    return runs.fold(entries.where("kind <> 'state_record'"), ["project_id", "path"], ["seq"], ["device_id", "base_seq"], begin, "accepted boolean")


def foreign(journal: DataFrame, device: int, after: int) -> DataFrame:
    """The entries of other devices after a cursor, each with the project's next cursor, which own entries advance too."""
    new = journal.where(F.col("seq") > after)
    cursor = new.groupBy("project_id").agg(F.max("seq").alias("cursor"))
    return new.where(F.col("device_id") != device).join(cursor, "project_id")


def cursors(moves: DataFrame) -> DataFrame:
    """The cursor of each device (project_id, device_id, cursor, at): the last one written, even if it is behind an earlier one."""
    return moves.groupBy("project_id", "device_id").agg(F.max_by("cursor", "at").alias("cursor"))


def snapshot_commit(journal: DataFrame, now_ms: int, most: int = 5_000, age_ms: int = 86_400_000) -> DataFrame:
    """(project_id, snapshot_seq, paths, tree, trigger): the commit that a fold of the whole journal makes.

    The tree is the digest of 256 digests, each over the present paths whose own digest begins alike, in
    order; so no project's tree meets in one value. The fold is due by size, then by the age of the oldest entry, else on demand.
    """
    tree = fold(journal).where("state = 'present'").withColumn("_part", F.substring(F.sha2("path", 256), 1, 2))
    line = F.concat_ws("|", "path", "manifest", F.col("size").cast("string"))
    part = tree.groupBy("project_id", "_part").agg(F.array_sort(F.collect_list(line)).alias("_lines"), F.count("*").alias("_n"))
    part = part.select("project_id", "_part", "_n", F.sha2(F.array_join("_lines", "\n"), 256).alias("_digest"))
    top = part.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("_part", "_digest"))).alias("_parts"), F.sum("_n").alias("paths"))
    top = top.select("project_id", "paths", F.sha2(F.array_join(F.transform("_parts", lambda x: F.concat(x["_part"], x["_digest"])), "\n"), 256).alias("tree"))
    mark = journal.groupBy("project_id").agg(F.max("seq").alias("snapshot_seq"), F.count("*").alias("_n"), F.min("server_ms").alias("_old"))
    why = F.when(F.col("_n") > most, "entries").when(F.lit(now_ms) - F.col("_old") > age_ms, "age").otherwise("demand")
    return mark.join(top, "project_id", "left").select("project_id", "snapshot_seq", F.coalesce("paths", F.lit(0)).alias("paths"), "tree", why.alias("trigger"))


def outbox(pending: DataFrame, permits: int = 4, retries: int = 5) -> DataFrame:
    """The entries to send next (path, seq, tries): the first of each path, of the ``permits`` paths that wait longest; a path whose first entry has used up its retries waits."""
    head = pending.groupBy("path").agg(F.min_by(F.struct("seq", "tries"), "seq").alias("h")).select("path", "h.*")
    return head.where(F.col("tries") < retries).orderBy("seq", "path").limit(permits)
