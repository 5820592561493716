"""Operators over chunk stores, manifests and file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.scratch import saved

DAY_MS = 86_400_000


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted hashes (hash) that the store does not hold; Spark adds its own runtime Bloom filter where it pays."""
    return wanted.distinct().join(present.select("hash"), "hash", "left_anti")


def gc_report(chunks: DataFrame, live: DataFrame, now_ms: int, grace_ms: int, shadow: bool) -> DataFrame:
    """(hash, decision) of a sweep over chunks (hash, state, last_touched) with live chunks (chunk).

    A live chunk that is already being deleted is a violation; a dead one is deleted after the grace
    unless this is a shadow pass, and otherwise marked.
    """
    l = live.select(F.col("chunk").alias("hash"), F.lit(True).alias("_live"))
    deleting = F.col("state") == "deleting"
    old = F.lit(now_ms) - F.col("last_touched") >= grace_ms
    what = F.when(F.col("_live") & deleting, "violation").when(F.col("_live"), "keep").when(deleting & old & F.lit(not shadow), "delete").when(deleting & F.lit(shadow), "would_delete").when(deleting, "wait").otherwise("mark")
    return chunks.join(l, "hash", "left").withColumn("_live", F.coalesce("_live", F.lit(False))).select("hash", "size", what.alias("decision"))


#: Rows of a range in :func:`prefix_until`, about.
RANGE_ROWS = 200_000


def prefix_until(rows: DataFrame, order: list, size: str, group: list[str]) -> DataFrame:
    """Each row with ``before``: the sum of ``size`` over the rows of its group that come before it in ``order``.

    Rows are dealt into ranges of the order by sampled quantiles, as many as their number asks for, and
    written with their range; then come totals of ranges, and a window inside each range. A skewed
    order makes no large range, as the last column of the order tells ties apart. Rows of one range
    need no totals.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    if parts == 1:
        whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
        return rows.withColumn("before", F.sum(size).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    r = saved(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()))
    totals = r.groupBy(*group, "_range").agg(F.sum(size).alias("_total"))
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range")  # a row for each range
    totals = totals.withColumn("_base", F.sum("_total").over(w) - F.col("_total")).drop("_total")
    inner = Window.partitionBy(*group, "_range").orderBy(*order)
    r = r.join(totals, [*group, "_range"])
    return r.withColumn("before", F.col("_base") + F.sum(size).over(inner) - F.col(size)).drop("_range", "_base")


def numbered(rows: DataFrame, order: list, group: list[str], name: str) -> DataFrame:
    """Each row with its place, from 0, in the order of its group; a group may have all rows."""
    return prefix_until(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", group).withColumnRenamed("before", name).drop("_one")


def rotating_sample(rows: DataFrame, group: str, order: list, start: int, size: int) -> DataFrame:
    """``size`` rows of each group from place ``start`` on, round its end."""
    placed = numbered(rows, order, [group], "_i")
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    i, many = F.col("_i"), F.col("_n")
    return placed.join(n, group).where((i - F.lit(start) % many + many) % many < size).drop("_i", "_n")


def lru_evict(blobs: DataFrame, target: int, untouched_since: int | None = None) -> DataFrame:
    """Unpinned blobs (hash, size, last_touched, pinned) to evict, oldest first, until at most ``target`` bytes are live.

    Those touched after ``untouched_since`` are in use and stay, even if more than the target is left.
    """
    live = blobs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    old = F.lit(True) if untouched_since is None else F.col("last_touched") <= untouched_since
    free = prefix_until(blobs.where("not pinned").where(old), ["last_touched", "hash"], "size", [])
    return free.where(F.lit(live) - F.col("before") > target).select("hash", "size", "last_touched")


def pack_prefix(objects: DataFrame, target: int, overhead: int = 36, header: int = 9) -> DataFrame:
    """The first objects (hash, size) by hash that fit in one pack: header + sum(size + overhead) <= target, up to the first overflow."""
    o = prefix_until(objects.withColumn("_cost", F.col("size") + overhead), ["hash"], "_cost", [])
    return o.where(F.col("before") + F.col("_cost") + header <= target).select("hash", "size", F.col("before").alias("offset"))


def reuse(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Per key the share of a version's bytes and chunks that the previous version (key, chunk) also has; 1.0 when empty."""
    p = previous.select(*key, "chunk").distinct().withColumn("_seen", F.lit(1))
    j = current.join(p, [*key, "chunk"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    total = F.sum("len")
    return j.groupBy(*key).agg(F.when(total > 0, F.sum(F.col("len") * F.col("_seen")) / total).otherwise(F.lit(1.0)).alias("byte_reuse"), (F.sum("_seen") / F.count("*")).alias("chunk_reuse"), (F.count("*") - F.sum("_seen")).alias("delta_chunks"), F.count("*").alias("n_chunks"))


def daily_activity(rows: DataFrame, cutoff_ms: int, offset_min: int) -> DataFrame:
    """(day_start_ms, bytes, files) by the caller's day; the day is a floor, so times before 1970 fall in the right one."""
    off = offset_min * 60_000
    day = (F.floor((F.col("mtime") - off) / DAY_MS) * DAY_MS + off).cast("long")
    return rows.where(F.col("mtime") >= cutoff_ms).groupBy(day.alias("day_start_ms")).agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def metering(tenants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored bytes of every tenant; one without chunks has 0."""
    by = chunks.groupBy("tenant").agg(F.sum("size").alias("stored"), F.count("*").alias("n_chunks"))
    return tenants.join(by, "tenant", "left").na.fill(0, ["stored", "n_chunks"])


def reconcile(disk: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, change): a scan against known rows: new, changed, gone or unchanged; a known path of another mode has changed."""
    d, r = disk.alias("d"), rows.alias("r")
    same = (F.col("d.mode") == F.col("r.mode")) & (F.col("d.size") == F.col("r.size")) & (F.col("d.mtime") == F.col("r.mtime")) & F.col("r.local_state").isin("synced", "clean", "pinned")
    what = F.when(F.col("r.path").isNull(), "new").when(F.col("d.path").isNull(), "gone").when(same, "unchanged").otherwise("dirty")
    return d.join(r, F.col("d.path") == F.col("r.path"), "full").select(F.coalesce("d.path", "r.path").alias("path"), what.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert-or-update by key: of rows with one key that with the greatest version stays, incoming before current on a tie."""
    rows = current.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    rest = [c for c in current.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_in")).alias("r")).select(*key, "r.*")


def insert_ignore(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Append the incoming rows whose key is not there yet."""
    return current.unionByName(incoming.join(current.select(*key), key, "left_anti").dropDuplicates(key))


def bloom_size(n: F.Column, p: F.Column) -> tuple[F.Column, F.Column]:
    """(bits, hashes) of a Bloom filter: m = -n ln p / ln(2)^2, k = ceil(m / n ln 2) held in [1, 16]."""
    m = F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), 2))
    return m, F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(m / n * F.log(F.lit(2.0))))).cast("int")


def recall_progress(chunks: DataFrame, elapsed_ms: int) -> DataFrame:
    """Progress of bringing archived chunks back, by hash: share done after each and the time still expected."""
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    c = prefix_until(chunks, ["hash"], "size", [])
    share = (F.col("before") + F.col("size")) / F.lit(float(total or 1))
    return c.select("hash", F.round(share, 9).alias("progress"), F.round(F.lit(float(elapsed_ms)) / share - elapsed_ms, 3).alias("eta_ms"))


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The row of a key; the conditions reach the scan."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.limit(1)


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose key begins so, in order; the scan prunes by it."""
    return rows.where(F.col(column).startswith(prefix)).orderBy(column)


def in_project(files: DataFrame, project: str) -> DataFrame:
    """A project's files in path order."""
    return files.where(F.col("project_id") == project).orderBy("path")


def to_recall(chunks: DataFrame, only: int | None = None) -> DataFrame:
    """The archived chunks to bring back, or that one of them."""
    archived = chunks.where("tier = 'archive'")
    return archived if only is None else archived.where(F.col("hash") == only)


def bloom(hashes: DataFrame, bits: int, probes: int) -> DataFrame:
    """(word, bits): the words of 32 bits of a Bloom filter over hashes (hash), those without a bit left out.

    Places come from a digest, eight hexadecimal digits for each probe (eight at most).
    """
    digest = F.sha2(F.col("hash").cast("string"), 256)
    places = F.array_distinct(F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % bits for i in range(probes))))
    at = hashes.select(F.explode(places).alias("at")).distinct()
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))


def rehash(known: DataFrame, found: DataFrame) -> DataFrame:
    """(manifest, same): whether a file (manifest, idx, chunk) was read again with the same chunks in the same order.

    Chunks meet by their place, so no file's list is gathered.
    """
    k, f = known.select("manifest", "idx", F.col("chunk").alias("a")), found.select("manifest", "idx", F.col("chunk").alias("b"))
    return k.join(f, ["manifest", "idx"], "full").groupBy("manifest").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def guarded(commits: DataFrame, epochs: DataFrame) -> DataFrame:
    """Whether each commit (id, began, ends) may land: no epoch change (at) fell between its begin and its end.

    Begins, ends and changes are one ordered stream; the last change before each is carried along, range by range.
    """
    marks = commits.select("id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("began").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("ends").alias("at")))).alias("m")).select("id", "m.*")
    stream = marks.unionByName(epochs.select(F.lit(None).cast("long").alias("id"), F.lit(-1).alias("kind"), "at")).withColumn("one", F.when(F.col("kind") < 0, 1).otherwise(0))
    counted = prefix_until(stream, ["at", "kind", "id"], "one", [])  # the epoch of a moment is the number of changes up to it
    return counted.where("id is not null").groupBy("id").agg((F.min("before") == F.max("before")).alias("lands"))


def mark(refs: DataFrame, commits: DataFrame, trash: DataFrame, sessions: DataFrame, holds: DataFrame, now_ms: int, entries: DataFrame) -> DataFrame:
    """Chunks that must stay: of the manifests in the trees of refs' commits, of the trash, of open sessions and of held paths.

    refs (commit), commits (commit, manifest), trash (manifest), sessions (manifest, expires_at, complete),
    holds (key, manifest, at, op), entries (manifest, chunk). A session counts while it is not complete and
    ended at most seven days ago; a hold counts if the last operation on its key is an upsert.
    """
    tree = commits.join(refs.select("commit").distinct(), "commit", "left_semi").select("manifest")
    open_ = sessions.where(~F.col("complete") & (F.col("expires_at") > now_ms - 7 * DAY_MS)).select("manifest")
    held = holds.groupBy("key").agg(F.max_by(F.struct("op", "manifest"), "at").alias("l")).where("l.op = 'upsert'").select("l.manifest")
    roots = tree.unionByName(trash.select("manifest")).unionByName(open_).unionByName(held).distinct()
    return entries.join(roots, "manifest", "left_semi").select("chunk").distinct()


def peers(candidates: DataFrame) -> DataFrame:
    """(chunk, peer): of the peers (chunk, peer, load) that may hold a chunk the least loaded; ties take turns by chunk."""
    turn = F.pmod(F.col("peer") + F.col("chunk"), F.lit(97))
    return candidates.groupBy("chunk").agg(F.min_by("peer", F.struct("load", turn.alias("turn"), "peer")).alias("peer"))
