"""Operators over event streams: feeds, sessions, presence, peaks, percentiles, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import runs
from tesserae.operators.store import prefix_until

# Upper bounds of latency buckets in milliseconds.
BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0]


def newest(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def feed(sources: list[tuple[str, DataFrame, int]], limit: int) -> DataFrame:
    """The newest rows (ts, what, ref) of several feeds, each first cut to its own limit."""
    parts = [df.select(F.lit(kind).alias("kind"), "ts", "ref").orderBy(F.desc("ts"), "ref").limit(n) for kind, df, n in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("ts"), "kind", "ref").limit(limit)


def debounce(events: DataFrame, quiet_ms: int) -> DataFrame:
    """(path, settled_ms, events): one row per burst; a burst ends when the path is quiet for longer than ``quiet_ms``."""
    by = Window.partitionBy("path").orderBy("ms", "event_id")
    gap = F.col("ms") - F.lag("ms").over(by)
    burst = F.sum(F.when(gap.isNull() | (gap > quiet_ms), 1).otherwise(0)).over(by)
    return events.withColumn("_burst", burst).groupBy("path", "_burst").agg((F.max("ms") + quiet_ms).alias("settled_ms"), F.count("*").alias("events")).drop("_burst")


def presence(events: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """The last event of every peer (user_id, ms, event_id, event_type) that is not older than the time to live."""
    last = events.groupBy("user_id").agg(F.max_by(F.struct("ms", "event_type"), F.struct("ms", "event_id")).alias("l")).select("user_id", "l.*")
    return last.where(F.lit(now_ms) - F.col("ms") <= ttl_ms)


def peaks(samples: DataFrame, per_bin: int, bins: int) -> DataFrame:
    """(bin, lo, hi): least and greatest sample (frame, v) of each bin; a bin without samples is 0. Bins are rows, so any number will do."""
    spine = samples.sparkSession.range(bins).select(F.col("id").alias("bin"))
    got = samples.groupBy(F.floor(F.col("frame") / per_bin).alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return spine.join(got, "bin", "left").na.fill(0.0, ["lo", "hi"])


def nearest_rank(rows: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """Exact percentiles without interpolation: the value at round((n - 1) * p) of the sorted values.

    Equal values are counted first. The others are dealt into ranges of (group, value), whose totals tell before which
    row each rank falls, so a group with all rows is as many tasks as it has ranges.
    """
    by = prefix_until(rows.groupBy(group, value).agg(F.count("*").alias("c")), [value], "c", [group])
    n = by.groupBy(group).agg(F.sum("c").alias("n"))
    want = F.explode(F.array(*(F.lit(float(p)) for p in ps)))
    ranks = n.withColumn("p", want).withColumn("_rank", F.floor((F.col("n") - 1) * F.col("p") + 0.5)).drop("n")
    return by.join(ranks, group).where((F.col("_rank") >= F.col("before")) & (F.col("_rank") < F.col("before") + F.col("c"))).select(group, "p", F.col(value).alias("value"))


def histogram_percentile(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """A percentile from counts in fixed logarithmic buckets: the middle of the bucket in which the rank falls."""
    index = F.lit(len(BUCKETS))
    for i in reversed(range(len(BUCKETS))):
        index = F.when(F.col(value) <= BUCKETS[i], F.lit(i)).otherwise(index)
    counts = rows.groupBy(group, index.alias("i")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy("i")
    counts = counts.withColumns({"cum": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    first = counts.where(F.col("cum") >= F.ceil(F.col("n") * F.lit(p))).groupBy(group).agg(F.min("i").alias("i"))
    bounds = F.array(*(F.lit(b) for b in BUCKETS))
    middle = F.element_at(bounds, F.col("i")) / 2 + F.element_at(bounds, F.col("i") + 1) / 2
    return first.select(group, F.when(F.col("i") == 0, BUCKETS[0] / 2).when(F.col("i") < len(BUCKETS), middle).otherwise(BUCKETS[-1] * 2).alias("estimate"))


def rate_limit(events: DataFrame, budget: int, window_ms: int) -> DataFrame:
    """(user_id, event_id, allowed): a window opens at the first event after the last one closed; rejected events don't count."""

    def begin():
        start, used = None, 0

        def limit(ms: int, event_id: int) -> tuple:
            nonlocal start, used
            if start is None or ms - start >= window_ms:
                start, used = ms, 0
            fine = used < budget
            used += fine
            return (fine,)

        return limit

    return runs.fold(events, ["user_id"], ["ms", "event_id"], [], begin, "allowed boolean").select("user_id", "event_id", "allowed")


def touches(events: DataFrame, every_ms: int) -> DataFrame:
    """(user_id, event_id, touched): a key is touched at most once in ``every_ms``, counted from its last touch."""
    return rate_limit(events, 1, every_ms).withColumnRenamed("allowed", "touched")


def aimd(outcomes: DataFrame, least: int = 4, most: int = 64) -> DataFrame:
    """(user_id, event_id, limit): the limit after each outcome (ok): one more after a success, half after a failure."""

    def begin():
        limit = least

        def step(event_id: int, ok: bool) -> tuple:
            nonlocal limit
            limit = min(most, limit + 1) if ok else max(least, limit // 2)
            return (limit,)

        return step

    return runs.fold(outcomes, ["user_id"], ["event_id"], ["ok"], begin, "limit long")


def lease_log(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """(path, ms, event_id, granted, token, expires_at): what each request (path, ms, event_id, device_id, what) gets.

    An acquire is granted if the lease is free, expired or the device's own, and raises the token. A renewal
    and a release need the device's own unexpired lease.
    """

    def begin():
        holder, token, until = None, 0, 0

        def ask(ms: int, event_id: int, device: int, what: str) -> tuple:
            nonlocal holder, token, until
            live = holder is not None and until > ms
            own = live and holder == device
            if what == "acquire":
                fine = own or not live
                if fine:
                    holder, token, until = device, token + 1, ms + ttl_ms
            else:
                fine = own
                if fine and what == "renew":
                    until = ms + ttl_ms
                elif fine:
                    holder, until = None, 0
            return fine, token, until

        return ask

    return runs.fold(requests, ["path"], ["ms", "event_id"], ["device_id", "what"], begin, "granted boolean, token long, expires_at long")


def leaders(bids: DataFrame, ttl_ms: int) -> DataFrame:
    """(job, ms, node, leads): a node leads a job if it already does or the last leader's lease has run out; each bid of a leader prolongs it."""

    def begin():
        holder, until = None, 0

        def bid(ms: int, node: int) -> tuple:
            nonlocal holder, until
            fine = holder == node or until <= ms
            if fine:
                holder, until = node, ms + ttl_ms
            return (fine,)

        return bid

    return runs.fold(bids, ["job"], ["ms", "node"], [], begin, "leads boolean")


def due(timers: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """The timers (key, armed_ms, wait_ms) that fire next, earliest deadline first; arming a key again replaces its deadline."""
    last = timers.groupBy("key").agg(F.max_by(F.col("armed_ms") + F.col("wait_ms"), F.struct("armed_ms", "wait_ms")).alias("deadline"))
    return last.where(F.col("deadline") <= now_ms).orderBy("deadline", "key").limit(limit)


def leases(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """Lease grants (path, device_id, ms, event_id): a token that rises with every grant of a path, and when it ends."""
    w = Window.partitionBy("path").orderBy("ms", "event_id")
    return requests.withColumns({"token": F.row_number().over(w).cast("long"), "expires_at": F.col("ms") + ttl_ms})


def active(grants: DataFrame, now_ms: int) -> DataFrame:
    """The latest grant of each path if it has not expired."""
    return grants.groupBy("path").agg(F.max_by(F.struct("device_id", "token", "expires_at"), "token").alias("l")).select("path", "l.*").where(F.col("expires_at") > now_ms)


def changes_only(states: DataFrame) -> DataFrame:
    """Rows (root, seen_at, state) whose state differs from the one before."""
    before = F.lag("state").over(Window.partitionBy("root").orderBy("seen_at"))
    return states.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("state"))).drop("_before")
