"""Streams whose results depend on the order of event time and on nothing else, with timers and state that ends.

Events of a key wait until the watermark has passed them and are then handed to a rule in their order, so a
stream gives the rows of its batch twin however its micro-batches were dealt. A rule says with each event
until when its state matters; when event time gets there first, the state is closed and removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.workers import by_value

by_value(__name__)

#: The state store that these streams need; set it for the session before a query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


class Rule:
    """What becomes of a key's events (ms, event_id, text), taken in order of ms, then event_id."""

    #: Columns of a result behind the key, and of the state.
    out: str
    state: str

    def event(self, state: tuple | None, ms: int, event_id: int, text: str | None) -> tuple[tuple, list[tuple], int]:
        """The new state, results, and the ms at which the state is closed if no event changes that."""
        raise NotImplementedError

    def closed(self, state: tuple) -> list[tuple]:
        """Results of a state whose time has come."""
        return []


@dataclass
class Limit(Rule):
    """At most ``budget`` events in a window of ``window_ms`` that opens with the first event after the last one closed; rejected ones don't count."""

    budget: int
    window_ms: int
    out = "event_id long, allowed boolean"
    state = "start long, used long"

    def event(self, state, ms, event_id, text):
        start, used = state or (ms, 0)
        fine = used < self.budget
        return (start, used + fine), [(event_id, fine)], start + self.window_ms


@dataclass
class Burst(Rule):
    """One row for each burst of events that are at most ``quiet_ms`` apart."""

    quiet_ms: int
    out = "settled_ms long, events long"
    state = "last long, events long"

    def event(self, state, ms, event_id, text):
        return (ms, (state[1] if state else 0) + 1), [], ms + self.quiet_ms + 1

    def closed(self, state):
        return [(state[0] + self.quiet_ms, state[1])]


@dataclass
class Presence(Rule):
    """The last event of a peer, and a row without it once ``ttl_ms`` have gone by."""

    ttl_ms: int
    out = "ms long, event_type string, here boolean"
    state = "ms long, event_type string"

    def event(self, state, ms, event_id, text):
        return (ms, text), [(ms, text, True)], ms + self.ttl_ms

    def closed(self, state):
        return [(state[0] + self.ttl_ms, state[1], False)]


class _InOrder(StatefulProcessor):
    """Holds a key's events back until the watermark has passed them, and runs its rule on them."""

    def __init__(self, rule: Rule, names: list[str]):
        self.rule, self.names = rule, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, event_id long", "text string")
        self.held = handle.getValueState("held", f"{self.rule.state}, until long")
        self.armed = handle.getValueState("armed", "at long")

    def _arm(self, at: int, now: int) -> None:
        """A timer at ``at`` unless an earlier one is set."""
        set_ = self.armed.get()[0] if self.armed.exists() else None
        if set_ is None or at < set_ or set_ <= now:
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r.ms, r.event_id), (r.text,))
            first = r.ms if first is None else min(first, r.ms)
        if first is not None:
            self._arm(first, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = tuple(self.held.get()) if self.held.exists() else None
        ready, later = [], None
        for (ms, event_id), (text,) in ((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            if ms <= now:
                ready.append((ms, event_id, text))
            else:
                later = ms if later is None else min(later, ms)
        out: list[tuple] = []

        def close_until(ms: int):
            nonlocal held
            if held is not None and held[-1] <= ms:
                out.extend(self.rule.closed(held[:-1]))
                held = None

        for ms, event_id, text in sorted(ready, key=lambda e: e[:2]):
            close_until(ms)
            state, said, until = self.rule.event(held and held[:-1], ms, event_id, text)
            out.extend(said)
            held = (*state, until)
            self.waiting.removeKey((ms, event_id))
        close_until(now)
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        self.armed.clear()
        ahead = [t for t in (later, held and held[-1]) if t is not None]
        if ahead:
            self._arm(min(ahead), now)
        key = tuple(key)
        return iter([Row(**dict(zip(self.names, (*key, *row)))) for row in out])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, rule: Rule, key: str, delay: str, text: str | None = None) -> DataFrame:
    """(key, ...) the results of a rule over events (key, ms, event_id) of a stream, as they would be in order.

    ``delay`` is how late an event may come; later ones are left out. What waits is one ``delay`` of a key's events, and a key
    without events or open state keeps nothing. An event that comes again while it waits counts once. Rows with a null key, ms or
    event_id are left out. The session must use :data:`STORE`.
    """
    kind = stream.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in rule.out.split(", "))]
    rows = stream.where(F.col(key).isNotNull() & F.col("ms").isNotNull() & F.col("event_id").isNotNull())
    rows = rows.select(F.col(key), F.col("ms").cast("long").alias("ms"), F.col("event_id").cast("long").alias("event_id"), (F.col(text).cast("string") if text else F.lit(None).cast("string")).alias("text"), F.timestamp_millis("ms").alias("_at"))
    return rows.withWatermark("_at", delay).groupBy(key).transformWithState(_InOrder(rule, names), f"{key} {kind}, {rule.out}", "Append", "EventTime")


def rate_limit(stream: DataFrame, budget: int, window_ms: int, delay: str) -> DataFrame:
    """(user_id, event_id, allowed); a closed window keeps no state."""
    return in_order(stream, Limit(budget, window_ms), "user_id", delay)


def debounce(stream: DataFrame, quiet_ms: int, delay: str) -> DataFrame:
    """(path, settled_ms, events), one row a burst, given out when event time has passed its quiet."""
    return in_order(stream, Burst(quiet_ms), "path", delay)


def presence(stream: DataFrame, ttl_ms: int, delay: str) -> DataFrame:
    """(user_id, ms, event_type, here): each event of a peer in order, and when it is gone; the last row of a peer tells how it is."""
    return in_order(stream, Presence(ttl_ms), "user_id", delay, "event_type")
