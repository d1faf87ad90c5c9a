"""Keyed state in event-time order: the candidate pool with its time to live, the circuit breaker, the fold of an item's events.

Events may come in any order. Pool and breaker hold them until the watermark has passed them, take them in order of ``(ts, ord)``
and then emit; an event-time timer wakes a key when its next event is due or its state has run out, and state that has run out is
dropped. What comes later than the watermark is dropped before it gets here. So results do not depend on how events are cut into
batches, and each has a batch twin: ``pool_batch``, ``breaker_batch`` and ``folds`` itself, which is a session window and says the same on both.
A key's events of one watermark delay are held in its state, and are one piece of work; the breaker holds only those that can matter (``thinned``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bidloom.operators.analytics import TRIPS

#: Days that a search's candidates may be used again.
TTL_DAYS = 7
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start here keep their state in RocksDB, which lists and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Holds events ``(ts_us, ord, status)`` of a key until the watermark has passed them. What follows of them is said by ``step``,
    ``ends`` and ``ended`` on a plain tuple, the key's state. ``held``: its columns; ``out``: the columns of what is emitted."""

    held = ""
    out: tuple[str, ...] = ()

    def step(self, key: tuple, state: tuple | None, ts: int, ord_: int, status: str, emit: list) -> tuple | None:
        raise NotImplementedError

    def thinned(self, events: list[tuple]) -> list[tuple]:
        """Of events that came together those that are held: all, unless some can change nothing beside the others."""
        return events

    def ends(self, state: tuple) -> int:
        """The microsecond after which the state holds no more."""
        raise NotImplementedError

    def ended(self, key: tuple, state: tuple, emit: list) -> None:
        """Called before a state that has run out is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts_us long, ord long, status string")
        self.state = handle.getValueState("state", self.held)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for p in rows:
            own = self.thinned(list(zip(p["ts_us"].tolist(), p["ord"].tolist(), p["status"].tolist(), strict=True)))
            if own:
                self.pending.appendList(own)
                low = min(x[0] for x in own)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        due = [x for x in events if x[0] <= now]
        state = tuple(self.state.get()) if self.state.exists() else None
        emit: list[tuple] = []
        for ts, ord_, status in due:
            if state is not None and ts > self.ends(state):
                self.ended(key, state, emit)
                state = None
            state = self.step(key, state, ts, ord_, status, emit)
        if state is not None and now > self.ends(state):
            self.ended(key, state, emit)
            state = None
        rest = events[len(due) :]
        (self.pending.put(rest) if rest else self.pending.clear()) if due else None
        self.state.update(state) if state is not None else self.state.clear()
        wake = [-(-rest[0][0] // 1000)] if rest else []
        if state is not None:
            wake.append(self.ends(state) // 1000 + 1)
        if wake:
            self.handle.registerTimer(max(min(wake), now // 1000 + 1))
        if emit:
            yield pd.DataFrame([(*key, *r) for r in emit], columns=list(self.out), dtype=object)

    def close(self) -> None:
        pass


class Pool(InOrder):
    """State: when candidates were put, and how often they were found since."""

    held, out = "put_us long, hits long", ("platform", "query", "kind", "ts_us", "ord", "age_us", "hits")

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def step(self, key, state, ts, ord_, status, emit):
        if status == "ok":
            if state is not None:
                self.ended(key, state, emit)
            return ts, 0
        if state is None:
            emit.append(("miss", ts, ord_, None, None))
            return None
        emit.append(("hit", ts, ord_, ts - state[0], state[1] + 1))
        return state[0], state[1] + 1

    def ends(self, state):
        return state[0] + self.ttl

    def ended(self, key, state, emit):
        emit.append(("entry", state[0], None, None, state[1]))


class Breaker(InOrder):
    """State: the last event, and whether the platform has tripped in this session."""

    held, out = "last_us long, tripped boolean", ("platform", "ts_us", "ord", "reason")

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def thinned(self, events):
        """Events of one stretch of ``gap`` lie in one session: its first and last event and its first trip say all that the others could."""
        if self.gap <= 0:
            return events
        kept: dict[tuple, tuple] = {}
        trips: dict[str | None, bool] = {}
        for x in events:
            at, status = x[0] // self.gap, x[2]
            if (at, "first") not in kept or x[0] < kept[at, "first"][0]:
                kept[at, "first"] = x
            if (at, "last") not in kept or x[0] > kept[at, "last"][0]:
                kept[at, "last"] = x
            if status not in trips:
                trips[status] = any(t in (status or "").lower() for t in TRIPS)
            if trips[status] and ((at, "trip") not in kept or x < kept[at, "trip"]):
                kept[at, "trip"] = x
        return list(dict.fromkeys(kept.values()))

    def step(self, key, state, ts, ord_, status, emit):
        tripped = state is not None and state[1]
        low = (status or "").lower()
        if not tripped and any(t in low for t in TRIPS):
            emit.append((ts, ord_, low))
            tripped = True
        return ts, tripped

    def ends(self, state):
        return state[0] + self.gap


def _micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def _when(c: str) -> Column:
    return F.timestamp_micros(c)


def pool(events: DataFrame, ttl_days: float = TTL_DAYS, late: str = "1 hour") -> DataFrame:
    """A stream of ``(platform, query, ts, ord, status)``: an ``ok`` puts the search's candidates, anything else looks for them.

    Rows of kind ``hit`` (with the age of what was found and how often it has been found) and ``miss`` are lookups; one of kind ``entry``
    tells, when candidates are replaced or have run out, when they were put and how often they were found. Append mode."""
    own = events.withWatermark("ts", late).select("platform", F.lower("query").alias("query"), "ts", _micros("ts").alias("ts_us"), "ord", "status")
    made = own.groupBy("platform", "query").transformWithStateInPandas(
        Pool(int(ttl_days * 86_400_000_000)), "platform string, query string, kind string, ts_us long, ord long, age_us long, hits long", "Append", "EventTime"
    )
    return made.select("platform", "query", "kind", _when("ts_us").alias("ts"), "ord", "age_us", "hits")


def pool_batch(events: DataFrame, ttl_days: float = TTL_DAYS) -> DataFrame:
    """What ``pool`` gives of events that are all there: the last put before a lookup by a window over the events of a search."""
    ttl = int(ttl_days * 86_400_000_000)
    own = events.select("platform", F.lower("query").alias("query"), "ts", "ord", (F.col("status") == "ok").alias("put"), _micros("ts").alias("us"))
    search = W.partitionBy("platform", "query").orderBy("ts", "ord")
    own = own.withColumn("no", F.count(F.when(F.col("put"), 1)).over(search.rowsBetween(W.unboundedPreceding, 0)))
    entry = W.partitionBy("platform", "query", "no")
    own = own.withColumn("put_us", F.min(F.when(F.col("put"), F.col("us"))).over(entry))
    live = ~F.col("put") & F.coalesce(F.col("us") - F.col("put_us") <= ttl, F.lit(False))
    own = own.withColumn("live", live).withColumn("hits", F.count(F.when(F.col("live"), 1)).over(search.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("hits", F.col("hits") - F.min("hits").over(entry))
    looked = own.where(~F.col("put")).select(
        "platform", "query", F.when(F.col("live"), "hit").otherwise("miss").alias("kind"), "ts", "ord",
        F.when(F.col("live"), F.col("us") - F.col("put_us")).alias("age_us"), F.when(F.col("live"), F.col("hits")).alias("hits"),
    )
    entries = own.where("no > 0").groupBy("platform", "query", "no").agg(F.min(F.when(F.col("put"), F.col("ts"))).alias("ts"), F.count(F.when(F.col("live"), 1)).alias("hits"))
    none = F.lit(None).cast("long")
    return looked.unionByName(entries.select("platform", "query", F.lit("entry").alias("kind"), "ts", none.alias("ord"), none.alias("age_us"), "hits"))


def breaker(events: DataFrame, gap_hours: float = 6, late: str = "1 hour") -> DataFrame:
    """A stream of ``(platform, ts, ord, status)``: the first trip of each session of a platform, by event time. A session ends after
    ``gap_hours`` without an event; its state is dropped then, and the next one may trip again. Append mode."""
    own = events.withWatermark("ts", late).select("platform", "ts", _micros("ts").alias("ts_us"), "ord", "status")
    made = own.groupBy("platform").transformWithStateInPandas(Breaker(int(gap_hours * 3_600_000_000)), "platform string, ts_us long, ord long, reason string", "Append", "EventTime")
    return made.select("platform", _when("ts_us").alias("ts"), "ord", "reason")


def breaker_batch(events: DataFrame, gap_hours: float = 6) -> DataFrame:
    """What ``breaker`` gives of events that are all there. Sessions are those of a gap between neighbours, found from one row an hour and platform first,
    so that no task sorts the events of a platform."""
    gap = int(gap_hours * 3_600_000_000)
    own = events.select("platform", "ts", "ord", "status", _micros("ts").alias("us"), F.date_trunc("hour", "ts").alias("hour"))
    inner = W.partitionBy("platform", "hour").orderBy("us", "ord")
    own = own.withColumn("breaks", (F.col("us") - F.lag("us").over(inner) > gap).cast("int"))
    own = own.withColumn("inside", F.coalesce(F.sum("breaks").over(inner.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    hours = own.groupBy("platform", "hour").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("inside").alias("breaks"))
    outer = W.partitionBy("platform").orderBy("hour")
    step = F.when(F.col("first") - F.lag("last").over(outer) > gap, 1).otherwise(0) + F.coalesce(F.lag("breaks").over(outer), F.lit(0))
    hours = hours.withColumn("step", step).withColumn("session", F.sum("step").over(outer.rowsBetween(W.unboundedPreceding, 0)))
    trips = own.where(F.lower("status").rlike("|".join(TRIPS))).join(hours.select("platform", "hour", "session"), ["platform", "hour"])
    first = trips.groupBy("platform", (F.col("session") + F.col("inside")).alias("session")).agg(F.min(F.struct("ts", "ord", F.lower("status").alias("reason"))).alias("e"))
    return first.select("platform", "e.ts", "e.ord", "e.reason")


def folds(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Events ``(item_id, ts, ord, status)`` of each item folded by sessions: the last event, the number of events, first and end.

    On a stream a session is given once, when the watermark has passed its end, and dropped from the state; parts of a session are merged before
    the shuffle where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is set."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    made = own.groupBy("item_id", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "ord", "status")).alias("e"), F.count("*").alias("n_events"))
    return made.select("item_id", F.col("w.start").alias("start"), "e.ts", "e.ord", "e.status", "n_events")
