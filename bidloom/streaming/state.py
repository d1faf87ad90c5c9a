"""Event folds and circuit breakers on Structured Streaming.

Both keep one small state a key and have a batch twin in ``operators.analytics`` (``latest``, ``breaker_timeline``), with which the
tests compare them. The fold takes events in any order. The breaker reports a platform when it first sees it trip: of one
batch the earliest trip, but an earlier event of a later batch does not take the report back, as what is appended stays; with events
in order of their batches it agrees with its twin. Late events older than the watermark are dropped by the fold of windows only.
Both states are kept for good: there are as many as items or platforms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bidloom.operators.analytics import TRIPS


def latest_by_item(events: DataFrame) -> DataFrame:
    """A stream of ``(item_id, ts, ord, status)`` folded to the last event and the count of each item (update mode)."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ord_, status, n = state.get if state.exists else (pd.Timestamp(0), -1, "", 0)
        for p in parts:
            n += len(p)
            top = p.sort_values(["ts", "ord"]).iloc[-1]
            if (top.ts, top.ord) > (pd.Timestamp(ts), ord_):
                ts, ord_, status = top.ts, int(top.ord), top.status
        state.update((pd.Timestamp(ts).to_pydatetime(), ord_, status, n))
        yield pd.DataFrame({"item_id": [key[0]], "ts": [pd.Timestamp(ts)], "ord": [ord_], "status": [status], "n_events": [n]})

    out = "item_id long, ts timestamp, ord long, status string, n_events long"
    held = "ts timestamp, ord long, status string, n long"
    return events.groupBy("item_id").applyInPandasWithState(fold, out, held, "update", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame) -> DataFrame:
    """A stream of ``(platform, ts, ord, status)``: one row when a platform trips for the first time (append mode)."""

    def trip(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low = None
        for p in parts:
            hit = p[p.status.str.lower().str.contains("|".join(TRIPS), regex=True)]
            if len(hit):
                own = hit.sort_values(["ts", "ord"]).iloc[0]
                low = own if low is None or (own.ts, own.ord) < (low.ts, low.ord) else low
        if low is not None and not state.exists:
            state.update((low.status,))
            yield pd.DataFrame({"platform": [key[0]], "ts": [low.ts], "ord": [int(low.ord)], "reason": [low.status]})

    out = "platform string, ts timestamp, ord long, reason string"
    return events.groupBy("platform").applyInPandasWithState(trip, out, "reason string", "append", GroupStateTimeout.NoTimeout)


def status_windows(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts of statuses in tumbling windows; events later than ``late`` behind the newest are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "status", "n")


def once_by_key(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each (platform, query) once within the watermark: the candidate cache's time to live."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["platform", "query"])
