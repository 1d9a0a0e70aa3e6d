"""Deliveries as a stream: admission, deduplication with conflicts, and leases in keyed state.

State is one small tuple per key and times out, so it holds what is in flight and not the history.
Rows that arrive together for a key are taken in the order of (at, event_id); across batches, in the
order in which they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """A watermark bounds how late a delivery may be; what is later is dropped by stateful operators."""
    return stream.withWatermark(event_time, delay)


def first_only(stream: DataFrame, key: list[str]) -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(key)


_FIRST = "digest string"


def outcomes(stream: DataFrame, key: str, keep_ms: int | None = None) -> DataFrame:
    """(key, event_id, outcome) of (key, at, event_id, digest): first, duplicate or conflict.

    A key's digest is kept for good, or for keep_ms after its last delivery. Timeouts keep a query busy
    with empty batches, so one that has to end, as with availableNow, takes no keep_ms.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        digest = state.get[0] if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            if digest is None:
                digest, outcome = r.digest, "first"
            else:
                outcome = "duplicate" if r.digest == digest else "conflict"
            out.append((keys[0], r.event_id, outcome))
        state.update((digest,))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=[key, "event_id", "outcome"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, event_id bigint, outcome string", _FIRST, "append",
        GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


_LEASE = "state string, owner string, fence bigint, until bigint, busy bigint, duplicates bigint"


def step(s: tuple, kind: str, owner: str, at: int, lease: int) -> tuple:
    """The state (state, owner, fence, until, busy, duplicates) after one event."""
    state, holder, fence, until, busy, duplicates = s
    if state == "done":
        return state, holder, fence, until, busy, duplicates + 1
    if kind == "claim" and (state == "new" or at >= until):
        return "running", owner, fence + 1, at + lease, busy, duplicates
    if kind == "renew" and state == "running" and owner == holder and at < until:
        return state, holder, fence, at + lease, busy, duplicates
    if kind == "complete" and state == "running" and owner == holder and at < until:
        return "done", holder, fence, until, busy, duplicates
    return state, holder, fence, until, busy + 1, duplicates


def leases(stream: DataFrame, key: str, lease: int) -> DataFrame:
    """State of each key after every batch with events for it (update mode)."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else ("new", None, 0, 0, 0, 0)
        for r in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples(index=False):
            s = step(s, r.kind, r.owner, int(r.at), lease)
        state.update(s)
        yield pd.DataFrame([(keys[0], s[0], s[2], s[4], s[5])], columns=[key, "state", "fence", "busy", "duplicates"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, state string, fence bigint, busy bigint, duplicates bigint", _LEASE, "update", GroupStateTimeout.NoTimeout
    )


def claimed_counts(stream: DataFrame, event_time: str, width: str, delay: str) -> DataFrame:
    """Deliveries per event-time window, complete once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width)).agg(F.count("*").alias("n"))
