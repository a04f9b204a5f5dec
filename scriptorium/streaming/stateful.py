"""Keyed state with event-time timers: silence of runs and throttled diagnostics.

Both cut the events of a key into episodes, which end when nothing came for ``gap``.  An episode ends by a timer while the
stream goes on, or by the key's next event if that comes first; late events, behind the watermark, change nothing.  State
is a few numbers for each key that had an event within ``gap``.  Runs have a timer each; diagnostics have many more keys, which
lie in buckets and are cut together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "10 minutes"
#: Groups of keys of ``throttled_episodes``: a call and a state for each, so that keys cost no calls of their own.
BUCKETS = 512


class Episodes(StatefulProcessor):
    """What both have in common: the count and the last time of the episode that is open, and its timer."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, last long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, last, timer = self.open.get() or (0, None, None)
        out = []
        for at, event in sorted((r.at, r.event_id) for r in rows):
            if last is not None and at - last > self.gap:
                out += self.ended(n, last)
                n = 0
            n, last = n + 1, at if last is None else max(at, last)
            out += self.came(n, event)
        # In milliseconds, after the last moment at which the next event would still belong to the episode.
        expiry = (last + self.gap) // 1000 + 1
        if timer != expiry:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expiry)
        self.open.update((n, last, expiry))
        yield from (self.row(key, *o) for o in out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        out = self.ended(*self.open.get()[:2])
        self.open.clear()
        yield from (self.row(key, *o) for o in out)

    def close(self) -> None:
        pass


class Silence(Episodes):
    """One row for each episode that ended: since when the run is silent, and how many events came before."""

    def came(self, n: int, event: int) -> list[tuple]:
        return []

    def ended(self, n: int, last: int) -> list[tuple]:
        return [(last, n)]

    def row(self, key, last: int, n: int) -> Row:
        return Row(run_id=key[0], silent_since=last, n=n)


#: A key, with a bit in ``nulls`` for each part that is null, and its open episode: its events and the time of the last.
KEY = {"run_id": "int64", "stage_id": "int64", "event_name": "object", "nulls": "int64"}
OPEN = "run_ids array<long>, stage_ids array<long>, event_names array<string>, nulls array<long>, n array<long>, last array<long>"


def _throttle(gap: int, first: int) -> Callable:
    """Cuts the events of a bucket's keys into episodes: the ``first`` of each as they come, and the totals of those that end."""

    def step(bucket, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *held, held_n, held_last = state.get if state.exists else [[]] * 6
        rows = [] if state.hasTimedOut else [b for b in batches if len(b)]
        keys = pd.concat([pd.DataFrame({c: pd.Series(v, dtype=t) for (c, t), v in zip(KEY.items(), held)}), *[b[[*KEY]] for b in rows]], ignore_index=True)
        code = keys.groupby([*KEY], sort=False).ngroup().to_numpy()
        keys = keys.iloc[np.unique(code, return_index=True)[1]]  # by code; those with an open episode come first
        n, last = np.zeros(len(keys), "int64"), np.full(len(keys), -(2**62))
        n[: len(held_n)], last[: len(held_n)] = held_n, held_last
        out = []  # (codes, whether they are totals, n, event_id)
        if rows:
            k, at, event = code[len(held_n) :], *(np.concatenate([b[c].to_numpy() for b in rows]) for c in ("at", "event_id"))
            order = np.lexsort((event, at, k))
            k, at, event = k[order], at[order], event[order]
            fresh = np.r_[True, k[1:] != k[:-1]]
            before = np.where(fresh, last[k], np.maximum(np.r_[at[0], at[:-1]], last[k]))
            later = (~fresh | (n[k] > 0)) & (at - before > gap)
            starts = np.flatnonzero(fresh | later)
            of, ends = k[starts], np.r_[starts[1:], len(k)]
            goes_on = np.where(later[starts], 0, n[of])  # events before these of the episode that was open
            nth = np.arange(len(k)) + np.repeat(goes_on - starts + 1, ends - starts)
            out.append((k[nth <= first], False, nth[nth <= first], event[nth <= first]))
            broken, size, newest = of[fresh[starts] & later[starts]], ends - starts + goes_on, np.r_[of[1:] != of[:-1], True]
            out += [(broken, True, n[broken], -1), (of[~newest], True, size[~newest], -1)]
            n[of[newest]], last[of[newest]] = size[newest], np.maximum(at[ends[newest] - 1], last[of[newest]])
        over = last + gap < state.getCurrentWatermarkMs() * 1000
        out.append((np.flatnonzero(over), True, n[over], -1))
        told = [keys.iloc[c].assign(total=total, n=m, event_id=e) for c, total, m, e in out if len(c)]
        if told:
            yield pd.concat(told)
        if over.all():
            if state.exists:
                state.remove()
            return
        state.update((*[keys[c].to_numpy()[~over].tolist() for c in KEY], n[~over].tolist(), last[~over].tolist()))
        state.setTimeoutTimestamp(int(last[~over].min() + gap) // 1000)  # it is over once the watermark is beyond this

    return step


def _with_state(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Times are microseconds there, so that no time zone of a worker matters.
    timed = events.withWatermark("occurred_at", late).withColumn("at", F.unix_micros("occurred_at"))
    return timed.groupBy(*keys).transformWithState(processor, schema, "Append", "eventTime")


def silences(events: DataFrame, gap_seconds: int = 3600, late: str = LATE) -> DataFrame:
    """(run_id, silent_since, n): a row as soon as the watermark tells that a run had no event for ``gap_seconds``.

    ``events`` has run_id long, event_id long and occurred_at timestamp."""
    found = _with_state(events, ["run_id"], Silence(gap_seconds), "run_id long, silent_since long, n long", late)
    return found.withColumn("silent_since", F.timestamp_micros("silent_since"))


def throttled_episodes(events: DataFrame, gap_seconds: int = 6 * 3600, first: int = 3, late: str = LATE) -> DataFrame:
    """(run_id, stage_id, event_name, kind, n, event_id): the first diagnostics of every key as ``sample`` number n, and when
    none came for ``gap_seconds`` their ``total``, with event_id -1; the next one begins anew."""
    names = ["run_id", "stage_id", "event_name"]
    nulls = sum((F.col(c).isNull().cast("long") * 2**i for i, c in enumerate(names)), F.lit(0))
    whole = [F.coalesce(c, F.lit("" if c == "event_name" else 0)).alias(c) for c in names]  # no null makes fractions of numbers
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).alias("bucket")
    # Times are microseconds there, so that no time zone of a worker matters.
    timed = events.withWatermark("occurred_at", late).select(bucket, *whole, nulls.alias("nulls"), F.unix_micros("occurred_at").alias("at"), "event_id", "occurred_at")
    rows = "run_id long, stage_id long, event_name string, nulls long, total boolean, n long, event_id long"
    found = timed.groupBy("bucket").applyInPandasWithState(_throttle(gap_seconds * 1_000_000, first), rows, OPEN, "append", "EventTimeTimeout")
    key = [F.when(F.col("nulls").bitwiseAND(F.lit(2**i)) == 0, F.col(c)).alias(c) for i, c in enumerate(names)]
    return found.select(*key, F.when(F.col("total"), "total").otherwise("sample").alias("kind"), "n", "event_id")
