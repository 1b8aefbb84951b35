"""Streams whose rows must be taken in the order of time, though they come late and shuffled.

Rows wait in their key's state until the watermark has passed them; then they are taken in the order of time and event_id, together with
what the key still remembers. A key's state ends when nothing waits and all that it remembers is too old, by a timer of event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def in_order(events: DataFrame, keys: list[str], fold: Callable, out: str, hours: float, late: str) -> DataFrame:
    """What fold gives for the rows of each key, in order. events: ts, event_id, value (boolean) and the keys.

    fold(memory, rows) takes the remembered times and rows (time, event_id, value), all in microseconds, and returns rows (event_id, result) and
    the times to remember; those of ``hours`` ago and before are forgotten.
    """
    names = [c.split()[0] for c in out.split(", ")]
    span = int(hours * HOUR)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, memory = [], []
        if state.exists:
            at, ids, values, memory = state.get
            waiting, memory = list(zip(at, ids, values, strict=True)), list(memory)
        for rows in batches:
            waiting += zip(rows["micros"].tolist(), rows["event_id"].tolist(), rows["value"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [r for r in waiting if r[0] <= passed]
        waiting = waiting[len(ready) :]
        results = []
        if ready:
            results, memory = fold(memory, ready)
        memory = [t for t in memory if t > passed - span]
        if waiting or memory:
            at, ids, values = (list(x) for x in zip(*waiting, strict=True)) if waiting else ([], [], [])
            state.update((at, ids, values, memory))
            due = waiting[0][0] if waiting else max(memory) + span
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if results:
            yield pd.DataFrame([(i, *key, x) for i, x in results], columns=names)

    rows = events.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late).select(*keys, "event_id", "ts", "micros", "value")
    return rows.groupBy(*keys).applyInPandasWithState(run, out, "at array<long>, ids array<long>, flags array<boolean>, memory array<long>", "append", "EventTimeTimeout")


def rolling_counts(events: DataFrame, condition: Column, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """event_id, user_id, n: rows of the user with the condition in the hours up to each row, rows of the same time included; exactly that long ago is out."""
    span = int(hours * HOUR)

    def fold(memory: list, rows: list) -> tuple[list, list]:
        times = sorted([*memory, *(t for t, _, yes in rows if yes)])
        results, low, high = [], 0, 0
        for t, i, _ in rows:
            while high < len(times) and times[high] <= t:
                high += 1
            while low < high and times[low] <= t - span:
                low += 1
            results.append((i, high - low))
        return results, times

    return in_order(events.withColumn("value", condition), ["user_id"], fold, "event_id long, user_id long, n long", hours, late)


def first_within(events: DataFrame, kind: str = "event_type", hours: float = 24, late: str = "1 hour") -> DataFrame:
    """event_id, user_id, kind, accepted: a row is accepted if none of the same user and kind was within the hours before it."""
    span = int(hours * HOUR)

    def fold(memory: list, rows: list) -> tuple[list, list]:
        last, results = memory[-1] if memory else None, []
        for t, i, _ in rows:
            fine = last is None or t - last >= span
            last = t if fine else last
            results.append((i, fine))
        return results, [last]

    return in_order(events.withColumn("value", F.lit(True)), ["user_id", kind], fold, f"event_id long, user_id long, {kind} string, accepted boolean", hours, late)
