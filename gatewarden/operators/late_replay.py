"""Event-time aggregates corrected by late rows: checkpoint and replay.

Rows are reduced to deltas (key, event minute, arrival minute, count) before the shuffle, so a key with
a third of all rows arrives as a bounded number of deltas, and each key is split into days that travel
apart. Within a key and day the deltas are taken in arrival order:

* the state is the ordered log of event minutes with their counts, a checkpoint for each hour (the
  running count of the log before it) and the outputs published so far;
* an hour is published once arrivals have passed its end and a grace: the checkpoint before it is
  restored and the log replayed from there;
* a delta of a published hour is late. It enters the log, the checkpoint that precedes its hour is
  restored, the sorted suffix is replayed, and every published output that comes out differently is
  replaced. Corrections are what such a replacement changes: nothing else counts late rows;
* once arrivals are past an hour's cut-off its output is final, and a delta of it is dropped.

The state of a key and day is a row of plain arrays (``STATE``), so it can be written and a later
batch continues from it: see ``HourlyReplay``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.workspace import shuffle_width, stored

#: minutes and counts: the log; saved: per hour 0 the hour, 1 whether published, 2 to 7 as in ``OUT``; water: the latest arrival.
STATE = "key string, day bigint, water bigint, minutes array<bigint>, counts array<bigint>, saved array<bigint>, outs array<bigint>"
OUT = ("hour", "first_count", "final_count", "day_count", "n_late", "n_dropped", "replays")
HOURS = "key string, " + ", ".join(f"{c} bigint" for c in OUT)
_FIRST, _FINAL, _RUNNING, _LATE, _DROPPED, _REPLAYS = range(6)


class ReplayState:
    """Ordered state of one key and day; times are whole minutes."""

    def __init__(self, grace: int, cutoff: int):
        self.grace, self.cutoff = grace, cutoff
        self.water = -(1 << 62)
        self.minutes: list[int] = []  # the log: sorted event minutes
        self.counts: dict[int, int] = {}  # of each minute
        self.checkpoints: dict[int, int] = {}  # hour -> running count of the log before it
        self.outputs: dict[int, list[int]] = {}  # published hours
        self.waiting: list[int] = []  # hours with rows that are not published yet, sorted
        self.dropped: dict[int, int] = {}
        self.dirty: int | None = None  # earliest published hour with rows that its output lacks

    def add(self, minute: int, arrival: int, n: int) -> None:
        """Take the next delta; ``arrival`` never decreases."""
        if arrival > self.water:
            self.settle()
            self.water = arrival
        self._publish(lambda hour: (hour + 1) * 60 + self.grace < self.water)
        hour = minute // 60
        if (hour + 1) * 60 + self.cutoff < self.water:
            self.dropped[hour] = self.dropped.get(hour, 0) + n
            return
        if minute in self.counts:
            self.counts[minute] += n
        else:
            self.counts[minute] = n
            insort(self.minutes, minute)
        if (hour + 1) * 60 + self.grace < self.water:  # published, or would have been
            if hour not in self.outputs:
                self.outputs[hour] = [0, 0, 0, 0, 0, 0]
            self.dirty = hour if self.dirty is None else min(self.dirty, hour)
        elif hour not in self.waiting:
            insort(self.waiting, hour)

    def settle(self) -> None:
        """Replay what the late deltas of the last arrival minute have changed."""
        if self.dirty is not None:
            hour, self.dirty = self.dirty, None
            self.outputs[hour][_REPLAYS] += 1
            self._replay(hour)

    def _publish(self, due) -> None:
        ready = [h for h in self.waiting if due(h)]
        if ready:
            self.settle()
            self.waiting = [h for h in self.waiting if not due(h)]
            for h in ready:
                self.outputs[h] = [-1, 0, 0, 0, 0, 0]
            self._replay(ready[0])

    def _replay(self, hour: int) -> None:
        """Restore the checkpoint that precedes ``hour``, fold the sorted suffix, replace the outputs it changes."""
        base = max((h for h in self.checkpoints if h <= hour), default=None)
        running = self.checkpoints[base] if base is not None else 0
        at = bisect_left(self.minutes, base * 60) if base is not None else 0
        totals: dict[int, int] = {}
        for minute in self.minutes[at:]:
            totals[minute // 60] = totals.get(minute // 60, 0) + self.counts[minute]
        for h, total in totals.items():
            self.checkpoints[h] = running
            running += total
            out = self.outputs.get(h)
            if out is not None:
                if out[_FIRST] < 0:  # published now
                    out[_FIRST] = total
                else:
                    out[_LATE] += total - out[_FINAL]
                out[_FINAL], out[_RUNNING] = total, running

    def save(self) -> tuple[list[int], list[int], list[int]]:
        """(minutes, counts, hours) from which ``restore`` continues."""
        self.settle()
        hours = []
        for h in sorted({*self.outputs, *self.waiting, *self.dropped}):
            hours += [h, int(h in self.outputs), *self.outputs.get(h, [0] * 6)]
            hours[-2] = self.dropped.get(h, 0)
        return self.minutes, [self.counts[m] for m in self.minutes], hours

    def restore(self, water: int, minutes, counts, hours) -> None:
        self.water = int(water)
        self.minutes = [int(m) for m in minutes]
        self.counts = dict(zip(self.minutes, map(int, counts)))
        with_rows = {m // 60 for m in self.minutes}
        for h, published, *out in np.asarray(hours, dtype="int64").reshape(-1, 8).tolist():
            if out[_DROPPED]:
                self.dropped[h] = out[_DROPPED]
            if published:
                self.outputs[h] = out
            elif h in with_rows:
                self.waiting.append(h)
        running = 0
        for m in self.minutes:
            self.checkpoints.setdefault(m // 60, running)
            running += self.counts[m]

    def rows(self) -> list[int]:
        """Per hour the values of ``OUT`` in a row; hours still open are shown as they would be published now."""
        self.settle()
        self._publish(lambda hour: True)
        out = []
        for h in sorted({*self.outputs, *self.dropped}):
            first, final, running, late, _, replays = self.outputs.get(h, [0] * 6)
            out += [h, first, final, running, late, self.dropped.get(h, 0), replays]
        return out


def _fold(grace: int, cutoff: int, hourly: bool):
    """Deltas, after the state of an earlier batch if there is one, sorted by key, day and arrival, to states or to hours."""
    columns = [c.split()[0] for c in (HOURS if hourly else STATE).split(", ")]
    width = len(OUT)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, rows = None, None, []

        def close() -> None:
            if hourly:
                flat = state.rows()
                rows.extend((key[0], *flat[i : i + width]) for i in range(0, len(flat), width))
            else:
                minutes, counts, hours = (list(x) for x in state.save())
                rows.append((*key, state.water, minutes, counts, hours, state.rows()))

        for pdf in frames:
            for name, day, arrival, minute, n, old in zip(pdf["key"], pdf["day"], pdf["arrival"], pdf["minute"], pdf["n"], pdf["old"]):
                if key != (name, day):
                    if state is not None:
                        close()
                    key, state = (name, day), ReplayState(grace, cutoff)
                if old is not None:
                    state.restore(old["water"], old["minutes"], old["counts"], old["saved"])
                else:
                    state.add(int(minute), int(arrival), int(n))
            if len(rows) > (10_000 if hourly else 1_000):
                yield pd.DataFrame(rows, columns=columns)
                rows.clear()
        if state is not None:
            close()
        yield pd.DataFrame(rows, columns=columns)

    return run


def replay(deltas: DataFrame, earlier: DataFrame | None, grace_minutes: int, cutoff_hours: int, hourly: bool = False) -> DataFrame:
    """States (``STATE``), or if ``hourly`` outputs (``HOURS``), after the deltas (key, day, arrival, minute, n); an
    ``earlier`` state table is carried on.

    The deltas of a later batch must not have arrived before those of an earlier one.
    """
    old = "struct<water: bigint, minutes: array<bigint>, counts: array<bigint>, saved: array<bigint>>"
    lines = deltas.select("key", "day", "arrival", "minute", "n", F.lit(None).cast(old).alias("old"))
    if earlier is not None:
        none = F.lit(None).cast("bigint")
        lines = lines.unionByName(earlier.select("key", "day", none.alias("arrival"), none.alias("minute"), none.alias("n"), F.struct("water", "minutes", "counts", "saved").alias("old")))
    lines = lines.repartition(shuffle_width(deltas.sparkSession), "key", "day").sortWithinPartitions("key", "day", F.col("arrival").asc_nulls_first(), "minute")
    return lines.mapInPandas(_fold(grace_minutes, 60 * cutoff_hours, hourly), HOURS if hourly else STATE)


def deltas_of(rows: DataFrame, key: Column, event_time: Column, arrived_at: Column) -> DataFrame:
    """Rows as (key, day, minute, arrival, n), counted before they are shuffled. Rows with a null in any of the three are left out."""
    minute_us = 60_000_000
    base = rows.select(key.alias("key"), F.unix_micros(event_time).alias("e"), F.unix_micros(arrived_at.cast("timestamp")).alias("a")).where("key is not null and e is not null and a is not null")
    # the arrival is rounded up, so that it is within a limit of whole minutes exactly if the row is
    minutes = base.select("key", F.floor(F.col("e") / minute_us).alias("minute"), F.ceil(F.col("a") / minute_us).alias("arrival"))
    return minutes.groupBy("key", "minute", "arrival").agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("minute") / 1440))


def outputs_of(states: DataFrame) -> DataFrame:
    """One row (key and ``OUT``) per key and hour of the states."""
    width = len(OUT)
    at = states.select("key", "outs", F.explode(F.sequence(F.lit(0), (F.size("outs") / width).cast("int") - 1)).alias("i")).where("size(outs) > 0")
    return at.select("key", *[F.get("outs", F.col("i") * width + k).alias(c) for k, c in enumerate(OUT)])


def hourly_counts(rows: DataFrame, key: Column, event_time: Column, arrived_at: Column, grace_minutes: int = 5, cutoff_hours: int = 6) -> DataFrame:
    """Count per key and hour of event time with the corrections made by late rows.

    A row is on time if it arrives at most ``grace_minutes`` after the end of its hour, late up to
    ``cutoff_hours`` after that end, dropped beyond. Rows whose key, event time or arrival is null
    are left out. ``first_count`` is what was published first, ``final_count`` the corrected count,
    ``day_count`` the running count of the key's UTC day up to that hour (0 for an hour of dropped rows
    only), ``n_late`` the sum of the corrections of the hour. Ties of arrival are taken in the order of
    event time; the result does not depend on it. An empty table gives no rows.
    """
    return replay(deltas_of(rows, key, event_time, arrived_at), None, grace_minutes, cutoff_hours, hourly=True)


class HourlyReplay:
    """The same over batches in order of arrival, with the states written after each."""

    def __init__(self, grace_minutes: int = 5, cutoff_hours: int = 6, states: DataFrame | None = None):
        self.grace_minutes, self.cutoff_hours, self.states = grace_minutes, cutoff_hours, states

    def ingest(self, batch: DataFrame, key: Column, event_time: Column, arrived_at: Column) -> DataFrame:
        """Outputs of all keys and hours after the batch."""
        self.states = stored(replay(deltas_of(batch, key, event_time, arrived_at), self.states, self.grace_minutes, self.cutoff_hours), "replay-state")
        return outputs_of(self.states)
