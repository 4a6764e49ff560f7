"""Keyed processors with map, list and value state and timers.

They run on ``transformWithState`` with the RocksDB state store, which keeps
state beside the executors' memory and checkpoints its changes, so a restart
goes on where the stream stopped.  A key's rows of one micro-batch are handled
in the order of ``seq``; the source's trigger options bound how many one key
can bring at once.  Only the entries that changed are written back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Activation and prompting.
DECAY, ACTIVE, TRAIL = 0.85, 32, 16
DAILY_CAP, MUTE_AFTER = 3, 3
#: How long after a user's last row the day's counter is kept for late rows of that day.
COUNTER_MS = 48 * 3600 * 1000

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need, for streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.seq is not None, r.seq or 0))


class Activation(StatefulProcessor):
    """Strengths (map), trail (list), and how many hits there were and repeated (value).

    A strength is stored with the hit that set it and fades by arithmetic, so
    a hit writes one entry and not all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "item string", "strength double, step long")
        self.trail = handle.getListState("trail", "item string")
        self.place = handle.getValueState("place", "step long, stable int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        step, stable = self.place.get() if self.place.exists() else (0, 0)
        held = {k[0]: (v[0], v[1]) for k, v in self.active.iterator()} if self.active.exists() else {}
        trail = [x[0] for x in self.trail.get()] if self.trail.exists() else []
        before = dict(held)
        for hit in in_order(rows):
            if hit.item is None or hit.relevance is None or hit.relevance != hit.relevance:
                continue
            step += 1
            strength, since = held.get(hit.item, (0.0, step))
            held[hit.item] = (min(strength * DECAY ** (step - since) + min(max(hit.relevance, 0.0), 1.0), 1.0), step)
            if len(held) > ACTIVE:
                del held[min(held, key=lambda i: (held[i][0] * DECAY ** (step - held[i][1]), [-ord(c) for c in i]))]
            stable = stable + 1 if trail and trail[-1] == hit.item else 0
            trail = [*trail, hit.item][-TRAIL:]
        for item in before.keys() - held.keys():
            self.active.removeKey((item,))
        for item, value in held.items():
            if before.get(item) != value:
                self.active.updateValue((item,), value)
        if trail:
            self.trail.put([(x,) for x in trail])
        self.place.update((step, stable))
        for item, (strength, since) in held.items():
            yield Row(user_id=key[0], item=item, activation=strength * DECAY ** (step - since), stable=stable, trail=trail)

    def close(self) -> None:
        pass


def activation_stream(hits: DataFrame) -> DataFrame:
    """The working set of each user from hits (user_id, seq, item, relevance), after every micro-batch that has hits of theirs.

    Each hit fades all entries by 0.85 and adds its relevance (0 to 1) to its
    own, capped at 1; the 32 strongest stay (ties: the smaller item).
    ``stable`` counts hits that repeat the last item, the trail keeps 16
    items.  Hits without item or relevance change nothing; hits without a
    user belong together.
    """
    use_rocksdb(hits.sparkSession)
    out = "user_id long, item string, activation double, stable int, trail array<string>"
    return hits.groupBy("user_id").transformWithState(Activation(), out, "Update", "None")


class DailyCap(StatefulProcessor):
    """What was shown on the last day (value) and prompts ignored in a row of each category (map).

    ``timed`` rows have an event time ``at``; the day's counter then goes by a
    timer when the watermark is ``COUNTER_MS`` past the user's last row.
    """

    def __init__(self, timed: bool) -> None:
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.today = handle.getValueState("today", "day string, shown int, until long")
        self.ignored = handle.getMapState("ignored", "category string", "streak int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        day, shown, until = self.today.get() if self.today.exists() else ("", 0, 0)
        last = until
        for c in in_order(rows):
            if c.day != day:
                day, shown = c.day, 0
            if self.timed:
                last = max(last, int(c.at.timestamp() * 1000) + COUNTER_MS)
            name = (c.category if c.category is not None else "",)
            if c.kind == "clicked":
                if self.ignored.containsKey(name):
                    self.ignored.removeKey(name)
                continue
            streak = self.ignored.getValue(name)[0] if self.ignored.containsKey(name) else 0
            if c.kind == "ignored":
                self.ignored.updateValue(name, (streak + 1,))
            elif shown < DAILY_CAP and streak < MUTE_AFTER:
                shown += 1
                yield Row(user_id=key[0], seq=c.seq)
        if last > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(last)
        self.today.update((day or "", shown, last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.today.clear()
        yield from ()

    def close(self) -> None:
        pass


def daily_cap_stream(candidates: DataFrame, delay: str | None = None) -> DataFrame:
    """Which candidates to show: rows (user_id, seq, day, category, kind) of kind candidate, ignored or clicked.

    At most three a day and user; a category is muted after three ignored
    prompts in a row, a click lifts that.  A null category is the empty one.
    With a ``delay`` rows have an event time ``at`` too: rows later than that
    are dropped, and counters of days long over leave the state.
    """
    use_rocksdb(candidates.sparkSession)
    timed = delay is not None
    rows = candidates.withWatermark("at", delay) if timed else candidates
    return rows.groupBy("user_id").transformWithState(DailyCap(timed), "user_id long, seq long", "Append", "EventTime" if timed else "None")


class Expiry(StatefulProcessor):
    """When a record is due (value), and a timer at that time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.due.get()[0] if self.due.exists() else None
        due = max([r.expires_ms for r in rows if r.expires_ms is not None] + ([held] if held is not None else []), default=None)
        if due is None:
            return
        if due <= timerValues.getCurrentWatermarkInMs():
            if held is not None:
                self.handle.deleteTimer(held)
                self.due.clear()
            yield Row(id=key[0], expires_ms=due)
        elif due != held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.due.exists():
            yield Row(id=key[0], expires_ms=self.due.get()[0])
            self.due.clear()

    def close(self) -> None:
        pass


def ttl_sweep_stream(records: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Ids whose time is over, from records (id, at, expires_ms): an event-time timer for each, no sweep.

    The latest ``expires_ms`` of an id counts; a null one never ends.  State
    and timer go when the id is told; a later record begins anew.
    """
    use_rocksdb(records.sparkSession)
    return records.withWatermark("at", delay).groupBy("id").transformWithState(Expiry(), "id long, expires_ms long", "Append", "EventTime")
