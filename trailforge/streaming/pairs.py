"""Pairing and absorption on streams whose state stays bounded: what waits too long comes out alone."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener


class _Pairs(StatefulProcessor):
    """Rows of a key wait in slots of event time; a slot that the watermark has passed is settled in order of time and id.

    Open rows form a queue: a map from running number to row, with the numbers of its two ends, so a row is put or taken
    without touching the others. All is done when timers expire: a timer for the end of each slot that holds rows, and one for the
    first open row's end. So nothing depends on how rows fall into batches.
    """

    def __init__(self, slot: float, expiry: float) -> None:
        self.slot, self.expiry = slot, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint", "at array<double>, id array<string>, opens array<boolean>")
        self.queue = handle.getMapState("queue", "nth bigint", "at double, id string")
        self.ends = handle.getValueState("ends", "head bigint, tail bigint")

    def _wake(self, slot: int) -> None:
        """A timer for the end of a slot."""
        self.handle.registerTimer(math.ceil((slot + 1) * self.slot * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[tuple]] = {}
        for pdf in rows:
            for at, name, opens in pdf[["timestamp", "id", "opens"]].itertuples(index=False):
                new.setdefault(math.floor(at / self.slot), []).append((at, None if name is None or name != name else name, bool(opens)))
        for slot, more in new.items():
            known = list(zip(*self.waiting.getValue((slot,)), strict=True)) if self.waiting.containsKey((slot,)) else []
            self.waiting.updateValue((slot,), tuple(list(column) for column in zip(*known, *more, strict=True)))
            self._wake(slot)
        yield pd.DataFrame({"key": [], "open_id": [], "close_id": []}, dtype=object)

    def _expired(self, head: int, tail: int, until: float, out: list[tuple], key: str | None) -> int:
        while head < tail:
            at, name = self.queue.getValue((head,))
            if at + self.expiry > until:
                break
            out.append((key, name, None))
            self.queue.removeKey((head,))
            head += 1
        return head

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = math.floor(timerValues.getCurrentWatermarkInMs() / 1000 / self.slot)  # slots below are complete
        out: list[tuple] = []
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        for slot in sorted(k[0] for k in self.waiting.keys() if k[0] < passed):  # noqa: SIM118
            rows = zip(*self.waiting.getValue((slot,)), strict=True)
            for at, name, opens in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
                head = self._expired(head, tail, at, out, key[0])
                if opens:
                    self.queue.updateValue((tail,), (at, name))
                    tail += 1
                elif head < tail:
                    out.append((key[0], self.queue.getValue((head,))[1], name))
                    self.queue.removeKey((head,))
                    head += 1
                else:
                    out.append((key[0], None, name))
            self.waiting.removeKey((slot,))
        head = self._expired(head, tail, passed * self.slot, out, key[0])
        if head < tail:
            self.ends.update((head, tail))
            if math.isfinite(self.expiry):
                self._wake(math.ceil((self.queue.getValue((head,))[0] + self.expiry) / self.slot))
        elif self.ends.exists():
            self.ends.clear()
        yield pd.DataFrame(out, columns=["key", "open_id", "close_id"], dtype=object)

    def close(self) -> None:
        pass


def pairs(rows: DataFrame, key: str, id: str, opens: str, delay: str = "10 minutes", expiry: float = 3600.0, slot: float = 1.0) -> DataFrame:
    """(key, open_id, close_id) of a stream, in append mode: each close takes the oldest open row of its key, first in,
    first out; a close that finds none stands alone, and so does an open row that none has taken within ``expiry`` seconds of event time.

    ``timestamp`` holds seconds. Rows are settled once the watermark, ``delay`` behind the latest row, has passed their
    ``slot`` of seconds, in order of time and id (nulls first; a close before an open of one id and time). The state of a key is what is open
    or waits, and ends with ``delay`` and ``expiry``. Rows without a time are left out, a null in ``opens``
    is a close, a null key is a key. Later rows than the watermark are dropped by Spark; ``LateRows`` counts them.
    The session's state store must be RocksDB's, which the state and timers need.
    """
    if not slot > 0 or not expiry > 0:
        raise ValueError("slot and expiry are seconds above 0")
    timed = rows.where(F.col("timestamp").isNotNull() & ~F.isnan("timestamp"))
    timed = timed.withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).withWatermark("event_time", delay)
    marked = timed.select(F.col(key).cast("string").alias("key"), "event_time", F.col("timestamp").cast("double").alias("timestamp"), F.col(id).cast("string").alias("id"), F.coalesce(F.col(opens), F.lit(False)).alias("opens"))
    return marked.groupBy("key").transformWithStateInPandas(_Pairs(slot, expiry), "key string, open_id string, close_id string", "append", "EventTime")


class LateRows(StreamingQueryListener):
    """Counts, by the name of a query, the rows that its stateful operators dropped as later than the watermark."""

    def __init__(self) -> None:
        self.dropped: dict[str | None, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.dropped[event.progress.name] = self.dropped.get(event.progress.name, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def absorb(parents: DataFrame, parent_id: str, parent_key: str, parent_time: str, follow_ups: DataFrame, key: str, time: str, value: Column, within: str = "1 hour", delay: str = "10 minutes", name: str = "absorbed") -> DataFrame:
    """(parent_id, parent_key, parent_time, name) of a stream of parents: each with the value of its last follow-up, in append mode.

    A follow-up belongs to a parent with its key that is at most ``within`` older; of several the last counts, of
    equally late ones the greatest value. An outer join of the two streams keeps parents that have none (null). Both sides have a watermark
    ``delay`` behind their latest row, so a parent's row comes out, once, when no more can follow, and then leaves the state.
    The times are timestamps; parents that share id, key and time are one; a null key meets none; rows without a time are left out. Other columns
    may be joined back by the id.
    """
    left = parents.select(F.col(parent_id).alias("_id"), F.col(parent_key).alias("_key"), F.col(parent_time).alias("_at")).where("_at is not null").withWatermark("_at", delay)
    right = follow_ups.select(F.col(key).alias("_of"), F.col(time).alias("_then"), value.alias("_value")).where("_then is not null").withWatermark("_then", delay)
    met = left.join(right, F.expr(f"_key = _of AND _then >= _at AND _then <= _at + INTERVAL {within}"), "leftOuter")
    last = met.groupBy("_id", "_key", "_at").agg(F.max_by("_value", F.struct("_then", "_value")).alias(name))
    return last.select(F.col("_id").alias(parent_id), F.col("_key").alias(parent_key), F.col("_at").alias(parent_time), name)
