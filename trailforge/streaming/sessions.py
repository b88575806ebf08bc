"""Boundaries and pairing on streams: rows wait for the watermark, then go through in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailforge.operators.boundary import BoundaryConfig, boundary_reason

_WAITING = "at array<double>, id array<string>, mark array<string>"


def _ripe(state: GroupState, batches: Iterator[pd.DataFrame], kept: tuple, columns: tuple[str, str, str]) -> tuple[list[tuple], list[tuple]]:
    """(rows that the watermark has passed, in order; rows that still wait). A row waits as (time, id, mark)."""
    waiting = list(zip(*[list(x) for x in kept], strict=True)) if kept else []
    for pdf in batches:
        waiting += [(float(t), str(i), "" if m is None or m != m else str(m)) for t, i, m in pdf[list(columns)].itertuples(index=False)]
    waiting.sort()
    limit = state.getCurrentWatermarkMs() / 1000.0
    cut = next((k for k, r in enumerate(waiting) if r[0] >= limit), len(waiting))
    return waiting[:cut], waiting[cut:]


def _wait(state: GroupState, rows: list[tuple], carried: tuple) -> None:
    """Keep the waiting rows, and wake when the watermark passes the first of them."""
    columns = tuple([r[k] for r in rows] for k in range(3))
    state.update((*columns, *carried))
    if rows:
        state.setTimeoutTimestamp(max(int(rows[0][0] * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def _events(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with an event time from their seconds, and the watermark."""
    return rows.withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).withWatermark("event_time", delay)


def boundaries(fragments: DataFrame, delay: str = "10 minutes", config: BoundaryConfig = BoundaryConfig()) -> DataFrame:
    """(scenario_id, fragment_id, timestamp, reason, rn, unit_idx) of a stream of fragments, in append mode.

    A fragment is placed once the watermark has passed it, in the order of time and id; the state
    of a scenario is its waiting fragments and two counters. Fragments later than the watermark are
    dropped by Spark. The same rules as in batch; parent links are not used."""
    rows = _events(fragments, delay).select("scenario_id", "timestamp", "event_time", "fragment_id", boundary_reason(config).alias("reason"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, marks, rn, unit = state.get if state.exists else ([], [], [], 0, 0)
        ripe, rest = _ripe(state, () if state.hasTimedOut else batches, (at, ids, marks), ("timestamp", "fragment_id", "reason"))
        out = []
        for t, name, reason in ripe:
            rn += 1
            unit += bool(reason) and rn > 1
            out.append((key[0], name, t, reason or None, rn, unit))
        _wait(state, rest, (rn, unit))
        yield pd.DataFrame(out, columns=["scenario_id", "fragment_id", "timestamp", "reason", "rn", "unit_idx"])

    return rows.groupBy("scenario_id").applyInPandasWithState(step, "scenario_id string, fragment_id string, timestamp double, reason string, rn long, unit_idx int", f"{_WAITING}, rn long, unit int", "append", GroupStateTimeout.EventTimeTimeout)


def fifo(rows: DataFrame, key: str, id: str, opens: str, delay: str = "10 minutes") -> DataFrame:
    """(key, open_id, close_id) of a stream: each close takes the oldest open row of its key, first
    in, first out, once the watermark has passed it; a close that finds none stands alone. Opens
    that are never closed stay in the state (a batch run over the same rows lists them)."""
    marked = _events(rows, delay).select(F.col(key).cast("string").alias("key"), "timestamp", "event_time", F.col(id).cast("string").alias("id"), F.when(F.col(opens), "open").otherwise("close").alias("mark"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, marks, queue = state.get if state.exists else ([], [], [], [])
        ripe, rest = _ripe(state, () if state.hasTimedOut else batches, (at, ids, marks), ("timestamp", "id", "mark"))
        queue, out = list(queue), []
        for _, one, mark in ripe:
            if mark == "open":
                queue.append(one)
            else:
                out.append((name[0], queue.pop(0) if queue else None, one))
        _wait(state, rest, (queue,))
        yield pd.DataFrame(out, columns=["key", "open_id", "close_id"])

    return marked.groupBy("key").applyInPandasWithState(step, "key string, open_id string, close_id string", f"{_WAITING}, queue array<string>", "append", GroupStateTimeout.EventTimeTimeout)
