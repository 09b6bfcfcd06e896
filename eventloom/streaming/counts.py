"""Streaming forms: windowed counts, sessions, and onsets, hysteresis and interval statistics
with a state per unit that goes when the unit falls silent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(stream: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """Zone-less times become instants (UTC session), with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(stream: DataFrame, width: str, by: list[str]) -> DataFrame:
    return stream.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(stream: DataFrame, width: str, step: str, by: list[str]) -> DataFrame:
    return stream.groupBy(F.window("ts", width, step), *by).agg(F.count(F.lit(1)).alias("n"))


def bursts(stream: DataFrame, gap: str, by: list[str]) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))


def _stateful(stream: DataFrame, step, columns: str, held: str, idle_ms: int) -> DataFrame:
    """step(state values or None, ts, value) -> (state values, output rows or none) over each
    unit's events in order of time. A unit's state goes when the watermark has passed idle_ms
    after its last event, so states are as many as there are live units."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        own, out, last = state.get if state.exists else None, [], None
        events = pd.concat(list(frames)).sort_values("ts")
        for ts, v in events[["ts", "value"]].itertuples(index=False):
            own, found = step(own, ts, v)
            out += [(key[0], *f) for f in found]
            last = ts
        if own is not None:
            state.update(own)
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("user_id").applyInPandasWithState(run, columns, held, "append", GroupStateTimeout.EventTimeTimeout)


def onsets(stream: DataFrame, high: float, low: float, idle_ms: int = 86_400_000) -> DataFrame:
    """Per unit: events at which a value first reaches high after having been under low; a unit
    that was silent for idle_ms starts as off."""

    def step(own, ts, v):
        on = own is not None and own[0]
        if not on and v >= high:
            return (True,), [(ts,)]
        return (on and not v < low,), []

    return _stateful(stream, step, "user_id long, ts timestamp", "on boolean", idle_ms)


def hysteresis(stream: DataFrame, high: float, low: float, idle_ms: int = 86_400_000) -> DataFrame:
    """Every event with its unit's state after it: on from high, off under low, else as before."""

    def step(own, ts, v):
        on = v >= high or (own is not None and own[0] and not v < low)
        return (on,), [(ts, int(on))]

    return _stateful(stream, step, "user_id long, ts timestamp, active int", "on boolean", idle_ms)


def interval_statistics(stream: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """After each event of a unit from its third on: the number of its intervals so far, their
    mean and squared coefficient of variation, from running sums."""

    def step(own, ts, v):
        now = ts.timestamp()
        if own is None:
            return (now, 0, 0.0, 0.0), []
        last, n, total, squares = own
        n, total, squares = n + 1, total + (now - last), squares + (now - last) ** 2
        mean = total / n
        found = [(ts, n, mean, (squares / n - mean * mean) / (mean * mean))] if n >= 2 and mean > 0 else []
        return (now, n, total, squares), found

    return _stateful(stream, step, "user_id long, ts timestamp, n long, mean double, cv2 double", "last double, n long, total double, squares double", idle_ms)
