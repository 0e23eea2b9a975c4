"""Rate limits whose windows start at a client's first request, as a stream.

A client's requests are counted in the order of their time, once the watermark
has passed them, so a late request within the delay stands in its place.  The
state of a client is the open window's start and count and the times not yet
passed; a timer at the earliest of these, or at the window's end, wakes it, and
it is dropped when nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from .jobs import with_event_time

STATE = "start bigint, n bigint, waiting array<bigint>"


def counted(start: int | None, n: int, times: list[int], length: int) -> Iterator[tuple[int, int]]:
    """The windows that ``times``, in order, end and lastly the open one."""
    for t in times:
        if start is None or t >= start + length:
            if start is not None:
                yield start, n
            start, n = t, 0
        n += 1
    if start is not None:
        yield start, n


def breaches(requests: DataFrame, client: str, limit: int, length_seconds: int, delay: str, at: str = "created_at") -> DataFrame:
    """(window_start, client, requests) for update mode: a window is given out
    when it first has more than ``limit`` requests and whenever it grows; its
    newest row is its count."""
    import pandas as pd

    length = length_seconds * 1_000_000
    timed = with_event_time(requests.filter(F.col(client).isNotNull() & F.col(at).isNotNull()), at, delay, "_at").select(client, "_at")
    kind = timed.schema[client].dataType
    out = StructType([StructField(client, kind)]).add("window_us", "long").add("requests", "long")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        start, n, waiting = state.get if state.exists else (None, 0, [])
        times = sorted([*waiting, *(t for frame in frames for t in frame["_at"].astype("datetime64[us]").astype("int64").tolist())])
        due = [t for t in times if t <= passed]
        later = times[len(due):]
        windows = list(counted(start, n, due, length))
        grown = [(s, k) for s, k in windows if k > limit and (s, k) != (start, n)]
        if windows:
            start, n = windows[-1]
            if start + length <= passed:
                start, n = None, 0
        if start is None and not later:
            if state.exists:
                state.remove()
        else:
            state.update((start, n, later))
            wake = min([*later[:1], *([start + length] if start is not None else [])])
            state.setTimeoutTimestamp(max(-(-wake // 1000), passed // 1000 + 1))
        if grown:
            yield pd.DataFrame({client: [key[0]] * len(grown), "window_us": [s for s, _ in grown], "requests": [k for _, k in grown]})

    found = timed.groupBy(client).applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.timestamp_micros("window_us").cast("timestamp_ntz").alias("window_start"), client, "requests")
