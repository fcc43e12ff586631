"""Track statistics over unbounded event streams.

An extension: finite recordings have no event time. Rows carry track, ts, x, y.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_activity(stream: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """track, begin, end, n, and mean x and y per sliding window; rows later than the watermark are left out."""
    timed = stream.withWatermark("ts", late)
    grouped = timed.groupBy("track", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return grouped.select("track", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "x", "y")


def visits(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """track, begin, end and n of stretches without a longer gap."""
    grouped = stream.withWatermark("ts", late).groupBy("track", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("track", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def running_segments(stream: DataFrame, jump: float, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """track, segment, begin, end and n of each segment that a jump in x or a pause has ended.

    State per track: the open segment's number, begin, last time, last x and row
    count. Within a micro-batch rows are put in time order; it is flushed when nothing came for idle_ms of event time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            no, begin, last, _, n = state.get
            done.append((no, begin, last, n))
            state.remove()
        else:
            no, begin, last, x, n = state.get if state.exists else (0, None, None, None, 0)
            rows = pd.concat(list(batches)).sort_values("ts")
            for ts, v in zip(rows["ts"], rows["x"], strict=True):
                if n and abs(v - x) >= jump:
                    done.append((no, begin, last, n))
                    no, begin, n = no + 1, None, 0
                begin = ts if begin is None else begin
                last, x, n = ts, float(v), n + 1
            state.update((no, begin, last, x, n))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["track", "segment", "begin", "end", "n"])

    timed = stream.select("track", "ts", F.col("x").cast("double").alias("x")).withWatermark("ts", late)
    return timed.groupBy("track").applyInPandasWithState(step, "track long, segment int, begin timestamp, end timestamp, n long", "no int, begin timestamp, last timestamp, x double, n long", "append", GroupStateTimeout.EventTimeTimeout)
