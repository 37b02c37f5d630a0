"""The track filter on a stream.

Rows of a track may arrive out of order within the watermark. They wait in a list until the watermark passes them, go
through the filter in order of (time, frame, tie), and leave. Rows later than the watermark are dropped, as documented.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.track import RESULT, FilterConfig, TrackState, frames_of, step

_ROW = "frame bigint, tie bigint, event_time timestamp, query_time_s double, latitude double, longitude double, matched_flight string, inliers bigint, ratio double, visual_score double, gate_reason string"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_OUT = ["track", "frame", "query_time_s", *[x.split()[0] for x in RESULT.split(", ")]]


class TrackFilter(StatefulProcessor):
    """Holds a track's waiting rows and its filter state."""

    def __init__(self, cfg: FilterConfig = FilterConfig()):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "latitude double, longitude double, time_s double, flight string, accepted bigint")
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf[_NAMES].itertuples(index=False):
                self.waiting.appendValue(tuple(None if v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r))
                self.handle.registerTimer(int(r.event_time.timestamp() * 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        at = _NAMES.index("event_time")
        due = [r for r in rows if r[at].timestamp() * 1000 < until]
        if not due:
            return
        later = [r for r in rows if r[at].timestamp() * 1000 >= until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        held = self.state.get() if self.state.exists() else None
        state = TrackState(*held) if held else None
        t, frame, tie = (_NAMES.index(c) for c in ("query_time_s", "frame", "tie"))
        due.sort(key=lambda r: (r[t] is not None, r[t] or 0.0, r[frame], r[tie]))
        out = []
        for number, time_s, found in frames_of(pd.DataFrame(due, columns=_NAMES).astype({"matched_flight": object}).itertuples(index=False)):
            state, row = step(state, found, time_s, self.cfg)
            out.append({"track": key[0], "frame": number, "query_time_s": time_s, **row})
        if state is not None:
            self.state.update((state.latitude, state.longitude, state.time_s, state.flight, state.accepted))
        yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def filter_stream(candidates: DataFrame, track: str, frame: str, tie: str, event_time: str, delay: str = "10 seconds", cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Filtered frames of a streaming candidate table (columns as for operators.track.filter_tracks, and an event time).

    Needs the RocksDB state store provider.
    """
    spark = candidates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    thin = candidates.select(
        F.col(track).cast("string").alias("track"), F.col(frame).cast("long").alias("frame"), F.col(tie).cast("long").alias("tie"), F.col(event_time).cast("timestamp").alias("event_time"),
        "query_time_s", "latitude", "longitude", "matched_flight", F.col("inliers").cast("long").alias("inliers"), F.col("ratio").cast("double").alias("ratio"), F.col("visual_score").cast("double").alias("visual_score"), "gate_reason",
    ).withWatermark("event_time", delay)
    out = f"track string, frame bigint, query_time_s double, {RESULT}"
    return thin.groupBy("track").transformWithStateInPandas(TrackFilter(cfg), out, "append", "eventtime")
