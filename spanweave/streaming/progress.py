"""Scan progress as a stream: watched ranges merge as they arrive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.intervals import is_finite
from ..operators.intervalsets import TOLERANCE, union_spans
from ..operators.telemetry import scan_progress

WATCHED = T.StructType([
    T.StructField("video_id", T.LongType()), T.StructField("slice", T.LongType()), T.StructField("start_sec", T.DoubleType()),
    T.StructField("end_sec", T.DoubleType()), T.StructField("pending", T.LongType()),
])


def merge_span(starts: list[float], ends: list[float], start: float, end: float, tolerance: float = TOLERANCE) -> bool:
    """Put a span into sorted disjoint spans, together with all it touches; False if it was covered already."""
    low = bisect_left(ends, start - tolerance)
    high = bisect_right(starts, end + tolerance)
    if low < high:
        if starts[low] <= start and end <= ends[low]:
            return False
        start, end = min(start, starts[low]), max(end, ends[high - 1])
    starts[low:high], ends[low:high] = [start], [end]
    return True


class Progress(StatefulProcessor):
    """State per slice of a video: the disjoint watched spans, as many as there are gaps, and the observations that were
    made but not yet delivered. Only delivered observations count as watched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "start double", "end double")
        self.waiting = handle.getMapState("waiting", "id long", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = dict(sorted((s, e) for (s,), (e,) in self.spans.iterator()))
        starts, ends = list(stored), list(stored.values())
        waiting = {i: state for (i,), (state,) in self.waiting.iterator()}
        before = dict(waiting)
        for batch in rows:
            for ident, delivered, start, end in zip(batch["observation_id"], batch["delivered"], batch["start_sec"], batch["end_sec"]):
                if delivered:
                    merge_span(starts, ends, start, end)
                if ident == ident and ident is not None:  # not a later slice of a span
                    ident = int(ident)
                    other = "observed" if delivered else "delivered"
                    if waiting.get(ident) == other:  # both have come
                        del waiting[ident]
                    else:
                        waiting[ident] = "delivered" if delivered else "observed"
        now = dict(zip(starts, ends))
        for s in stored.keys() - now.keys():
            self.spans.removeKey((s,))
        for s, e in now.items():
            if stored.get(s) != e:
                self.spans.updateValue((s,), (e,))
        for i in before.keys() - waiting.keys():
            self.waiting.removeKey((i,))
        for i, state in waiting.items():
            if before.get(i) != state:
                self.waiting.updateValue((i,), (state,))
        if now != stored or waiting != before:
            pending = sum(state == "observed" for state in waiting.values())
            listed = list(now.items()) or [(None, None)]
            yield pd.DataFrame([(int(key[0]), int(key[1]), s, e, pending) for s, e in listed], columns=WATCHED.names)

    def close(self) -> None:
        pass


def watched_stream(observations: DataFrame, slice_sec: float = 600.0) -> DataFrame:
    """Whole changed slices in update mode; read with ``newest_groups`` by (video_id, slice).

    ``observations``: video_id, observation_id, start_sec, end_sec, delivered; one row when an observation is made and one when it
    is delivered, in any order. Spans are cut at slice edges, so that a long or busy video spreads over tasks."""
    ok = is_finite("start_sec") & is_finite("end_sec") & (F.col("start_sec") <= F.col("end_sec"))
    first = F.floor(F.col("start_sec") / slice_sec)
    cut = observations.filter(ok).withColumn("_first", first).withColumn("slice", F.explode(F.sequence(first, F.floor(F.col("end_sec") / slice_sec))))
    pieces = cut.select(
        F.col("video_id").cast("bigint").alias("video_id"), "slice", F.when(F.col("slice") == F.col("_first"), F.col("observation_id").cast("bigint")).alias("observation_id"),
        F.greatest("start_sec", F.col("slice") * F.lit(float(slice_sec))).alias("start_sec"),
        F.least("end_sec", (F.col("slice") + 1) * F.lit(float(slice_sec))).alias("end_sec"), "delivered",
    )
    return pieces.groupBy("video_id", "slice").transformWithStateInPandas(Progress(), outputStructType=WATCHED, outputMode="Update", timeMode="None")


def progress_of(watched: DataFrame, pages: DataFrame, videos: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Progress per video from the newest slices: completed pages and seconds, coverage, next page, pending observations and pages."""
    keys = list(keys)
    spans = union_spans(watched.filter("start_sec IS NOT NULL"), keys)
    per_slice = watched.groupBy(*keys, "slice").agg(F.max("pending").alias("pending"))
    pending = per_slice.groupBy(*keys).agg(F.sum("pending").alias("pending_observation_count"))
    out = scan_progress(pages, spans, videos, keys).join(pending, keys, "left")
    return out.withColumn("pending_observation_count", F.coalesce("pending_observation_count", F.lit(0))).withColumn(
        "pending_page_count", F.col("page_count") - F.col("completed_page_count")
    )
