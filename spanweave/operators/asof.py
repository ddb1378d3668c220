"""As-of joins of request times against frame times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import sliced_lag, sliced_running, time_slice

SLICE_SEC = 600.0


def _asof(requests, frames, keys, ids, time, name, slice_sec, sign):
    """Last frame at or before (sign=1), or first at or after (sign=-1), each request time."""
    both = frames.select(*keys, (F.col("pts") * sign).alias("_t"), F.lit(0).alias("_req"), F.col("pts").alias("_pts")).unionByName(
        requests.select(*keys, *ids, (F.col(time) * sign).alias("_t"), F.lit(1).alias("_req")),
        allowMissingColumns=True,
    )
    found = sliced_running(
        both, keys, [F.col("_t"), F.col("_req")], time_slice("_t", slice_sec), lasts={name: F.col("_pts")}
    )
    return found.filter(F.col("_req") == 1).select(*keys, *ids, name)


def frame_floor(requests: DataFrame, frames: DataFrame, keys: Sequence[str], ids: Sequence[str], time: str, name: str = "frame_start", *, slice_sec: float = SLICE_SEC) -> DataFrame:
    """Last frame with pts <= time; requests before the first frame get the first frame."""
    found = _asof(requests, frames, list(keys), list(ids), time, name, slice_sec, 1)
    first = frames.groupBy(*keys).agg(F.min("pts").alias("_first"))
    return found.join(first, list(keys), "left").withColumn(name, F.coalesce(name, "_first")).drop("_first")


def frame_ceil(requests: DataFrame, frames: DataFrame, keys: Sequence[str], ids: Sequence[str], time: str, name: str = "frame_end", *, durations: DataFrame | None = None, slice_sec: float = SLICE_SEC) -> DataFrame:
    """First frame with pts >= time, else the duration of the key (null when none is given)."""
    found = _asof(requests, frames, list(keys), list(ids), time, name, slice_sec, -1)
    if durations is None:
        return found
    joined = found.join(durations.select(*keys, F.col("duration_sec").alias("_d")), list(keys), "left")
    return joined.withColumn(name, F.coalesce(name, "_d")).drop("_d")


def frame_snap(requests: DataFrame, frames: DataFrame, durations: DataFrame, keys: Sequence[str], ids: Sequence[str], *, start: str = "start_sec", end: str = "end_sec", slice_sec: float = SLICE_SEC, bucket_sec: float = 60.0) -> DataFrame:
    """Requests expanded to frame bounds, with ``precision_sec``, the largest frame gap inside.

    Starts, ends and frames are one ordered union: the greatest frame before a mark, together with the
    frame that follows it, answers both (an end sorts before a frame of the same time, a start after it).
    The largest gap of a long range comes from one maximum per whole bucket; only the first and
    the last bucket of a request look at single frames.
    """
    keys, ids = list(keys), list(ids)
    # read by the marks, the first frames and the gaps
    followed = materialize(
        sliced_lag(frames, keys, [F.col("pts")], time_slice("pts", slice_sec), {"_next": F.col("pts")}, forward=True).select(*keys, "pts", "_next"),
        "frames",
    )
    ask = lambda time, tag: requests.select(*keys, *ids, F.col(time).alias("_t"), F.lit(tag).alias("_tag"))
    marks = (
        followed.select(*keys, F.col("pts").alias("_t"), F.lit(1).alias("_tag"), F.struct("pts", "_next").alias("_frame"))
        .unionByName(ask(end, 0), allowMissingColumns=True).unionByName(ask(start, 2), allowMissingColumns=True)
    )
    found = sliced_running(marks, keys, [F.col("_t"), F.col("_tag")], time_slice("_t", slice_sec), maxes={"_last": F.col("_frame")})
    at = lambda tag: F.max(F.when(F.col("_tag") == tag, F.col("_last")))
    bounds = found.filter("_tag <> 1").groupBy(*keys, *ids).agg(at(2).alias("_before"), at(0).alias("_until"))
    whole = followed.groupBy(*keys).agg(F.min("pts").alias("_first")).join(durations.select(*keys, F.col("duration_sec").alias("_d")), keys, "full")
    snapped = (
        requests.join(bounds, [*keys, *ids]).join(whole, keys, "left")
        .withColumns(
            {
                "src_start_sec": F.coalesce("_before.pts", "_first"),
                "src_end_sec": F.coalesce(F.when(F.col("_until").isNull(), F.col("_first")).otherwise(F.col("_until._next")), "_d"),
            }
        )
        .drop("_before", "_until", "_first", "_d")
    )
    gaps = followed.join(durations.select(*keys, "duration_sec"), keys).select(
        *keys, F.col("pts").alias("_pts"), (F.coalesce("_next", "duration_sec") - F.col("pts")).alias("_gap"),
        F.floor(F.col("pts") / bucket_sec).cast("bigint").alias("_bucket"),
    )
    first = F.floor(F.col("src_start_sec") / bucket_sec).cast("bigint")
    last = F.floor(F.col("src_end_sec") / bucket_sec).cast("bigint")
    parts = snapped.select(
        *keys, *ids, "src_start_sec", "src_end_sec", first.alias("_f"), last.alias("_l"),
        F.explode(F.sequence(first, F.greatest(first, last))).alias("_bucket"),
    )
    edge = (F.col("_bucket") == F.col("_f")) | (F.col("_bucket") == F.col("_l"))
    inside = (F.col("_pts") >= F.col("src_start_sec")) & (F.col("_pts") < F.col("src_end_sec"))
    at_edges = parts.filter(edge).join(gaps, [*keys, "_bucket"]).filter(inside).select(*keys, *ids, "_gap")
    summary = gaps.groupBy(*keys, "_bucket").agg(F.max("_gap").alias("_gap"))
    within = parts.filter(~edge).join(summary, [*keys, "_bucket"]).select(*keys, *ids, "_gap")
    widest = at_edges.unionByName(within).groupBy(*keys, *ids).agg(F.max("_gap").alias("precision_sec"))
    return snapped.join(widest, [*keys, *ids], "left")
