"""Tiling, expansion and generation: rows made from ranges with ``explode(sequence(...))``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import hull, is_finite
from ..session import materialize
from .ordered import sliced_running, time_slice


def tiles(videos: DataFrame, window_sec: float, context_sec: float = 0.0, duration: str = "duration_sec") -> DataFrame:
    """Fixed tiles with a core and a padded read range; bounds are index * width, never sums."""
    n = F.ceil(F.col(duration) / window_sec).cast("bigint")
    return with_bounds(
        videos.filter(F.col(duration) > 0).withColumn("tile_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))),
        window_sec, context_sec, duration,
    )


def tiles_for_range(requests: DataFrame, window_sec: float, context_sec: float, start: str, end: str, duration: str = "duration_sec") -> DataFrame:
    """Global tiles touched by each request [start, end)."""
    first = F.floor(F.col(start) / window_sec).cast("bigint")
    stop = F.ceil(F.col(end) / window_sec).cast("bigint") - 1
    ok = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.col(duration))
    return with_bounds(
        requests.filter(ok).withColumn("tile_no", F.explode(F.sequence(first, stop))),
        window_sec, context_sec, duration,
    )


def with_bounds(df: DataFrame, window_sec: float, context_sec: float, duration: str = "duration_sec") -> DataFrame:
    """Core and read bounds of rows that carry a tile number and the duration of their video."""
    i, d = F.col("tile_no"), F.col(duration)
    core_start = i * F.lit(float(window_sec))
    core_end = F.least(d, (i + 1) * F.lit(float(window_sec)))
    return df.withColumns(
        {
            "core_start": core_start,
            "core_end": core_end,
            "read_start": F.greatest(F.lit(0.0), core_start - F.lit(float(context_sec))),
            "read_end": F.least(d, core_end + F.lit(float(context_sec))),
        }
    )


MIN_CHILD_SEC = 1.0


def split_pages(pages: DataFrame, flagged: Column, overlap_sec: float) -> DataFrame:
    """Halve flagged pages; children keep the overlap inside the parent's read range. A page whose
    halves would be shorter than a second stays whole with ``split_error``."""
    mid = (F.col("core_start_sec") + F.col("core_end_sec")) / 2
    half = (F.col("core_end_sec") - F.col("core_start_sec")) / 2

    def child(no, start, end):
        return F.struct(
            F.lit(no).alias("part"),
            start.alias("cs"),
            end.alias("ce"),
            F.greatest(F.col("read_start_sec"), start - overlap_sec).alias("rs"),
            F.least(F.col("read_end_sec"), end + overlap_sec).alias("re"),
        )

    parent = F.struct(
        F.lit(0).alias("part"), F.col("core_start_sec").alias("cs"), F.col("core_end_sec").alias("ce"),
        F.col("read_start_sec").alias("rs"), F.col("read_end_sec").alias("re"),
    )
    can = flagged & (half >= MIN_CHILD_SEC)
    parts = F.when(
        can, F.array(child(1, F.col("core_start_sec"), mid), child(2, mid, F.col("core_end_sec")))
    ).otherwise(F.array(parent))
    return (
        pages.withColumn("split_error", flagged & (half < MIN_CHILD_SEC))
        .withColumn("_c", F.explode(parts))
        .withColumns(
            {
                "part": F.col("_c.part"),
                "core_start_sec": F.col("_c.cs"),
                "core_end_sec": F.col("_c.ce"),
                "read_start_sec": F.col("_c.rs"),
                "read_end_sec": F.col("_c.re"),
            }
        )
        .drop("_c")
    )


def compact_tail(pages: DataFrame, videos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold a short last page into the one before when that one already reads to the end.

    Only the last two pages of a key matter; two keyed aggregates find them."""
    keys = list(keys)
    page = F.struct("core_start_sec", "core_end_sec", "read_end_sec")
    last = pages.groupBy(*keys).agg(F.max(page).alias("_t"))
    ranked = pages.join(last, keys)
    earlier = (
        ranked.filter(F.col("core_start_sec") < F.col("_t.core_start_sec"))
        .groupBy(*keys)
        .agg(F.max(page).alias("_p"))
    )
    length = lambda c: F.col(f"{c}.core_end_sec") - F.col(f"{c}.core_start_sec")
    merges = (
        last.join(earlier, keys)
        .join(videos.select(*keys, "duration_sec"), keys)
        .filter((F.col("_p.read_end_sec") == F.col("duration_sec")) & (length("_t") < length("_p")))
        .select(*keys, F.col("_t.core_start_sec").alias("_drop"), F.col("_t.core_end_sec").alias("_grow"), F.col("_p.core_start_sec").alias("_keep"))
    )
    out = pages.join(merges, keys, "left").filter(
        F.col("_drop").isNull() | (F.col("core_start_sec") != F.col("_drop"))
    )
    return out.withColumn(
        "core_end_sec", F.when(F.col("core_start_sec") == F.col("_keep"), F.col("_grow")).otherwise(F.col("core_end_sec"))
    ).select(*pages.columns)


def sample_grid(start, end, fps: float) -> Column:
    """Frame times start + i/fps below the end."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    n = F.greatest(F.lit(1), F.ceil((end - start) * fps)).cast("int")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i / F.lit(float(fps)))
    return F.filter(times, lambda t: t < end)


def equal_steps(start, end, n) -> Column:
    """n times at equal steps from the start."""
    start, end, n = (F.col(x) if isinstance(x, str) else x for x in (start, end, n))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: start + i * (end - start) / n)


def equal_parts(scenes: DataFrame, segment_sec: float, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """Each scene in ceil(length / segment_sec) equal parts."""
    length = F.col(end) - F.col(start)
    n = F.greatest(F.lit(1), F.ceil(length / segment_sec)).cast("int")
    return (
        scenes.withColumns({"_n": n, "part_no": F.explode(F.sequence(F.lit(0), n - 1))})
        .withColumns(
            {
                "part_start": F.col(start) + F.col("part_no") * length / F.col("_n"),
                "part_end": F.col(start) + (F.col("part_no") + 1) * length / F.col("_n"),
            }
        )
        .drop("_n")
    )


def frame_timeline(packets: DataFrame, streams: DataFrame, keys: Sequence[str], *, slice_sec: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """(frames, videos) from packet times.

    Discarded packets and packets before the declared start are dropped, equal times keep the
    last packet, times count from the first frame. ``packets``: keys, packet_no, pts, hold_sec,
    flags. ``streams``: keys, declared_start, declared_duration, fps.

    The kept packets are written once: ends, numbers and origins all follow the same keys, and the planner would put
    the join and the sorts of the packets into one task again for each of them.
    """
    keys = list(keys)
    declared = F.coalesce("declared_start", F.lit(float("-inf")))
    usable = (
        packets.join(streams.select(*keys, "declared_start"), keys)
        .filter(is_finite("pts") & (F.col("pts") >= declared) & ~F.contains(F.coalesce("flags", F.lit("")), F.lit("D")))
        .groupBy(*keys, "pts")
        .agg(F.max_by(F.coalesce("hold_sec", F.lit(0.0)), "packet_no").alias("hold_sec"))
    )
    usable = materialize(usable, "packets")
    ends = usable.groupBy(*keys).agg(
        F.min("pts").alias("origin"), F.max(F.struct("pts", "hold_sec")).alias("_last")
    )
    numbered = sliced_running(
        usable, keys, [F.col("pts")], time_slice("pts", slice_sec), sums={"_no": F.lit(1).cast("bigint")}
    )
    frames = numbered.join(ends.select(*keys, "origin"), keys).select(
        *keys, (F.col("_no") - 1).alias("frame_no"), F.round(F.col("pts") - F.col("origin"), 9).alias("pts")
    )
    last, hold = F.col("_last.pts"), F.col("_last.hold_sec")
    declared_end = F.col("declared_start") + F.coalesce("declared_duration", F.lit(0.0))
    tail = F.when(hold > 0, hold).when(declared_end > last, declared_end - last).otherwise(F.lit(1.0) / F.col("fps"))
    videos = ends.join(streams, keys).select(
        *keys, "origin", F.round(last + tail - F.col("origin"), 9).alias("duration_sec")
    )
    return frames, videos


# Plan issue texts.
ISSUE_TOO_LONG = "必要证据和建议上下文的总时长超过单片上限；请重新判断所需范围并更新事件。"
ISSUE_TOO_SHORT = "原视频长度不足以满足单片最短时长。"


def clip_plans(events: DataFrame, max_clip_sec: float = 24.0, min_clip_sec: float = 3.0) -> DataFrame:
    """One boundary proposal per supported event with decisive evidence inside the video.

    Needs ``required_spans``, ``proposed_start_sec``, ``proposed_end_sec``, ``duration_sec``.
    """
    lo, hi = hull(F.col("required_spans"))
    duration = F.col("duration_sec")
    eligible = (
        (F.col("status") == "supported")
        & F.exists("required_spans", lambda x: x["role"] == "decisive")
        & (hi <= duration)
        & F.coalesce(F.col("proposed_start_sec").between(0, duration), F.lit(True))
        & F.coalesce(F.col("proposed_end_sec").between(0, duration), F.lit(True))
    )
    start = F.least(lo, F.coalesce("proposed_start_sec", lo))
    end = F.greatest(hi, F.coalesce("proposed_end_sec", hi))
    want = F.lit(float(min_clip_sec))
    thin = F.col("_e") - F.col("_s") < want
    padded_start = F.greatest(F.lit(0.0), F.col("_s") - (want - (F.col("_e") - F.col("_s"))) / 2)
    padded_end = F.least(duration, F.greatest(F.col("_e"), F.col("_s1") + want))
    final_start = F.greatest(F.lit(0.0), F.least(F.col("_s1"), F.col("_e1") - want))
    length = F.col("end_sec") - F.col("start_sec")
    return (
        events.filter(eligible)
        .withColumns({"_s": start, "_e": end})
        .withColumn("_s1", padded_start)
        .withColumn("_e1", padded_end)
        .withColumns(
            {
                "start_sec": F.when(thin, final_start).otherwise(F.col("_s")),
                "end_sec": F.when(thin, F.col("_e1")).otherwise(F.col("_e")),
            }
        )
        .drop("_s", "_e", "_s1", "_e1")
        .withColumn(
            "issues",
            F.filter(
                F.array(
                    F.when(length > max_clip_sec, F.lit(ISSUE_TOO_LONG)),
                    F.when(length < min_clip_sec, F.lit(ISSUE_TOO_SHORT)),
                ),
                lambda x: x.isNotNull(),
            ),
        )
        .withColumn("plan_status", F.when(F.size("issues") > 0, F.lit("infeasible_duration")).otherwise(F.lit("draft")))
    )


# Words and formats of the dialogue and prompt text.
SPEECH_WORD = "对白"
SCREEN_WORD = "画面文字"
LINE_FORMAT = "%.2f–%.2f %s：%s"
PROMPT_FORMAT = "本次检测范围：%.2f–%.2f秒。下列文字使用同一时间轴，负时间是此前对白。\n%s"


def dialogue_text(dialogue) -> Column:
    """Lines of a window's dialogue array; screen text that ended before the view is dropped."""
    dialogue = F.col(dialogue) if isinstance(dialogue, str) else dialogue
    shown = F.filter(dialogue, lambda x: (x["source"] != "ocr") | (x["end_sec"] > 0))
    lines = F.transform(
        shown,
        lambda x: F.format_string(
            LINE_FORMAT,
            F.when(x["source"] == "ocr", F.greatest(F.lit(0.0), x["start_sec"])).otherwise(x["start_sec"]),
            x["end_sec"],
            F.when(x["source"] == "asr", F.lit(SPEECH_WORD)).otherwise(F.lit(SCREEN_WORD)),
            x["text"],
        ),
    )
    return F.array_join(lines, "\n")


def training_text(windows: DataFrame) -> DataFrame:
    """Prompt and answer columns; the answer never enters the prompt."""
    core = F.col("detect_range")
    return windows.select(
        "sample_id",
        F.format_string(PROMPT_FORMAT, core["start_sec"], core["end_sec"], dialogue_text("dialogue")).alias("prompt"),
        F.to_json(F.struct(F.col("segments").alias("segments"))).alias("answer"),
    )
