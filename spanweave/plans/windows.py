"""The supervised window data set: tile, keep fully known tiles, attach labels and dialogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import midpoint, overlap, owned_by
from ..operators.intervalsets import TOLERANCE, covered_seconds, union_spans
from ..operators.rangejoin import overlap_semi
from ..operators.tiles import tiles, with_bounds
from ..session import materialize

POINT = "struct<start_sec:double,end_sec:double>"
LINE = "struct<start_sec:double,end_sec:double,source:string,text:string>"


@dataclass(frozen=True)
class WindowOptions:
    window_sec: float = 20.0
    context_sec: float = 15.0
    history_sec: float = 90.0


def known_seconds(segments: DataFrame, window_sec: float) -> DataFrame:
    """(video_id, tile_no, known_sec): seconds of each tile under labels that are not uncertain.

    The merged spans are cut at tile bounds by arithmetic, so no range join is needed."""
    known = union_spans(
        segments.filter(F.col("kind") != "uncertain").select("video_id", "start_sec", "end_sec"), ["video_id"]
    )
    w = F.lit(float(window_sec))
    first = F.floor(F.col("start_sec") / w).cast("bigint")
    last = F.ceil(F.col("end_sec") / w).cast("bigint") - 1
    cut = known.withColumn("tile_no", F.explode(F.sequence(first, F.greatest(first, last))))
    seconds = F.least(F.col("end_sec"), (F.col("tile_no") + 1) * w) - F.greatest(F.col("start_sec"), F.col("tile_no") * w)
    return cut.groupBy("video_id", "tile_no").agg(F.sum(F.greatest(seconds, F.lit(0.0))).alias("known_sec"))


def labelled_tiles(videos: DataFrame, segments: DataFrame, options: WindowOptions, *, known_only: bool = False) -> DataFrame:
    """Every tile with ``known_sec``; ``known_only`` leaves tiles out that are not fully known."""
    seconds = known_seconds(segments, options.window_sec)
    if known_only:
        # tile bounds follow from the number; tiles without a known second are never generated
        inside = F.col("tile_no") * F.lit(float(options.window_sec)) < F.col("duration_sec")
        rows = seconds.join(videos, "video_id").filter(inside)
        return with_bounds(rows, options.window_sec, options.context_sec).filter(fully_known())
    joined = tiles(videos, options.window_sec, options.context_sec).join(seconds, ["video_id", "tile_no"], "left")
    return joined.withColumn("known_sec", F.coalesce("known_sec", F.lit(0.0)))


def fully_known():
    return F.col("core_end") - F.col("core_start") - F.col("known_sec") <= TOLERANCE


def midpoint_windows(segments: DataFrame, grid: DataFrame, window_sec: float) -> DataFrame:
    """Label -> the one tile that owns its midpoint. The tile number is computed, then the exact
    half-open test is repeated on it and its neighbours, because division rounds."""
    guess = F.floor(midpoint("start_sec", "end_sec") / window_sec).cast("bigint")
    near = segments.withColumn("tile_no", F.explode(F.array(guess - 1, guess, guess + 1)))
    mid = midpoint("start_sec", "end_sec")
    exact = (mid >= F.col("tile_no") * window_sec) & (mid < (F.col("tile_no") + 1) * window_sec)
    return near.filter(exact).join(grid, ["video_id", "tile_no"]).filter(
        owned_by("start_sec", "end_sec", "core_start", "core_end")
    )


def classify_tiles(videos: DataFrame, segments: DataFrame, options: WindowOptions, *, known_only: bool = False) -> DataFrame:
    """Tiles with their targets (relative spans) and ``outcome``: unknown is tested before
    incomplete_core; usable tiles are positive or empty."""
    grid = labelled_tiles(videos, segments, options, known_only=known_only)
    w = F.lit(float(options.window_sec))
    # label -> tile by its midpoint; division rounds, so the exact half-open test decides among
    # the tile and its neighbours. Bounds follow from the tile number, the grid is not read.
    mid = midpoint("start_sec", "end_sec")
    guess = F.floor(mid / w).cast("bigint")
    owned = (
        segments.filter(F.col("kind") == "positive")
        .select("video_id", "start_sec", "end_sec", F.explode(F.array(guess - 1, guess, guess + 1)).alias("tile_no"))
        .filter((mid >= F.col("tile_no") * w) & (mid < (F.col("tile_no") + 1) * w))
    )
    # one list per tile: bounded by what one short tile owns
    raw = owned.groupBy("video_id", "tile_no").agg(
        F.sort_array(F.collect_list(F.struct("start_sec", "end_sec"))).alias("_t"),
        F.min("start_sec").alias("_lo"), F.max("end_sec").alias("_hi"),
    )
    relative = F.transform(
        "_t",
        lambda x: F.struct(
            F.round(x["start_sec"] - F.col("read_start"), 6).alias("start_sec"),
            F.round(x["end_sec"] - F.col("read_start"), 6).alias("end_sec"),
        ),
    )
    cut = (F.col("_lo") < F.col("read_start")) | (F.col("_hi") > F.col("read_end"))
    return (
        grid.join(raw, ["video_id", "tile_no"], "left")
        .withColumn(
            "outcome",
            F.when(~fully_known(), "unknown")
            .when(F.coalesce(cut, F.lit(False)), "incomplete_core")
            .when(F.col("_t").isNotNull(), "positive")
            .otherwise("empty"),
        )
        .withColumn("segments", F.coalesce(relative, F.array().cast(f"array<{POINT}>")))
        .drop("_t", "_lo", "_hi")
    )


def window_dialogue(windows: DataFrame, dialogues: DataFrame, options: WindowOptions) -> DataFrame:
    """Add ``dialogue``: rows fully inside [read_start - history, read_end], relative, sorted.

    A line goes by arithmetic to the tiles whose history can hold it (with one tile to spare on
    both sides for rounding), meets its windows on (video_id, tile_no), and the exact bounds
    decide."""
    w = F.lit(float(options.window_sec))
    reach = F.lit(float(options.context_sec + options.history_sec))
    lowest = F.floor((F.col("_de") - F.lit(float(options.context_sec))) / w).cast("bigint") - 2
    highest = F.floor((F.col("_ds") + reach) / w).cast("bigint") + 1
    span = windows.select(
        "video_id", "tile_no", F.col("read_start").alias("_rs"),
        F.greatest(F.lit(0.0), F.col("read_start") - options.history_sec).alias("_hs"),
        F.col("read_end").alias("_he"),
    )
    lines = (
        dialogues.filter(F.col("start_sec") < F.col("end_sec"))
        .select("video_id", F.col("start_sec").alias("_ds"), F.col("end_sec").alias("_de"), "source", "text")
        .withColumn("tile_no", F.explode(F.sequence(F.greatest(F.lit(0), lowest), F.greatest(F.lit(0), highest))))
    )
    # windows without any line keep an empty list; lines are joined to the slim window rows only. Neither side is sent out
    # whole: both are generated, and the planner takes generated rows to be as few as those they are made from
    hits = span.hint("merge").join(lines, ["video_id", "tile_no"]).filter((F.col("_ds") >= F.col("_hs")) & (F.col("_de") <= F.col("_he")))
    row = F.struct(
        F.round(F.col("_ds") - F.col("_rs"), 6).alias("start_sec"),
        F.round(F.col("_de") - F.col("_rs"), 6).alias("end_sec"),
        F.col("source"),
        F.col("text"),
    )
    # one list per window: bounded by the speech of one history span
    grouped = hits.groupBy("video_id", "tile_no").agg(F.sort_array(F.collect_list(row)).alias("dialogue"))
    return windows.join(grouped.hint("merge"), ["video_id", "tile_no"], "left").withColumn(
        "dialogue", F.coalesce("dialogue", F.array().cast(f"array<{LINE}>"))
    )


def sample_id(video_id, start, end):
    """``video:start-end`` with whole seconds printed without a fraction."""
    def text(value):
        return F.regexp_replace(F.round(F.col(value), 6).cast("string"), r"\.0$", "")

    return F.concat(F.col(video_id).cast("string"), F.lit(":"), text(start), F.lit("-"), text(end))


def build_windows(
    videos: DataFrame, segments: DataFrame, dialogues: DataFrame, options: WindowOptions | None = None
) -> DataFrame:
    """The flagship: usable windows with relative targets and dialogue."""
    options = options or WindowOptions()
    kept = classify_tiles(videos, segments, options, known_only=True).filter(F.col("outcome").isin("positive", "empty"))
    with_text = window_dialogue(kept, dialogues, options)
    return with_text.withColumn("sample_id", sample_id("video_id", "core_start", "core_end")).withColumn(
        "detect_range",
        F.struct(
            F.round(F.col("core_start") - F.col("read_start"), 6).alias("start_sec"),
            F.round(F.col("core_end") - F.col("read_start"), 6).alias("end_sec"),
        ),
    )


def window_counts(tiles_df: DataFrame, by: str = "split") -> DataFrame:
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return tiles_df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        is_("unknown").alias("unknown"),
        is_("incomplete_core").alias("incomplete_core"),
        is_("positive", "empty").alias("usable"),
        is_("positive").alias("positive"),
        is_("empty").alias("empty"),
    )


def window_violations(windows: DataFrame) -> DataFrame:
    """(sample_id, reason) for windows that break the schema rules."""
    length = F.col("read_end") - F.col("read_start")
    core = F.col("detect_range")
    eps = F.lit(TOLERANCE)
    seg = F.col("segments")
    pairs = F.arrays_zip(
        F.slice(seg, 1, F.greatest(F.size(seg) - 1, F.lit(0))).alias("a"),
        F.slice(seg, 2, F.greatest(F.size(seg) - 1, F.lit(0))).alias("b"),
    )
    checks = {
        "detect_range": core["end_sec"] > length + eps,
        "ownership": F.exists(
            seg,
            lambda x: (x["end_sec"] > length + eps)
            | ~owned_by(x["start_sec"], x["end_sec"], core["start_sec"], core["end_sec"]),
        ),
        "order": F.exists(pairs, lambda p: p["a"]["start_sec"] > p["b"]["start_sec"]),
        "overlap": F.exists(
            pairs,
            lambda p: overlap(p["a"]["start_sec"], p["a"]["end_sec"], p["b"]["start_sec"], p["b"]["end_sec"]) > 0,
        ),
        "future_dialogue": F.exists("dialogue", lambda t: t["end_sec"] > length + eps),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return windows.select("sample_id", F.explode(reasons).alias("reason"))


def history_regions(segments: DataFrame, past: DataFrame) -> DataFrame:
    """Past positives now wholly negative and touching no positive, merged per video.

    ``past``: video_id, start_sec, end_sec of the scan's positives."""
    spans = past.select("video_id", "start_sec", "end_sec").distinct()
    covered = covered_seconds(
        spans, segments.filter(F.col("kind") == "negative"), ["video_id"],
        ["video_id", "start_sec", "end_sec"], name="_neg",
    )
    # written once: the join below counts its rows, joins them and takes them again
    rest = materialize(covered.filter(F.col("end_sec") - F.col("start_sec") - F.col("_neg") <= TOLERANCE).drop("_neg"), "negative_spans")
    positive = union_spans(
        segments.filter(F.col("kind") == "positive").select(
            "video_id", F.col("start_sec").alias("r_start_sec"), F.col("end_sec").alias("r_end_sec")
        ),
        ["video_id"], "r_start_sec", "r_end_sec",
    )
    clear = overlap_semi(rest, positive, ["video_id"], ["video_id", "start_sec", "end_sec"], anti=True)
    return union_spans(clear, ["video_id"])


def focus_windows(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """Windows whose core overlaps a history region (regions are disjoint per video)."""
    right = materialize(
        regions.select("video_id", F.col("start_sec").alias("r_start_sec"), F.col("end_sec").alias("r_end_sec")), "regions"
    )
    # windows of videos without a region are left out before they are dealt to buckets
    near = windows.join(right.select("video_id").distinct(), "video_id", "left_semi")
    return overlap_semi(
        near, right, ["video_id"], ["video_id", "tile_no"], left_span=("core_start", "core_end")
    )
