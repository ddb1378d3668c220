"""Set algebra over spans per key: union, difference, coverage, overlay, replacement, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import owned_by
from ..functions.scalars import strip_space
from ..session import materialize
from .ordered import sliced_lag, sliced_running, time_slice
from .rangejoin import overlap_join

SLICE_SEC = 600.0
TOLERANCE = 1e-6


def union_spans(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start_sec",
    end: str = "end_sec",
    *,
    slice_sec: float = SLICE_SEC,
    tolerance: float = 0.0,
) -> DataFrame:
    """Merge overlapping or touching spans per key into disjoint ones.

    Spans are cut at slice edges and merged inside their slice; copies and spans that share a
    start fold into one row before the shuffle. A merged span that reaches no slice edge is
    final. The others, at most two per slice, are stitched together in a second pass.
    """
    keys = list(keys)
    s, e = F.col(start), F.col(end)
    last = F.ceil(e / slice_sec).cast("bigint") - 1
    first = time_slice(s, slice_sec)
    pieces = (
        df.filter(s < e)
        .select(*keys, s.alias("_s"), e.alias("_e"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_slice"))
        .select(
            *keys,
            "_slice",
            F.greatest(F.col("_s"), F.col("_slice") * F.lit(slice_sec)).alias("_s"),
            F.least(F.col("_e"), (F.col("_slice") + 1) * F.lit(slice_sec)).alias("_e"),
        )
        .groupBy(*keys, "_slice", "_s")
        .agg(F.max("_e").alias("_e"))
    )
    local = _islands(pieces, [*keys, "_slice"], tolerance)
    edge = (F.col("_s") <= F.col("_slice") * F.lit(slice_sec) + tolerance) | (
        F.col("_e") >= (F.col("_slice") + 1) * F.lit(slice_sec) - tolerance
    )
    local = local.withColumn("_stream", F.when(~edge, F.col("_slice"))).drop("_slice")
    merged = _islands(local, [*keys, "_stream"], tolerance)
    return merged.select(*keys, F.col("_s").alias(start), F.col("_e").alias(end))


def _islands(df: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("_s") > reach + F.lit(tolerance)), 1).otherwise(0)
    return (
        df.withColumn("_fresh", fresh)
        .withColumn("_island", F.sum("_fresh").over(w))
        .groupBy(*keys, "_island")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .drop("_island")
    )


def gaps(islands: DataFrame, keys: Sequence[str], start: str, end: str, *, slice_sec: float = SLICE_SEC) -> DataFrame:
    """Ranges (g_start, g_end) between consecutive disjoint spans of a key."""
    with_prev = sliced_lag(
        islands, keys, [F.col(start)], time_slice(start, slice_sec), {"_prev": F.col(end)}
    )
    return with_prev.filter(F.col("_prev").isNotNull()).select(
        *keys, F.col("_prev").alias("g_start"), F.col(start).alias("g_end")
    )


def subtract_spans(
    base: DataFrame,
    cuts: DataFrame,
    keys: Sequence[str],
    *,
    start: str = "start_sec",
    end: str = "end_sec",
    cut_start: str = "start_sec",
    cut_end: str = "end_sec",
    bucket_sec: float = 60.0,
    slice_sec: float = SLICE_SEC,
) -> DataFrame:
    """Base spans minus the cuts of their key, one row per piece, base attributes kept.

    The pieces are the overlaps of the base with the gaps between the merged cuts, plus what lies
    before the first and after the last cut; no list of cuts is ever collected for a base row.
    """
    keys = list(keys)
    islands = union_spans(
        cuts.select(*keys, F.col(cut_start).alias("_cs"), F.col(cut_end).alias("_ce")),
        keys, "_cs", "_ce", slice_sec=slice_sec,
    )
    holes = gaps(islands, keys, "_cs", "_ce", slice_sec=slice_sec)
    inner = overlap_join(
        base, holes, keys, left_span=(start, end), right_span=("g_start", "g_end"), bucket_sec=bucket_sec
    ).withColumns(
        {start: F.greatest(F.col(start), F.col("g_start")), end: F.least(F.col(end), F.col("g_end"))}
    ).select(*base.columns)
    reach = cuts.filter(F.col(cut_start) < F.col(cut_end)).groupBy(*keys).agg(
        F.min(cut_start).alias("_first"), F.max(cut_end).alias("_last")
    )
    s, e = F.col(start), F.col(end)
    ends = F.array(
        F.struct(s.alias("s"), F.least(e, F.col("_first")).alias("e")),
        F.struct(F.greatest(s, F.col("_last")).alias("s"), e.alias("e")),
    )
    whole = F.array(F.struct(s.alias("s"), e.alias("e")))
    outer = (
        base.join(reach, keys, "left")
        .withColumn("_p", F.explode(F.when(F.col("_first").isNull(), whole).otherwise(ends)))
        .filter(F.col("_p.s") < F.col("_p.e"))
        .withColumns({start: F.col("_p.s"), end: F.col("_p.e")})
        .select(*base.columns)
    )
    return inner.unionByName(outer)


def covered_seconds(
    ranges: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    *,
    range_span=("start_sec", "end_sec"),
    bucket_sec: float = 60.0,
    slice_sec: float = SLICE_SEC,
    merged: bool = False,
    name: str = "covered_sec",
) -> DataFrame:
    """Add the seconds of each range (identified by ``ids``) that the spans of its key cover."""
    keys, ids = list(keys), list(ids)
    flat = spans.select(*keys, F.col("start_sec").alias("_us"), F.col("end_sec").alias("_ue"))
    if not merged:
        flat = union_spans(flat, keys, "_us", "_ue", slice_sec=slice_sec)
    slim = ranges.select(*dict.fromkeys([*keys, *ids, *range_span]))
    hits = overlap_join(
        slim, flat, keys, left_span=range_span, right_span=("_us", "_ue"), bucket_sec=bucket_sec,
    )
    seconds = F.least(F.col(range_span[1]), F.col("_ue")) - F.greatest(F.col(range_span[0]), F.col("_us"))
    sums = hits.groupBy(*ids).agg(F.sum(seconds).alias(name))
    return ranges.join(sums, ids, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def overlay_by_priority(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Positives whole, uncertain minus positives, negative minus both. Spans of one kind do not cut
    each other."""
    positive = df.filter(F.col("kind") == "positive")
    uncertain = df.filter(F.col("kind") == "uncertain")
    negative = df.filter(F.col("kind") == "negative")
    uncertain = subtract_spans(uncertain, positive, keys, **options)
    # positive and the remaining uncertain spans together cover positive and all uncertain spans
    negative = subtract_spans(
        negative, df.filter(F.col("kind").isin("positive", "uncertain")), keys, **options
    )
    return positive.unionByName(uncertain).unionByName(negative)


def replace_core(
    current: DataFrame, core: DataFrame, reviewed: DataFrame, keys: Sequence[str], **options
) -> DataFrame:
    """Put the labels of a newer review into its core range (``core``: one row per key with
    core_start, core_end). Keys without a review are left as they are."""
    keys = list(keys)
    bounds = [F.col("core_start"), F.col("core_end")]
    columns = current.columns
    s, e, positive = F.col("start_sec"), F.col("end_sec"), F.col("kind") == "positive"
    owned = owned_by("start_sec", "end_sec", *bounds)
    cut = (s < F.col("core_end")) & (F.col("core_start") < e)
    piece = lambda start, end: F.struct(start.alias("s"), end.alias("e"))
    whole = F.array(piece(s, e))
    # a single cut per key: the trimmed rest is at most two pieces, no range join needed
    parts = F.filter(
        F.array(piece(s, F.least("end_sec", "core_start")), piece(F.greatest("start_sec", "core_end"), e)), lambda x: x["s"] < x["e"]
    )
    old = F.when(positive & ~F.coalesce(owned, F.lit(False)), whole).when(
        ~positive, F.when(F.coalesce(cut, F.lit(False)), parts).when(s < e, whole)
    )
    new = F.when(positive & owned, whole).when(
        ~positive & cut, F.array(piece(F.greatest("core_start", "start_sec"), F.least("core_end", "end_sec")))
    )
    # both lists meet the cores in one join, and what is left is written: every overlay reads it several times
    both = current.withColumn("_new", F.lit(False)).unionByName(reviewed.select(*columns).withColumn("_new", F.lit(True)))
    merged = (
        both.join(core.select(*keys, "core_start", "core_end"), keys, "left")
        .withColumn("_p", F.explode(F.when(F.col("_new"), new).otherwise(old)))
        .withColumns({"start_sec": F.col("_p.s"), "end_sec": F.col("_p.e")})
        .select(*columns)
    )
    return overlay_by_priority(materialize(merged, "replaced"), keys, **options)


def dedup_spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct exact spans per key."""
    return df.select(*keys, "start_sec", "end_sec").distinct()


def text_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    slice_sec: float = SLICE_SEC,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Merge consecutive rows with equal text (whitespace ignored) whose ranges touch.

    The end of a run is its last row's end, not the largest one; the text is its first row's."""
    keys = list(keys)
    block = time_slice("start_sec", slice_sec)
    work = sliced_lag(
        df.withColumn("_norm", strip_space("text")),
        keys,
        order,
        block,
        {"_ptext": F.col("_norm"), "_pend": F.col("end_sec")},
    )
    joins = F.coalesce(
        (F.col("_norm") == F.col("_ptext")) & (F.col("start_sec") <= F.col("_pend") + tolerance), F.lit(False)
    )
    work = sliced_running(
        work, keys, order, block, sums={"run_no": F.when(joins, 0).otherwise(1).cast("bigint")}
    )
    rank = F.struct(*order)
    return work.groupBy(*keys, "run_no").agg(
        F.min("start_sec").alias("start_sec"),
        F.max_by("end_sec", rank).alias("end_sec"),
        F.min_by("text", rank).alias("text"),
        F.count(F.lit(1)).alias("rows"),
    )


def page_coverage(
    pages: DataFrame, watched: DataFrame, keys: Sequence[str], *, tolerance: float = TOLERANCE, slice_sec: float = SLICE_SEC
) -> DataFrame:
    """Pages plus ``covered``: the core is watched from its start to its end without a gap.

    Watched ranges are merged with the tolerance first; a page is covered when one merged range
    starts at or before its core and ends at or after it."""
    keys = list(keys)
    seen = union_spans(
        watched.select(*keys, F.col("start_sec").alias("_ws"), F.col("end_sec").alias("_we")),
        keys, "_ws", "_we", slice_sec=slice_sec, tolerance=tolerance,
    )
    inside = (F.col("_ws") <= F.col("core_start_sec") + tolerance) & (
        F.col("_we") >= F.col("core_end_sec") - tolerance
    )
    slim = pages.select(*keys, "page_id", "core_start_sec", "core_end_sec")
    hits = (
        overlap_join(
            slim, seen, keys, left_span=("core_start_sec", "core_end_sec"), right_span=("_ws", "_we"),
            residual=inside,
        )
        .select(*keys, "page_id")
        .distinct()
        .withColumn("covered", F.lit(True))
    )
    return pages.join(hits, [*keys, "page_id"], "left").withColumn(
        "covered", F.coalesce("covered", F.lit(False))
    )


def tiling_violations(
    pages: DataFrame, videos: DataFrame, keys: Sequence[str], *, slice_sec: float = SLICE_SEC, tolerance: float = 1e-9
) -> DataFrame:
    """Reason rows for page lists that do not tile [0, duration] in order."""
    keys = list(keys)
    order = [F.col("core_start_sec"), F.col("page_id")]
    chained = sliced_lag(
        pages, keys, order, time_slice("core_start_sec", slice_sec), {"_prev": F.col("core_end_sec")}
    )
    expected = F.coalesce("_prev", F.lit(0.0))
    gap = chained.filter(F.abs(F.col("core_start_sec") - expected) > tolerance).select(
        *keys, "page_id", F.lit("not_continuous").alias("reason")
    )
    joined = pages.join(videos.select(*keys, "duration_sec"), keys)
    read = joined.filter(F.col("read_end_sec") > F.col("duration_sec") + tolerance).select(
        *keys, "page_id", F.lit("read_out_of_video").alias("reason")
    )
    twice = (
        pages.groupBy(*keys, "page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(*keys, "page_id", F.lit("duplicate_id").alias("reason"))
    )
    ends = pages.groupBy(*keys).agg(F.max("core_end_sec").alias("_end"))
    short = (
        videos.select(*keys, "duration_sec").join(ends, keys, "left")
        .filter(F.col("_end").isNull() | (F.abs(F.col("_end") - F.col("duration_sec")) > tolerance))
        .select(*keys, F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("incomplete").alias("reason"))
    )
    return gap.unionByName(read).unionByName(twice).unionByName(short)
