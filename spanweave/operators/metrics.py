"""Aggregates over labels, windows, matchings and run logs.

Counts and sums are combined on the map side; global medians and percentiles use the exact
bucketed order statistics, so no single task sorts or hashes all values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import is_finite
from ..functions.scalars import f1, ratio, wilson
from .intervalsets import covered_seconds, union_spans
from .ordered import exact_median, nearest_rank, order_statistics


def rates(totals: DataFrame, hits: str = "hits", predictions: str = "predictions", targets: str = "targets") -> DataFrame:
    """Precision, recall and F1 (0 when undefined) with 95 % intervals (null when undefined)."""
    p_lo, p_hi = wilson(hits, predictions)
    r_lo, r_hi = wilson(hits, targets)
    return totals.withColumns(
        {
            "precision": ratio(hits, predictions),
            "recall": ratio(hits, targets),
            "f1": f1(hits, predictions, targets),
            "precision_low": p_lo,
            "precision_high": p_hi,
            "recall_low": r_lo,
            "recall_high": r_hi,
        }
    )


def count_by(df: DataFrame, column: str, facet: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "name", "n")


def store_counts(videos: DataFrame) -> DataFrame:
    """Counts by status, split and, for ready reviewed labels, source and split: one scan, one
    aggregation over exploded facets (map-side combined)."""
    approved = (F.col("status") == "ready") & (F.col("source") == "model_reviewed")
    facets = F.array(
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("name")),
        F.struct(F.lit("split").alias("facet"), F.col("split").alias("name")),
        F.when(approved, F.struct(F.lit("label").alias("facet"), F.col("source").alias("name"))),
        F.when(approved, F.struct(F.lit("ready_split").alias("facet"), F.col("split").alias("name"))),
    )
    return (
        videos.select(F.explode(F.array_compact(facets)).alias("f"))
        .groupBy("f.facet", "f.name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def store_quality(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct groups, unioned highlight seconds of approved labels, total seconds, their ratio."""
    approved = videos.filter((F.col("status") == "ready") & (F.col("source") == "model_reviewed"))
    positive = segments.filter(F.col("kind") == "positive").join(approved.select("video_id"), "video_id", "left_semi")
    merged = union_spans(positive.select("video_id", "start_sec", "end_sec"), ["video_id"])
    dramas = videos.select("drama_id").distinct().agg(F.count(F.lit(1)).alias("dramas"))
    seconds = merged.agg(F.coalesce(F.sum(F.col("end_sec") - F.col("start_sec")), F.lit(0.0)).alias("highlight_sec"))
    total = approved.agg(F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("total_sec"))
    return one_row(dramas, seconds, total).select(
        "dramas",
        F.round("highlight_sec", 3).alias("highlight_sec"),
        F.round("total_sec", 3).alias("total_sec"),
        F.round(ratio("highlight_sec", "total_sec"), 4).alias("highlight_ratio"),
    )


def snapshot_report(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Totals per split of the exportable videos (approved, with a positive or a negative label)."""
    approved = videos.filter((F.col("status") == "ready") & (F.col("source") == "model_reviewed"))
    certain = segments.filter(F.col("kind").isin("positive", "negative"))
    length = F.col("end_sec") - F.col("start_sec")
    per_video = segments.groupBy("video_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("positive", "negative", "uncertain")],
        F.sum(F.when(F.col("kind") == "positive", length).otherwise(0.0)).alias("_hl"),
        F.max(F.when(F.col("kind") == "positive", length)).alias("_long"),
    )
    known = (
        union_spans(certain.select("video_id", "start_sec", "end_sec"), ["video_id"])
        .groupBy("video_id")
        .agg(F.sum(length).alias("_known"))
    )
    rows = approved.join(per_video, "video_id").join(known, "video_id")
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_distinct("drama_id").alias("dramas"),
        *[F.sum(k).alias(k) for k in ("positive", "negative", "uncertain")],
        F.sum("duration_sec").alias("total_sec"),
        F.sum("_known").alias("supervised_sec"),
        F.sum("_hl").alias("highlight_sec"),
        F.coalesce(F.max("_long"), F.lit(0.0)).alias("longest_highlight_sec"),
    )
    return out.withColumns(
        {
            "unknown_sec": F.col("total_sec") - F.col("supervised_sec"),
            "highlight_ratio": F.round(ratio("highlight_sec", "total_sec"), 4),
        }
    )


def stage_stats(windows: DataFrame) -> DataFrame:
    """Samples, distinct videos and groups, per category, focus rows. Needs category and focus."""
    return windows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("video_id").alias("videos"),
        F.count_distinct("drama_id").alias("dramas"),
        *[F.count_if(F.col("category") == c).alias(c) for c in ("empty", "single", "multiple")],
        F.count_if("focus").alias("history_focus"),
    )


def match_totals(items: DataFrame, pairs: DataFrame, predictions: DataFrame, targets: DataFrame, keys: Sequence[str], group: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """hits, predictions, targets per (group, threshold), every item counted, matched or not.

    Each input is reduced to one row per item before it meets another."""
    keys = list(keys)
    n_p = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
    n_t = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nt"))
    hit = pairs.groupBy(*keys).pivot("threshold", [float(t) for t in thresholds]).agg(F.count(F.lit(1)))
    hit = hit.select(*keys, *[F.col(f"`{float(t)}`").alias(f"_h{i}") for i, t in enumerate(thresholds)])
    per_item = items.join(n_p, keys, "left").join(n_t, keys, "left").join(hit, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = per_item.groupBy(*group).agg(
        F.sum(zero("_np")).alias("predictions"),
        F.sum(zero("_nt")).alias("targets"),
        *[F.sum(zero(f"_h{i}")).alias(f"_h{i}") for i in range(len(thresholds))],
    )
    each = F.explode(
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_h{i}").alias("hits")) for i, t in enumerate(thresholds)])
    )
    return totals.withColumn("_e", each).select(*group, "_e.threshold", "_e.hits", "predictions", "targets")


def window_quality(windows: DataFrame) -> DataFrame:
    """Validity and empty-window rates. Needs parse_error, truncated, n_pred, n_ref,
    out_of_bounds, out_of_scope."""
    empty = F.col("n_ref") == 0
    clean = F.col("n_pred") == 0
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        ratio(F.count_if(~F.col("parse_error")), F.count(F.lit(1))).alias("valid_output_rate"),
        F.count_if("parse_error").alias("invalid_outputs"),
        F.count_if("truncated").alias("truncated_outputs"),
        F.count_if(empty).alias("empty_windows"),
        ratio(F.count_if(empty & ~clean), F.count_if(empty)).alias("empty_window_false_positive_rate"),
        ratio(F.count_if(empty & clean & ~F.col("parse_error")), F.count_if(empty)).alias("empty_window_correct_rate"),
        F.coalesce(F.sum("out_of_bounds"), F.lit(0)).cast("bigint").alias("out_of_bounds_segments"),
        F.coalesce(F.sum("out_of_scope"), F.lit(0)).cast("bigint").alias("out_of_scope_segments"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Global aggregates side by side: stacked, then folded into one row (no cross join)."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def length_summary(predicted: DataFrame, reference: DataFrame, generation: DataFrame, *, width: float = 5.0) -> DataFrame:
    """Median and largest predicted length, median reference length, mean and median generation
    seconds. Inputs: tables with start_sec/end_sec, and one with generation_sec."""
    length = (F.col("end_sec") - F.col("start_sec")).alias("_len")
    p, r = predicted.select(length), reference.select(length)
    return one_row(
        p.agg(F.max("_len").alias("predicted_max_seconds")),
        exact_median(p, [], "_len", "predicted_median_seconds", width),
        exact_median(r, [], "_len", "reference_median_seconds", width),
        generation.agg(F.avg("generation_sec").alias("mean_generation_sec")),
        exact_median(generation, [], "generation_sec", "median_generation_sec", width),
    )


def matched_error(pairs: DataFrame) -> DataFrame:
    """Mean IoU and mean absolute boundary errors of matched pairs (p_start.. t_end, similarity)."""
    return pairs.agg(
        F.avg("similarity").alias("matched_mean_iou"),
        F.avg(F.abs(F.col("p_start") - F.col("t_start"))).alias("start_mae"),
        F.avg(F.abs(F.col("p_end") - F.col("t_end"))).alias("end_mae"),
    )


def duration_fractions(ranges: DataFrame, predicted: DataFrame, reference: DataFrame, keys: Sequence[str], ids: Sequence[str], n_predictions: DataFrame) -> DataFrame:
    """Covered predicted and reference seconds inside the detect ranges over their total length,
    and predictions per minute. ``n_predictions``: one-row table with ``n_pred``."""
    with_p = covered_seconds(ranges, predicted, keys, ids, name="_p")
    both = covered_seconds(with_p, reference, keys, ids, name="_r")
    length = F.col("end_sec") - F.col("start_sec")
    sums = both.agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"), F.sum(length).alias("_all"))
    return one_row(sums, n_predictions).select(
        ratio("_p", "_all").alias("predicted_duration_fraction"),
        ratio("_r", "_all").alias("reference_duration_fraction"),
        ratio(F.col("n_pred") * 60, "_all").alias("predictions_per_minute"),
    )


def item_runtime(attempts: DataFrame, trace: DataFrame, keys: Sequence[str], *, width: float = 5.0) -> DataFrame:
    """Per item: elapsed seconds (null if any attempt is untimed), request median / nearest-rank
    p90 / max, error and invalid-call counts.

    ``attempts``: keys, attempt_no, elapsed_sec, status. ``trace``: keys, kind, elapsed_sec,
    calls_empty, error."""
    keys = list(keys)
    timed = attempts.groupBy(*keys).agg(
        F.when(F.bool_and(F.col("elapsed_sec").isNotNull()), F.sum("elapsed_sec")).alias("elapsed_sec"),
        F.count(F.lit(1)).alias("attempts"),
        F.min_by("status", "attempt_no").alias("first_status"),
    )
    request = F.col("kind").isin("model", "clip_review", "perception_model") & F.col("elapsed_sec").isNotNull()
    seconds = trace.filter(request).select(*keys, "elapsed_sec")
    stats = order_statistics(
        seconds, keys, "elapsed_sec",
        {
            "_lo": lambda n: F.floor((n + 1) / 2),
            "_hi": lambda n: F.floor(n / 2) + 1,
            "request_p90_sec": lambda n: F.greatest(F.lit(1), F.ceil(F.lit(0.9) * n)),
            "request_max_sec": lambda n: n,
        },
        width,
    )
    counts = trace.groupBy(*keys).agg(
        F.count_if(request).alias("requests"),
        F.count_if(F.col("kind") == "request_error").alias("request_errors"),
        F.count_if((F.col("kind") == "model") & F.col("calls_empty")).alias("missing_tool_calls"),
        F.count_if((F.col("kind") == "tool") & F.col("error")).alias("invalid_tool_requests"),
    )
    return (
        counts.join(timed, keys, "full")
        .join(stats, keys, "left")
        .withColumn("request_median_sec", (F.col("_lo") + F.col("_hi")) / 2)
        .drop("_lo", "_hi")
    )


def run_runtime(items: DataFrame, *, width: float = 50.0) -> DataFrame:
    """Run totals over ``item_runtime`` rows; the total is null if any item's is."""
    totals = items.agg(
        F.when(F.bool_and(F.col("elapsed_sec").isNotNull()), F.sum("elapsed_sec")).alias("elapsed_total_sec"),
        F.count("elapsed_sec").alias("timed_videos"),
        F.count_if(F.col("first_status") == "complete").alias("first_attempt_completed"),
        F.count_if(F.col("attempts") > 1).alias("videos_with_multiple_attempts"),
        *[F.sum(c).alias(c) for c in ("requests", "request_errors", "missing_tool_calls", "invalid_tool_requests")],
    )
    median = exact_median(items, [], "elapsed_sec", "elapsed_median_sec", width)
    p90 = nearest_rank(items, [], "elapsed_sec", 0.9, "elapsed_p90_sec", width)
    return one_row(totals, median, p90)


def validation_summary(scored: DataFrame) -> DataFrame:
    """Summary over scored answers (score, format_valid, predicted_count, target_count,
    invalid_segments, hits30, hits50)."""
    positive = F.col("target_count") > 0
    n = F.count(F.lit(1))
    totals = scored.agg(
        F.avg("score").alias("soft_f1"),
        ratio(F.count_if("format_valid"), n).alias("valid_output_rate"),
        ratio(F.count_if(positive & F.col("format_valid") & (F.col("predicted_count") == 0)), F.count_if(positive)).alias("empty_positive_rate"),
        ratio(F.count_if(~positive & (F.col("predicted_count") > 0)), F.count_if(~positive)).alias("empty_window_false_positive_rate"),
        F.sum("invalid_segments").alias("invalid_segments"),
        *[F.sum(c).alias(c) for c in ("hits30", "hits50", "predicted_count", "target_count")],
    )
    for t in (30, 50):
        totals = totals.withColumns(
            {
                f"precision_iou{t}": ratio(f"hits{t}", "predicted_count"),
                f"recall_iou{t}": ratio(f"hits{t}", "target_count"),
                f"f1_iou{t}": f1(f"hits{t}", "predicted_count", "target_count"),
            }
        )
    return totals


def reward_signal(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """Spread of scores per sample, then averages: two map-side combined levels.

    Needs score and positive (whether the sample has targets)."""
    per = scores.groupBy(*group).agg(
        F.stddev_pop("score").alias("_sd"),
        F.bool_and(F.col("score") == 0).alias("_zero"),
        F.sum(F.when(F.col("positive"), F.col("score"))).alias("_ps"),
        F.count_if("positive").alias("_pn"),
        F.sum(F.when(~F.col("positive"), F.col("score"))).alias("_ns"),
        F.count_if(~F.col("positive")).alias("_nn"),
    )
    n = F.count(F.lit(1))
    return per.agg(
        F.avg("_sd").alias("reward_std"),
        ratio(F.count_if(F.col("_sd") > 1e-8), n).alias("groups_with_signal"),
        ratio(F.count_if("_zero"), n).alias("all_zero_groups"),
        F.try_divide(F.sum("_ps"), F.sum("_pn").cast("double")).alias("positive_reward"),
        F.try_divide(F.sum("_ns"), F.sum("_nn").cast("double")).alias("negative_reward"),
    )


def delivery(highlights: DataFrame) -> DataFrame:
    """Accepted clips, their seconds, pending reviews, configured clips."""
    accepted = F.col("review_status") == "accepted"
    return highlights.agg(
        F.count_if(accepted).alias("accepted"),
        F.coalesce(F.sum(F.when(accepted, F.col("end_sec") - F.col("start_sec"))), F.lit(0.0)).alias("total_sec"),
        F.count_if(~F.col("review_status").isin("accepted", "rejected")).alias("pending_reviews"),
        F.count_if(accepted & F.col("configured")).alias("configured"),
    )


def finite_values(df: DataFrame, value: str) -> DataFrame:
    return df.filter(is_finite(value))


def all_and_completed(items: DataFrame) -> DataFrame:
    """Totals over all items (an incomplete one keeps its targets but has no predictions) and over
    the completed ones, with the completion rate: one scan, conditional sums.

    ``items``: complete, hits, predictions, targets."""
    done = F.col("complete")
    live = lambda c: F.sum(F.when(done, F.col(c)).otherwise(0))
    total = items.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_done"), live("hits").alias("hits"),
        live("predictions").alias("predictions"), F.sum("targets").alias("targets"), live("targets").alias("targets_done"),
    )

    def row(scope, n, targets):
        return F.struct(F.lit(scope).alias("scope"), F.col(n).alias("videos"), F.col(targets).alias("targets"))

    each = F.explode(F.array(row("all", "n", "targets"), row("completed_only", "n_done", "targets_done")))
    return total.withColumn("_r", each).select(
        "_r.scope", "_r.videos", "hits", "predictions", "_r.targets", ratio("n_done", "n").alias("completion_rate")
    )
