"""Clip selection: agreement with events, decision checks, publication, media alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import sliced_lag, time_slice

BUDGET_TOLERANCE = 1e-9

# Fixed value: issue text of an aligned clip that became too long.
ISSUE_ALIGNED_TOO_LONG = "对齐视频帧后的片段超过单片时长上限；请调整建议边界后重新制作。"


def plan_mismatch(plans: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Plans with ``mismatch``: unknown_event, event_not_supported, stale_event_version,
    stale_required_spans, or null."""
    current = events.select(
        *keys, "event_id", F.col("status").alias("_s"), F.col("version").alias("_v"),
        F.col("required_spans").alias("_r"), F.lit(True).alias("_known"),
    )
    return (
        plans.join(current, [*keys, "event_id"], "left")
        .withColumn(
            "mismatch",
            F.when(F.col("_known").isNull(), "unknown_event")
            .when(F.col("_s") != "supported", "event_not_supported")
            .when(F.col("event_version") != F.col("_v"), "stale_event_version")
            .when(~F.col("required_spans").eqNullSafe(F.col("_r")), "stale_required_spans"),
        )
        .drop("_s", "_v", "_r", "_known")
    )


def decision_violations(plans: DataFrame, decisions: DataFrame, budgets: DataFrame, *, slice_sec: float = 600.0) -> DataFrame:
    """(job_id, reason) of selections that may not be delivered.

    ``plans``: job_id, event_id, start_sec, end_sec, status. ``decisions``: job_id, event_id,
    selected, duplicate_of. ``budgets``: job_id, max_count, max_seconds (nullable), allow_overlap.
    """
    key = ["job_id", "event_id"]
    once = decisions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.bool_or("selected").alias("selected"))
    plan = plans.select(*key, "start_sec", "end_sec", "status", F.lit(True).alias("_plan"))
    # one join of plans and decisions, written: every check below reads it
    judged = materialize(plan.join(once, key, "full"), "judged")
    picked = judged.filter(F.col("_plan") & F.col("selected")).drop("_plan", "_n", "selected")
    uncovered = F.col("_plan").isNull() | F.col("_n").isNull() | (F.col("_n") > 1)
    infeasible = F.col("_plan") & F.col("selected") & (F.col("status") == "infeasible_duration")
    single = judged.select(
        "job_id", _reasons(F.when(uncovered, "decisions_do_not_cover"), F.when(infeasible, "infeasible_selected"))
    )
    dangling = (
        decisions.filter(F.col("duplicate_of").isNotNull())
        .join(picked.select("job_id", F.col("event_id").alias("duplicate_of")), ["job_id", "duplicate_of"], "left_anti")
        .select("job_id", F.lit("duplicate_of_unselected").alias("reason"))
    )
    sums = picked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("_s")
    ).join(budgets, "job_id")
    over = sums.select(
        "job_id",
        _reasons(
            F.when(F.col("_c") > F.col("max_count"), "count_budget"),
            F.when(F.col("_s") > F.col("max_seconds") + BUDGET_TOLERANCE, "seconds_budget"),
        ),
    )
    strict = picked.join(budgets.filter(~F.col("allow_overlap")).select("job_id"), "job_id", "left_semi")
    touching = consecutive_overlaps(strict, ["job_id"], ["event_id"], slice_sec=slice_sec).select(
        "job_id", F.lit("overlap").alias("reason")
    )
    parts = [single, dangling, over, touching]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def _reasons(*reasons: Column) -> Column:
    return F.explode(F.array_compact(F.array(*reasons))).alias("reason")


def consecutive_overlaps(spans: DataFrame, keys: list[str], ties: list[str], *, slice_sec: float = 600.0) -> DataFrame:
    """Rows that start before their chronological predecessor ends, with ``prev_end``."""
    order = [F.col("start_sec"), *[F.col(c) for c in ties]]
    chained = sliced_lag(spans, keys, order, time_slice("start_sec", slice_sec), {"prev_end": F.col("end_sec")})
    return chained.filter(F.col("prev_end") > F.col("start_sec"))


def unpublishable(selected: DataFrame) -> DataFrame:
    """Selected plans that are not ready, not reviewed, have issues or no media, with the reason."""
    reason = (
        F.when(F.col("status") != "ready", "not_ready")
        .when(F.col("review").isNull(), "not_reviewed")
        .when(F.size("issues") > 0, "has_issues")
        .when(F.col("media_path").isNull(), "no_media")
    )
    return selected.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def align_media(plans: DataFrame, snapped: DataFrame, keys: list[str], max_clip_sec: float = 24.0) -> DataFrame:
    """Take frame-aligned bounds that do not shrink the plan; the review is reset. Rows that would
    shrink or leave the video keep their bounds and carry ``align_error``."""
    a, b = F.col("src_start_sec"), F.col("src_end_sec")
    joined = plans.join(snapped.select(*keys, "src_start_sec", "src_end_sec"), keys, "left")
    error: Column = (
        F.when(a.isNull() | b.isNull(), "no_media")
        .when(~((a >= 0) & (a < b) & (b <= F.col("duration_sec"))), "outside_video")
        .when((a > F.col("start_sec")) | (b < F.col("end_sec")), "discards_content")
    )
    old = F.when(F.col("plan_status") == "infeasible_duration", F.col("issues")).otherwise(F.array().cast("array<string>"))
    grown = F.when(
        b - a > max_clip_sec, F.array_distinct(F.array_append(old, F.lit(ISSUE_ALIGNED_TOO_LONG)))
    ).otherwise(old)
    ok = F.col("align_error").isNull()
    return (
        joined.withColumn("align_error", error)
        .withColumn("issues", F.when(ok, grown).otherwise(F.col("issues")))
        .withColumns(
            {
                "start_sec": F.when(ok, a).otherwise(F.col("start_sec")),
                "end_sec": F.when(ok, b).otherwise(F.col("end_sec")),
                "plan_status": F.when(
                    ok, F.when(F.size("issues") > 0, "infeasible_duration").otherwise("draft")
                ).otherwise(F.col("plan_status")),
                "reviewed": F.when(ok, F.lit(False)).otherwise(F.col("reviewed")),
            }
        )
        .drop("src_start_sec", "src_end_sec")
    )


def best_step(steps: DataFrame, run: str = "run") -> DataFrame:
    """Best step per run by (f1_iou50, recall_iou30, -empty false-positive rate); first wins ties."""
    score = F.struct(
        F.col("f1_iou50"), F.col("recall_iou30"),
        (-F.col("empty_window_false_positive_rate")).alias("neg_fp"), (-F.col("step")).alias("neg_step"),
    )
    return steps.groupBy(run).agg(F.max_by("step", score).alias("best_step"), F.max(score).alias("_s")).select(
        run, "best_step", "_s.f1_iou50", "_s.recall_iou30"
    )


def evidence_violations(spans: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Cited spans with a violation code: not_delivered, outside_observation, outside_candidate.

    ``spans``: keys, observation_id, start_sec, end_sec, cand_start, cand_end. ``observations``:
    keys, observation_id, src_start_sec, src_end_sec, delivered."""
    s, e = F.col("start_sec"), F.col("end_sec")
    joined = spans.join(observations, [*keys, "observation_id"], "left")
    code = (
        F.when(~F.coalesce("delivered", F.lit(False)), "not_delivered")
        .when(~((F.col("src_start_sec") <= s) & (s < e) & (e <= F.col("src_end_sec"))), "outside_observation")
        .when(~((F.col("cand_start") <= s) & (s < e) & (e <= F.col("cand_end"))), "outside_candidate")
    )
    return joined.withColumn("violation", code).select(*spans.columns, "violation")
