"""The label store as tables: registration, versions, feedback and the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import iou, is_finite
from ..functions.labels import label_status
from .ordered import global_rank
from .rangejoin import candidate_edges


def register(videos: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome per incoming row: added, duplicate or conflict.

    ``incoming``: pos, video_id, drama_id, sha256. One id with two hashes, or one hash in two
    groups, is a conflict. Existing rows count as earlier than every incoming row. Both checks
    are keyed aggregates, so copies fold before the shuffle.
    """
    known = videos.select(F.lit(None).cast("bigint").alias("pos"), "video_id", "drama_id", "sha256", F.lit(True).alias("old"))
    both = known.unionByName(incoming.select(F.col("pos").cast("bigint").alias("pos"), "video_id", "drama_id", "sha256", F.lit(False).alias("old")))
    by_id = both.groupBy("video_id").agg((F.min("sha256") != F.max("sha256")).alias("_id_clash"))
    by_hash = both.groupBy("sha256").agg(
        (F.min("drama_id") != F.max("drama_id")).alias("_hash_clash"),
        F.bool_or("old").alias("_old"),
        F.min("pos").alias("_first"),
    )
    return (
        incoming.join(by_id, "video_id")
        .join(by_hash, "sha256")
        .withColumn(
            "outcome",
            F.when(F.col("_id_clash") | F.col("_hash_clash"), "conflict")
            .when(~F.col("_old") & (F.col("pos") == F.col("_first")), "added")
            .otherwise("duplicate"),
        )
        .select(*incoming.columns, "outcome")
    )


def current_labels(videos: DataFrame, annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Videos with the annotation their pointer names and the newest prediction set."""
    newest = predictions.groupBy("video_id").agg(
        F.max_by(F.struct("model_id", "segments"), F.struct("created_at", "row_no")).alias("_p")
    )
    return (
        videos.join(annotations.drop("video_id"), "label_id", "left")
        .join(newest, "video_id", "left")
        .withColumns({"model_id": F.col("_p.model_id"), "predicted": F.col("_p.segments")})
        .drop("_p")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Newest row per key as an aggregate (combined before the shuffle, no sort)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert_predictions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged table keyed by (video_id, model_id) with the outcome of each key."""
    keys = ["video_id", "model_id"]
    old = existing.select(*keys, F.col("payload").alias("_old"), F.lit(True).alias("_in_old"))
    new = incoming.select(*keys, F.col("payload").alias("_new"), F.lit(True).alias("_in_new"))
    both = old.join(new, keys, "full")
    outcome = (
        F.when(F.col("_in_new").isNull(), "kept")
        .when(F.col("_in_old").isNull(), "inserted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    return both.select(
        *keys, F.when(F.col("_in_new").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias("payload"), outcome.alias("outcome")
    )


def feedback_violations(videos: DataFrame, predictions: DataFrame) -> DataFrame:
    """(video_id, reason) of feedback that may not be imported. ``predictions``: one row per span."""
    joined = predictions.groupBy("video_id", "feedback_no").agg(F.max("end_sec").alias("_end")).join(
        videos.select("video_id", "split", "status", "duration_sec"), "video_id", "left"
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("split").isNull(), F.lit("unknown_video")),
            F.when(F.col("split") != "train", F.lit("not_train")),
            F.when(F.col("status") == "labeling", F.lit("being_labelled")),
            F.when(F.col("_end") > F.col("duration_sec"), F.lit("out_of_range")),
        )
    )
    per_row = joined.select("video_id", F.explode(reasons).alias("reason"))
    twice = (
        predictions.groupBy("video_id").agg((F.min("feedback_no") != F.max("feedback_no")).alias("_twice"))
        .filter("_twice").select("video_id", F.lit("repeated_id").alias("reason"))
    )
    return per_row.unionByName(twice).distinct()


def feedback_priority(videos: DataFrame, targets: DataFrame, predictions: DataFrame, threshold: float, *, bucket_sec: float = 60.0) -> DataFrame:
    """Priority and status after feedback: targets no prediction reaches plus predictions that
    reach no target (any match, not one-to-one); unlabelled videos count their predictions.

    Equal spans are folded into one row with a multiplicity first, so copies never multiply pairs.
    ``videos``: video_id, status, labelled.
    """
    def folded(df, tag):
        return df.groupBy("video_id", F.col("start_sec").alias(f"{tag}_start"), F.col("end_sec").alias(f"{tag}_end")).agg(
            F.count(F.lit(1)).alias(f"_{tag}n")
        )

    p, t = folded(predictions, "p"), folded(targets, "t")
    edges = candidate_edges(
        p, t, ["video_id"], lambda: iou("p_start", "p_end", "t_start", "t_end"), threshold, bucket_sec=bucket_sec
    )
    missed = t.join(edges, ["video_id", "t_start", "t_end"], "left_anti").groupBy("video_id").agg(F.sum("_tn").alias("missed"))
    extra = p.join(edges, ["video_id", "p_start", "p_end"], "left_anti").groupBy("video_id").agg(F.sum("_pn").alias("extra"))
    total = p.groupBy("video_id").agg(F.sum("_pn").alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = videos.join(total, "video_id").join(missed, "video_id", "left").join(extra, "video_id", "left")
    out = out.withColumn("priority", F.when(F.col("labelled"), zero("missed") + zero("extra")).otherwise(zero("_all")))
    moved = F.when(F.col("labelled"), F.lit("review")).otherwise(F.lit("queued"))
    return out.withColumn(
        "new_status", F.when(F.col("priority") > 0, moved).otherwise(F.col("status"))
    ).select("video_id", "priority", "status", "new_status")


def review_queue(videos: DataFrame, *, split: str | None = None) -> DataFrame:
    """Waiting videos with ``queue_rank``: priority first, then groups with few approved labels,
    then short videos, then id. The rank is exact and needs no single-task sort."""
    waiting = videos.filter(F.col("status").isin("queued", "review"))
    if split:
        waiting = waiting.filter(F.col("split") == split)
    approved = (
        videos.filter((F.col("status") == "ready") & (F.col("source") == "model_reviewed"))
        .groupBy("drama_id").agg(F.count(F.lit(1)).alias("approved"))
    )
    ranked = waiting.join(approved, "drama_id", "left").withColumn("approved", F.coalesce("approved", F.lit(0)))
    order = [F.col("priority").desc(), F.col("approved"), F.col("duration_sec"), F.col("video_id")]
    return global_rank(ranked, order, "queue_rank")


def append_labels(videos: DataFrame, submissions: DataFrame) -> DataFrame:
    """Outcome per submission: accepted only when the expected label is the current one; of
    several for one video the first wins. ``submissions``: submission_no, video_id,
    expected_label_id, n_certain."""
    valid = submissions.join(videos.select("video_id", F.col("label_id").alias("_current")), "video_id", "left").withColumn(
        "_match", F.col("expected_label_id").eqNullSafe(F.col("_current"))
    )
    first = valid.filter("_match").groupBy("video_id").agg(F.min("submission_no").alias("_first"))
    wins = F.coalesce(F.col("_match") & (F.col("submission_no") == F.col("_first")), F.lit(False))
    return (
        valid.join(first, "video_id", "left")
        .withColumn("outcome", F.when(wins, "accepted").otherwise("conflict"))
        .withColumn("new_status", F.when(wins, label_status("n_certain")))
        .select("submission_no", "video_id", "outcome", "new_status")
    )


def eval_dataset_violations(manifest: DataFrame, annotations: DataFrame, events: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(video_id, reason) for an evaluation set that may not be frozen.

    ``annotations``: video_id, annotation_status. ``events``: video_id, event_id, start_sec, end_sec.
    """
    # one row per video from each table, so that a task holds sums and not the joined events
    labels = annotations.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_labels"), F.bool_or(F.coalesce(F.col("annotation_status").isin(*allowed), F.lit(False))).alias("_allowed")
    )
    length = F.col("duration_sec")
    videos = manifest.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_videos"), F.min(length).alias("_shortest"), F.bool_or(length.isNull()).alias("_unknown"),
        F.bool_or(F.coalesce(~is_finite("duration_sec") | (length <= 0), F.lit(False))).alias("_bad_length"),
    )
    ok = is_finite("start_sec") & is_finite("end_sec") & (F.col("start_sec") >= 0) & (F.col("start_sec") < F.col("end_sec"))
    ranges = events.groupBy("video_id").agg(F.bool_or(~F.coalesce(ok, F.lit(False))).alias("_bad_range"), F.max("end_sec").alias("_end"))
    same_event = (
        events.filter(F.col("event_id").isNotNull()).groupBy("video_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("video_id").distinct().withColumn("_same_event", F.lit(True))
    )
    found = labels.join(videos, "video_id", "left").join(ranges, "video_id", "left").join(same_event, "video_id", "left")
    listed = F.col("_videos").isNotNull()
    # the shortest of several durations is the one an event breaks first
    beyond = F.col("_bad_range") | F.col("_unknown") | (F.col("_end") > F.col("_shortest") + 0.1)
    checks = {
        "duplicate_annotation": F.col("_labels") > 1,
        "duplicate_video": F.col("_allowed") & (F.col("_videos") > 1),
        "missing_from_manifest": F.col("_allowed") & ~listed,
        "invalid_duration": F.col("_allowed") & F.col("_bad_length"),
        "invalid_interval": F.col("_allowed") & listed & beyond,
        "duplicate_event_id": F.col("_allowed") & listed & F.col("_same_event"),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return found.select("video_id", F.explode(reasons).alias("reason"))


def group_leaks(videos: DataFrame) -> DataFrame:
    """Groups that appear in more than one split (min/max, no distinct set per group)."""
    return (
        videos.groupBy("drama_id").agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def cover_violations(expected: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Ids that are expected but missing, present but foreign, or present more than once."""
    seen = records.groupBy(key).agg(F.count(F.lit(1)).alias("predictions"))
    both = expected.select(key, F.lit(True).alias("expected")).join(seen, key, "full")
    return both.select(
        key, F.coalesce("predictions", F.lit(0)).alias("predictions"), F.coalesce("expected", F.lit(False)).alias("expected")
    ).filter(~F.col("expected") | (F.col("predictions") != 1))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work rows without a finished record (resume)."""
    return work.join(done.select(key), key, "left_anti")
